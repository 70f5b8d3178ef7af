"""Secret scans with corpus-wide ownership.

Regular expressions find candidates of three fixed kinds and of one open kind (``opaque``: long runs of key characters
with letters of both cases and digits). Their values' hashes are counted over the corpus by distinct repository and
owner. A value that many owners or many repositories hold is a copied example; one that an owner or two hold in a few
places looks live. Opaque candidates become findings only if they look live; the fixed kinds stay either way and are
counted as one or the other.

All of it is DataFrame functions. Positions come from the lengths of the pieces between the matches of one pattern,
summed run by run of RUN matches, so that their cost stays near their number.
The counts are made in three groupings, each partial before its shuffle, so that a value in a third of all rows costs
each task one row; verdicts come back in a join whose large partitions Spark splits.

Edge cases. Null or empty text: no findings. Null owner or repository: counts as one of its own. Repeated rows: each
gets its findings; they add no owner. Ties: spans are ordered by start, then kind as listed. Only the named columns
are read, so others may have any name. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import settle

#: Kinds in their order, their patterns, the group that holds the value, the least length of that value.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "opaque": (r"[A-Za-z0-9+/_=-]{24,}", 0, 24),
}
#: What a text must hold for a kind's positions to be worked out.
GATES = {"assign": KINDS["assign"][0], "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "opaque": "[A-Za-z0-9+/_=-]{24}"}
#: Owners, and repositories, from which a value counts as a copied example.
WIDE, WIDE_REPOS = 3, 20
#: Matches whose positions are summed at once.
RUN = 128


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, stop, order, kind, value) of a kind's matches, positions in code points."""
    pattern, group, least = KINDS[kind]
    order = list(KINDS).index(kind)
    span_type = "struct<start:int,stop:int,ord:int,kind:string,value:string>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # a match and the gap before it; the gap after the last match is not needed
    pieces = F.arrays_zip(found.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.slice(F.split(text, pattern), 1, F.size(found)).alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span_type}>").alias("out"))

    def add(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["gap"])
        end = begin + F.length(p["whole"])
        span = F.struct(begin.alias("start"), end.alias("stop"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(p["value"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def runs(all_pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / RUN).cast("int")), lambda c: F.aggregate(F.slice(all_pieces, c * RUN + 1, RUN), empty, add))

    def join(state: Column, run: Column) -> Column:
        at = state["at"]
        moved = F.transform(run["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["stop"] + at).alias("stop"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["value"].alias("value")))
        return F.struct((at + run["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span_type}>>").alias("out"))
    # as a variable, else each run would search the whole text anew
    whole = F.transform(F.array(pieces), lambda found: F.aggregate(runs(found), start, join, lambda x: F.flatten(x["out"])))[0]
    return F.when(text.rlike(GATES[kind]), whole).otherwise(F.array().cast(f"array<{span_type}>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """(row, doc_id, repo, owner, base, extra): each row's spans of the fixed kinds and of the open one. No texts."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    found = slim.select("doc_id", "repo", "owner", F.concat(*[_spans(t, k) for k in KINDS if k != "opaque"]).alias("base"), _spans(t, "opaque").alias("open"))
    mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    kept = found.select("doc_id", "repo", "owner", F.array_sort("base").alias("base"), F.filter("open", lambda s: mixed(s) & apart(s)).alias("extra"))
    return settle(kept.withColumn("row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repos): in how many distinct owners and repositories each value occurs."""
    each = found.where((F.size("base") > 0) | (F.size("extra") > 0)).select("repo", "owner", F.explode(F.concat("base", "extra")).alias("s"))
    return (
        each.select(F.sha2("s.value", 256).alias("value_hash"), "owner", "repo")
        .groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    )


def findings(found: DataFrame) -> DataFrame:
    """One row per finding: (row, doc_id, start, stop, ord, kind, value, owners, repos, live)."""
    some = found.where((F.size("base") > 0) | (F.size("extra") > 0))
    each = some.select("row", "doc_id", F.explode(F.concat("base", "extra")).alias("s")).select("row", "doc_id", "s.*").withColumn("value_hash", F.sha2("value", 256))
    judged = each.join(ownership(found), "value_hash").withColumn("live", (F.col("owners") < WIDE) & (F.col("repos") < WIDE_REPOS))
    return judged.where((F.col("kind") != "opaque") | F.col("live")).drop("value_hash")


def scan(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per row of docs: doc_id, ``spans`` (array of structs in order), ``n_live`` and ``n_example``."""
    found = candidates(docs, **columns)
    held = findings(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "stop", "kind", "value", "owners", "repos", "live"))).alias("spans"))
    spans = F.coalesce("spans", F.array().cast(held.schema["spans"].dataType))
    out = found.select("row", "doc_id").join(held, "row", "left").select("doc_id", spans.alias("spans"))
    return out.select("doc_id", "spans", F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"))


def query(spark, sf_dir: str) -> DataFrame:
    scanned = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    most = lambda k: F.coalesce(F.array_max(F.transform("spans", lambda s: s[k])), F.lit(0)).alias(f"max_{k}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"), "n_live", "n_example",
        most("owners"), most("repos"))
