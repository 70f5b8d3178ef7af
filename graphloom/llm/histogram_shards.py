"""Sharding by histogram sort.

Documents are ordered by a 60-bit hash of their text, so equal texts stand together, and the order is cut into shards of
near equal bytes. The cuts are found without sorting: exact bytes below candidate boundaries are counted across all
partitions, the boundaries are refined inside the interval where a cut falls, and so on until every cut is within
tolerance or rests on one hash. Each round brings at most shards x 4096 sums to the driver. A group of equal texts moves
as a whole to the nearer side of its cut; only a group larger than a shard is cut itself, by a hash of its ids. Then one
exchange carries each document to its shard. Places inside a shard are counted by sub-ranges, whose sizes are summed
first, so no task numbers a whole shard. Sub-ranges follow leading bits of both hashes; the more rows there are, the more
bits of the id's, so that copies of one text, however many, are dealt to sub-ranges of bounded size.

Edge cases. Null text: size 16, one group, like the empty text by itself. Null ids: allowed. Repeated rows: each gets a
place of its own. Ties: equal hashes are placed by id. Fewer documents than shards: some shards stay empty. An empty
table: an empty result. ``shard_documents`` keeps all columns and adds two, whose names are parameters; a name that is
taken gets an underscore.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm._common import fresh, key60, settle, small_side

SHARDS = 40
#: Bytes that each document takes besides its text.
FRAME = 16
#: A cut is good enough if it misses its place by this share of a shard.
TOLERANCE = 0.001
#: Hashes have LEVELS digits of DIGIT bits.
DIGIT, LEVELS = 12, 5
#: Sub-ranges of a shard: leading bits of the text's and of the id's hash.
SUB_TEXT, SUB_ID = 8, 6
#: Rows in a sub-range at most, about, even if all texts are equal: beyond SUB_ROWS << SUB_ID rows, more bits of the id's hash count.
SUB_ROWS = 1 << 18


def size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + FRAME).cast("long")


def text_key(text: Column) -> Column:
    """60 bits; null has its own."""
    return key60(F.coalesce(F.concat(F.lit("="), text), F.lit("~")))


def id_key(doc_id: Column) -> Column:
    return key60(F.coalesce(doc_id.cast("string"), F.lit("~")))


def _cuts(keyed: DataFrame, goals: list[float], slack: float, least: float) -> list[tuple[int, int, int]]:
    """For each goal in bytes the key below which rows stand on its left, the bytes there, and the bytes of the key itself.

    keyed: (key, size). ``least``: bytes of a single key that make it worth a cut of its own. The driver sees sums only.
    """
    inside: dict[int, list[tuple[int, float]]] = {0: [(i, g) for i, g in enumerate(goals)]}  # open prefix: its goals, less the bytes left of it
    out: list = [None] * len(goals)
    left_of = {0: 0}
    for level in range(LEVELS):
        if not inside:
            break
        shift = DIGIT * (LEVELS - 1 - level)
        probes = F.array(*[F.lit(p).cast("long") for p in inside])
        rows = keyed if level == 0 else keyed.where(F.array_contains(probes, F.shiftright("key", shift + DIGIT)))
        sums = rows.groupBy(F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        found: dict[int, list] = {}
        for r in sums.orderBy("bucket").collect():  # at most 4096 by open prefix, and there are fewer prefixes than shards
            found.setdefault(r.bucket >> DIGIT, []).append(r)
        after: dict[int, list] = {}
        left_next: dict[int, int] = {}
        for prefix, wanted in inside.items():
            buckets, edges, total = found.get(prefix, []), [], left_of[prefix]
            for b in buckets:
                total += b.bytes
                edges.append(total)
            for i, goal in wanted:
                at = bisect_left(edges, goal)
                if at == len(buckets):  # behind everything here
                    out[i] = ((prefix + 1) << (shift + DIGIT), total, 0)
                    continue
                b, start = buckets[at], edges[at] - buckets[at].bytes
                if edges[at] - goal <= slack:
                    out[i] = ((b.bucket + 1) << shift, edges[at], 0)
                elif goal - start <= slack:
                    out[i] = (b.bucket << shift, start, 0)
                elif b.lo == b.hi:  # one hash: to the nearer side, unless it is large enough to be cut
                    if b.bytes > least:
                        out[i] = (b.lo, start, b.bytes)
                    else:
                        out[i] = (b.lo + 1, edges[at], 0) if edges[at] - goal <= goal - start else (b.lo, start, 0)
                else:
                    after.setdefault(b.bucket, []).append((i, goal))
                    left_next[b.bucket] = start
        inside, left_of = after, left_next
    return out


def splitters(keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """shards - 1 pairs (text hash, id hash), in order; a row's shard is the number of pairs at or below its own.

    keyed: (k, k2, size), settled.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    goals = [share * i for i in range(1, shards)]
    found = _cuts(keyed.select(F.col("k").alias("key"), "size"), goals, tolerance * share, share)
    out = []
    heavy: dict[int, list] = {}
    for goal, (key, start, own) in zip(goals, found, strict=True):
        if own:
            heavy.setdefault(key, []).append(goal - start)
        else:
            out.append((key, 0))
    for key, rest in heavy.items():  # fewer than shards: each is larger than one
        within = keyed.where(F.col("k") == key).select(F.col("k2").alias("key"), "size")
        out += [(key, k2) for k2, _, _ in _cuts(within, rest, tolerance * share, float("inf"))]
    return sorted(out)


def _shard(k: Column, k2: Column, cuts: list[tuple[int, int]]) -> Column:
    at = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in cuts])
    return F.size(F.filter(at, lambda c: (c["a"] < k) | ((c["a"] == k) & (c["b"] <= k2)))).cast("int") if cuts else F.lit(0)


def place(keyed: DataFrame, cuts: list[tuple[int, int]], counted: DataFrame, k: str, k2: str, tie: list, shard: str, slot: str) -> DataFrame:
    """keyed with its shard and slot. counted: a slim frame of the same rows with k and k2, to count sub-ranges in."""
    bits = max(SUB_ID, (counted.count() // SUB_ROWS).bit_length())
    sub = lambda a, b: F.shiftright(F.col(a), 60 - SUB_TEXT) * 2**bits + F.shiftright(F.col(b), 60 - bits)
    s, n, first, part = fresh(keyed, "gl_shard", "gl_n", "gl_first", "gl_sub")
    counts = counted.select(_shard(F.col(k), F.col(k2), cuts).alias(s), sub(k, k2).alias(part)).groupBy(s, part).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(s).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # beyond the bound of a broadcast, rows lie by shard and sub-range for their numbers already
    firsts = small_side(counts.select(s, part, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(first)))
    rows = keyed.withColumn(s, _shard(F.col(k), F.col(k2), cuts)).withColumn(part, sub(k, k2))
    order = Window.partitionBy(s, part).orderBy(k, k2, *tie)
    numbered = rows.withColumn(n, F.row_number().over(order) - 1)
    return numbered.join(firsts, [s, part]).withColumn(shard, F.col(s)).withColumn(slot, (F.col(first) + F.col(n)).cast("long")).drop(s, n, first, part)


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (from 0, without gaps)."""
    t, i = F.col(text), F.col(id_col)
    slim = settle(docs.select(i.alias("doc_id"), size(t).alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), text_key(t).alias("k"), id_key(i).alias("k2")))
    return place(slim, splitters(slim, shards, tolerance), slim, "k", "k2", ["doc_id", "size"], "shard", "slot").drop("k", "k2")


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text: str = "text", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """docs with their shard and slot; whole rows pass one exchange, into their places. A name that docs has gets an underscore."""
    t, i = F.col(text), F.col(id_col)
    shard, slot, k, k2 = fresh(docs, shard, slot, "gl_k", "gl_k2")
    slim = settle(docs.select(size(t).alias("size"), text_key(t).alias("k"), id_key(i).alias("k2")))
    named = slim.withColumnRenamed("k", k).withColumnRenamed("k2", k2)
    out = place(docs.withColumn(k, text_key(t)).withColumn(k2, id_key(i)), splitters(slim, shards, tolerance), named, k, k2, [F.col(id_col)], shard, slot)
    return out.drop(k, k2)


def query(spark, sf_dir: str) -> DataFrame:
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
