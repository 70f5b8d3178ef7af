"""Quality rules with adaptive thresholds.

Each document gets ratios of its own text. The ratios of every (language, source) group are summed into mergeable
quantile sketches: counts by logarithmic bucket, so a quantile is known to one percent of its value, sketches merge by
adding counts, and the result does not depend on the order of rows or on a lost executor. A group's fence is its upper
quartile plus REACH times its spread: the distance of its quartiles and what one occurrence adds to its median document,
so groups in which a sign hardly occurs have a spread of their own too. No fence is fixed beforehand. A group's quantiles are
drawn towards those of its language, and these towards those of everything, by the weight of PRIOR documents, so that
small groups follow the merged sketches and large ones their own. A document outside a fence goes.

Edge cases. Null or empty text: no words, so ``base_failed``. Null language or source: groups of their own. Repeated
rows: each is judged, alike. An empty table: an empty result. Other columns: kept by ``filter_documents``, whatever
their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm._common import CONTINUATION, each, fresh, own, settle, small_side

#: Growth of the sketch's buckets: a value is known within one percent.
GAMMA = 1.02
#: Values below this share the sketch's zero bucket.
TINY = 1e-4
#: Documents that the merged sketch counts as in a group's own.
PRIOR = 20
#: Spreads above the upper quartile at which a fence stands.
REACH = 12
#: Ratio: what it is a share of.
RATIOS = {"symbol_ratio": "word_chars", "dup_line_ratio": "n_lines", "upper_ratio": "word_chars", "bang_ratio": "word_chars"}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_bang")
_SYMBOLS, _UPPER, _BANG = b"#*$%&|<>", bytes(range(65, 91)), b"!"
_FEATURES = pa.struct([(n, pa.int64()) for n in BASE + MORE])
_SCHEMA = "struct<" + ",".join(f"{n}:bigint" for n in BASE + MORE) + ">"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that the text has twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def measure(text: bytes | None) -> tuple[int, ...]:
    """The counts of BASE and MORE of one whole text."""
    words = (text or b"").split()
    if not words:
        return (0,) * len(BASE + MORE)
    solid = b"".join(words)
    seen: set = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    without = lambda drop: len(solid) - len(solid.translate(None, drop))
    return (len(words), len(solid.translate(None, CONTINUATION)), without(_SYMBOLS), dup, repeated_words(words), lines, without(_UPPER), without(_BANG))


def _measures():
    @F.arrow_udf(_SCHEMA)
    def measures(texts: pa.Array) -> pa.Array:
        rows = [measure(t) for t in each(texts)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(BASE + MORE)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_FEATURES))

    return measures.asNondeterministic()  # else a filter on the counts is moved below them and counts everything again


def features(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """docs with a struct of the counts in column ``into``; only the text goes to Python."""
    ship(docs.sparkSession)
    return docs.withColumn(into, _measures()(F.col(text).cast("binary")))


def _ratios(f: str) -> dict:
    counted = {"symbol_ratio": "n_symbols", "dup_line_ratio": "n_dup_lines", "upper_ratio": "n_upper", "bang_ratio": "n_bang"}
    return {k: F.when(F.col(f"{f}.{d}") > 0, F.col(f"{f}.{counted[k]}") / F.col(f"{f}.{d}")).otherwise(F.lit(0.0)) for k, d in RATIOS.items()}


def sketches(measured: DataFrame, f: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, ratio, bucket, n): the sketches of all groups, of ratios and of what they are shares of.

    Documents without enough words are left out: they fail anyway.
    """
    v = F.col("r.v")
    held = _ratios(f) | {d: F.col(f"{f}.{d}").cast("double") for d in sorted(set(RATIOS.values()))}
    return (
        measured.where(F.col(f"{f}.n_words") >= 10)
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), c.alias("v")) for k, c in held.items()])).alias("r"))
        .select("lang", "source", "r.ratio", F.when(v < TINY, F.lit(None)).otherwise(F.ceil(F.log(v) / math.log(GAMMA))).cast("int").alias("bucket"))
        .groupBy("lang", "source", "ratio", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, ratio, upper): the fences of each group."""
    sketch.createOrReplaceTempView("gl_sketch")
    value = f"coalesce(2 * power({GAMMA}D, min(CASE WHEN cum >= {{q}} * total THEN bucket END)) / ({GAMMA}D + 1), 0D)"
    # the zero bucket is null and sorts first; a quantile that falls in it is zero
    quantile = lambda q: f"CASE WHEN max(CASE WHEN bucket IS NULL THEN cum END) >= {q} * max(total) THEN 0D ELSE {value.format(q=q)} END"
    drawn = lambda q: f"(a.total * a.{q} + {PRIOR} * ((b.total * b.{q} + {PRIOR} * c.{q}) / (b.total + {PRIOR}))) / (a.total + {PRIOR}) AS {q}"
    shares = " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in RATIOS.items())
    return sketch.sparkSession.sql(f"""
        WITH merged AS (
          SELECT 0 AS level, lang, source, ratio, bucket, n FROM gl_sketch
          UNION ALL SELECT 1, lang, NULL, ratio, bucket, sum(n) FROM gl_sketch GROUP BY lang, ratio, bucket
          UNION ALL SELECT 2, NULL, NULL, ratio, bucket, sum(n) FROM gl_sketch GROUP BY ratio, bucket),
        ranked AS (
          SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket NULLS FIRST) AS cum,
                 sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM merged),
        quartiles AS (
          SELECT level, lang, source, ratio, max(total) AS total, {quantile(0.25)} AS q1, {quantile(0.5)} AS q2, {quantile(0.75)} AS q3
          FROM ranked GROUP BY level, lang, source, ratio),
        held AS (
          SELECT a.lang, a.source, a.ratio, {drawn("q1")}, {drawn("q2")}, {drawn("q3")}
          FROM quartiles a JOIN quartiles b ON b.level = 1 AND a.lang <=> b.lang AND a.ratio = b.ratio
               JOIN quartiles c ON c.level = 2 AND a.ratio = c.ratio
          WHERE a.level = 0)
        SELECT r.lang, r.source, r.ratio, r.q3 + {REACH} * ((r.q3 - r.q1) + 1 / d.q2) AS upper
        FROM held r JOIN held d ON d.ratio = CASE r.ratio {shares} END AND r.lang <=> d.lang AND r.source <=> d.source""")


def _verdicts(measured: DataFrame, f: str, fences: DataFrame, lang: str, source: str, failed: str, kept: str) -> DataFrame:
    """measured with the base verdict and the final one; each row is judged by what it holds itself."""
    l, s, lim = fresh(measured, "gl_l", "gl_s", "gl_lim")
    limits = fences.groupBy(F.col("lang").alias(l), F.col("source").alias(s)).agg(F.map_from_entries(F.collect_list(F.struct("ratio", "upper"))).alias(lim))
    joined = measured.join(small_side(limits), F.col(lang).eqNullSafe(F.col(l)) & F.col(source).eqNullSafe(F.col(s)), "left")
    within = F.lit(True)
    for k, c in _ratios(f).items():
        within = within & (c <= F.coalesce(F.col(lim)[k], F.lit(float("inf"))))
    base = (F.col(f"{f}.n_words") < 10) | (100 * F.col(f"{f}.n_repeat_words") > 20 * F.col(f"{f}.n_words"))
    return joined.withColumn(failed, base).withColumn(kept, ~base & within).drop(l, s, lim)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: its id, counts, ``base_failed`` and ``kept``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = settle(features(slim, "f").drop("text"))
    fences = thresholds(settle(sketches(measured, "f")))
    return _verdicts(measured, "f", fences, "lang", "source", "base_failed", "kept").select("doc_id", *[F.col(f"f.{n}") for n in BASE], "base_failed", "kept")


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Texts are read twice and never shuffled."""
    f, failed, kept = fresh(docs, "gl_f", "gl_failed", "gl_kept")
    slim = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    fences = thresholds(settle(sketches(features(slim, "f"), "f")))
    return _verdicts(features(docs, f, text), f, fences, lang, source, failed, kept).where(F.col(kept)).select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
