"""The queries of this subpackage and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: (module of this subpackage, its function).
NAMES = {
    "op1_quality_rules": "quality_rules",
    "op2_secret_scan": "secret_scan",
    "op3_mix_sources": "mix_sources",
    "op4_simhash_dedup": "simhash_dedup",
    "op5_decontaminate": "decontaminate",
    "op6_quality_classifier": "quality_classifier",
    "op7_token_counts": "token_counts",
    "op8_histogram_shards": "histogram_shards",
    "op9_toxicity": "toxicity",
    "op10_quote_linking": "quote_linking",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"graphloom.llm.{module}").query for name, module in NAMES.items()}


_WORD = r"[^\x20\x09-\x0D]+"

#: Sizes, targets by filling to caps in the order of cap / weight, and thresholds as a running sum over hashes.
_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(text, '~')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             2 * source_size::DOUBLE AS top FROM s),
f AS (SELECT *, top / w AS turn,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
g AS (SELECT *, (SELECT arg_min(level, turn) FROM f x WHERE x.level < x.turn) AS share FROM f),
t AS (SELECT source, source_size, CASE WHEN level >= turn OR share IS NULL THEN top ELSE least(top, share * w) END AS target FROM g),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(size) OVER (PARTITION BY d.source, h) AS here
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * cum - here <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def _rules() -> str:
    from graphloom.llm.quality_rules import GAMMA, PRIOR, RATIOS, REACH, TINY

    shares = " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in RATIOS.items())
    value = lambda q: f"CASE WHEN b{q} = -99999 THEN 0 ELSE 2 * pow({GAMMA}, b{q}) / ({GAMMA} + 1) END AS q{q}"
    drawn = lambda q: f"(a.total * a.q{q} + {PRIOR} * ((b.total * b.q{q} + {PRIOR} * z.q{q}) / (b.total + {PRIOR}))) / (a.total + {PRIOR}) AS q{q}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT i, unnest(regexp_extract_all(text, '{_WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS p FROM d),
win AS (SELECT i, p, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10) || lead(w, 3) OVER o || chr(10) || lead(w, 4) OVER o AS g
        FROM tok WINDOW o AS (PARTITION BY i ORDER BY p)),
rep AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, g) AS c FROM win WHERE g IS NOT NULL) WHERE c >= 2),
cov AS (SELECT i, count(DISTINCT q) AS n_repeat_words FROM (SELECT i, p + unnest([0, 1, 2, 3, 4]) AS q FROM rep) GROUP BY i),
lines AS (SELECT i, sum(c - 1) AS n_dup_lines, sum(c) AS n_lines FROM (
            SELECT i, l, count(*) AS c FROM (SELECT i, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY i, l) GROUP BY i),
f AS (SELECT d.i, doc_id, lang, source, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bang
      FROM d LEFT JOIN cov USING (i) LEFT JOIN lines USING (i)),
v AS (SELECT i, n_words, lang, source, unnest(['symbol_ratio', 'dup_line_ratio', 'upper_ratio', 'bang_ratio']) AS ratio,
             unnest([CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END,
                     CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END, CASE WHEN word_chars > 0 THEN n_bang / word_chars ELSE 0 END]::DOUBLE[]) AS x FROM f),
y AS (SELECT n_words, lang, source, ratio, x FROM v
      UNION ALL SELECT n_words, lang, source, unnest(['word_chars', 'n_lines']), unnest([word_chars, n_lines]::DOUBLE[]) FROM f),
k AS (SELECT lang, source, ratio, CASE WHEN x < {TINY} THEN -99999 ELSE ceil(ln(x) / ln({GAMMA}))::INT END AS bucket, count(*) AS n FROM y WHERE n_words >= 10 GROUP BY ALL),
m AS (SELECT 0 AS level, lang, source, ratio, bucket, n FROM k
      UNION ALL SELECT 1, lang, NULL, ratio, bucket, sum(n) FROM k GROUP BY lang, ratio, bucket
      UNION ALL SELECT 2, NULL, NULL, ratio, bucket, sum(n) FROM k GROUP BY ratio, bucket),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM m),
q AS (SELECT level, lang, source, ratio, max(total) AS total, min(CASE WHEN cum >= 0.25 * total THEN bucket END) AS b1, min(CASE WHEN cum >= 0.5 * total THEN bucket END) AS b2, min(CASE WHEN cum >= 0.75 * total THEN bucket END) AS b3
      FROM c GROUP BY level, lang, source, ratio),
e AS (SELECT *, {value(1)}, {value(2)}, {value(3)} FROM q),
u AS (SELECT a.lang, a.source, a.ratio, {drawn(1)}, {drawn(2)}, {drawn(3)}
      FROM e a JOIN e b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.ratio = b.ratio JOIN e z ON z.level = 2 AND a.ratio = z.ratio WHERE a.level = 0),
t AS (SELECT r.lang, r.source, r.ratio, r.q3 + {REACH} * ((r.q3 - r.q1) + 1 / w.q2) AS upper
      FROM u r JOIN u w ON w.ratio = CASE r.ratio {shares} END AND r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source),
bad AS (SELECT DISTINCT i FROM v JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.ratio = t.ratio WHERE x > upper)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND i NOT IN (SELECT i FROM bad) AS kept
FROM f
"""


def _secrets() -> str:
    from graphloom.llm.secret_scan import KINDS, WIDE, WIDE_REPOS

    def matches(order: int, kind: str) -> str:
        pattern, group, least = KINDS[kind]
        if pattern.startswith("(?i)"):  # letters of ASCII only
            pattern = "".join(f"[{c.upper()}{c}]" if c.islower() and not inside else c for c, inside in _outside_brackets(pattern[4:]))
        pattern = pattern.replace("'", "''")
        return f"""SELECT i, {order} AS ord, '{kind}' AS kind, n, val, starts AS start, starts + length(whole) AS stop FROM (
  SELECT *, (sum(length(gap)) OVER w + coalesce(sum(length(whole)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS starts FROM (
    SELECT i, unnest(regexp_extract_all(t, '{pattern}', 0)) AS whole, unnest(regexp_extract_all(t, '{pattern}', {group})) AS val,
           unnest(list_slice(regexp_split_to_array(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}', 0)))) AS gap,
           generate_subscripts(regexp_extract_all(t, '{pattern}', 0), 1) AS n FROM d)
  WINDOW w AS (PARTITION BY i ORDER BY n)) WHERE length(val) >= {least}"""

    base = " UNION ALL ".join(matches(o, k) for o, k in enumerate(KINDS) if k != "opaque")
    order = list(KINDS).index("opaque")
    one = lambda k: f"count(*) FILTER (WHERE kind = '{k}')"
    said = "kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({base}),
open AS (SELECT * FROM ({matches(order, "opaque")}) o WHERE regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]')
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.i = o.i AND b.start < o.stop AND o.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM open),
-- a repository, here a document, counts once for each owner
owned AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, chr(0)))) AS repos FROM every JOIN d USING (i) GROUP BY val),
judged AS (SELECT every.*, owners, repos, owners < {WIDE} AND repos < {WIDE_REPOS} AS live FROM every JOIN owned USING (val)),
kept AS (SELECT * FROM judged WHERE kind <> 'opaque' OR live),
g AS (SELECT i, {one("assign")} AS n_assign, {one("access")} AS n_access, {one("hex")} AS n_hex, string_agg({said}) FILTER (WHERE kind <> 'opaque') AS base, string_agg({said}) AS spans,
             count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example, max(owners) AS max_owners, max(repos) AS max_repos FROM kept GROUP BY i)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos FROM d LEFT JOIN g USING (i)
"""


def _outside_brackets(pattern: str):
    """Each character and whether it stands inside a class or an escape."""
    inside, escape = False, 0
    for c in pattern:
        if c == "[":
            inside = True
        if c == "\\":
            escape = 4  # \x20
        yield c, inside or escape > 0
        escape = max(0, escape - 1)
        if c == "]":
            inside = False


def _shards() -> str:
    """The refined histograms as one chain of WITH parts by level, once over texts and once inside texts larger than a shard."""
    from graphloom.llm.histogram_shards import DIGIT, FRAME, LEVELS, SHARDS, SUB_ID, SUB_TEXT, TOLERANCE

    def chain(name: str, least: str) -> str:
        """name_rows (grp, key, size) and name_goals (grp, i, goal) to name_cuts (grp, key, goal, start, own)."""
        parts = [f"{name}_open0 AS (SELECT grp, i, goal, 0::BIGINT AS prefix, 0::BIGINT AS lft FROM {name}_goals)"]
        for level in range(LEVELS):
            shift = DIGIT * (LEVELS - 1 - level)
            parts.append(f"""{name}_sums{level} AS (
  SELECT *, (sum(bytes) OVER (PARTITION BY grp, prefix ORDER BY bucket))::BIGINT AS cum
  FROM (SELECT grp, key >> {shift + DIGIT} AS prefix, key >> {shift} AS bucket, sum(size)::BIGINT AS bytes, min(key) AS lo, max(key) AS hi FROM {name}_rows GROUP BY ALL)),
{name}_at{level} AS (
  SELECT o.grp, o.i, o.goal, o.prefix, o.lft, coalesce(max(o.lft + s.cum), o.lft) AS total,
         arg_min({{'bucket': s.bucket, 'start': o.lft + s.cum - s.bytes, 'stop': o.lft + s.cum, 'bytes': s.bytes, 'lo': s.lo, 'hi': s.hi}}, s.bucket) FILTER (WHERE o.lft + s.cum >= o.goal) AS b
  FROM {name}_open{level} o LEFT JOIN {name}_sums{level} s ON o.grp = s.grp AND o.prefix = s.prefix GROUP BY o.grp, o.i, o.goal, o.prefix, o.lft),
{name}_cut{level} AS (
  SELECT grp, i, goal, b, CASE
    WHEN b IS NULL THEN {{'key': (prefix + 1) << {shift + DIGIT}, 'start': total, 'own': 0::BIGINT}}
    WHEN b.stop - goal <= slack THEN {{'key': (b.bucket + 1) << {shift}, 'start': b.stop, 'own': 0::BIGINT}}
    WHEN goal - b.start <= slack THEN {{'key': b.bucket << {shift}, 'start': b.start, 'own': 0::BIGINT}}
    WHEN b.lo = b.hi AND b.bytes > {least} THEN {{'key': b.lo, 'start': b.start, 'own': b.bytes}}
    WHEN b.lo = b.hi AND b.stop - goal <= goal - b.start THEN {{'key': b.lo + 1, 'start': b.stop, 'own': 0::BIGINT}}
    WHEN b.lo = b.hi THEN {{'key': b.lo, 'start': b.start, 'own': 0::BIGINT}} END AS cut
  FROM {name}_at{level}, whole)""")
            if level < LEVELS - 1:
                parts.append(f"{name}_open{level + 1} AS (SELECT grp, i, goal, b.bucket AS prefix, b.start AS lft FROM {name}_cut{level} WHERE cut IS NULL)")
        found = " UNION ALL ".join(f"SELECT grp, goal, cut.key AS key, cut.start AS start, cut.own AS own FROM {name}_cut{level} WHERE cut IS NOT NULL" for level in range(LEVELS))
        return ",\n".join([*parts, f"{name}_cuts AS ({found})"])

    hashed = lambda said: f"('0x' || substr(md5({said}), 1, 15))::BIGINT"
    return f"""
WITH d AS (
  SELECT doc_id, text, coalesce(octet_length(encode(text)), 0)::BIGINT + {FRAME} AS size,
         {hashed("coalesce('=' || text, '~')")} AS k, {hashed("coalesce(doc_id::VARCHAR, '~')")} AS k2 FROM documents),
whole AS (SELECT share, {TOLERANCE}::DOUBLE * share AS slack FROM (SELECT coalesce(sum(size), 0)::DOUBLE / {SHARDS} AS share FROM d)),
texts_rows AS (SELECT 0::BIGINT AS grp, k AS key, size FROM d),
texts_goals AS (SELECT 0::BIGINT AS grp, i, share * i AS goal FROM whole, range(1, {SHARDS}) r(i)),
{chain("texts", "share")},
ids_goals AS (SELECT key AS grp, row_number() OVER () AS i, goal - start AS goal FROM texts_cuts WHERE own > 0),
ids_rows AS (SELECT k AS grp, k2 AS key, size FROM d WHERE k IN (SELECT grp FROM ids_goals)),
{chain("ids", "'inf'::DOUBLE")},
cuts AS (SELECT list({{'a': a, 'b': b}}) AS cs FROM (SELECT key AS a, 0::BIGINT AS b FROM texts_cuts WHERE own = 0 UNION ALL SELECT grp, key FROM ids_cuts)),
-- CRC-32 by the bytes of a text, with the table of its reflected polynomial
steps AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
hexed AS (SELECT DISTINCT k, hex(encode(coalesce(text, ''))) AS hx FROM d),
crcs AS (SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda p: ('0x' || substr(hx, 2 * p::INT + 1, 2))::BIGINT)),
                                   lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM hexed, steps),
placed AS (SELECT d.*, len(list_filter(cs, lambda c: c.a < k OR (c.a = k AND c.b <= k2)))::INTEGER AS shard FROM d, cuts)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY k >> {60 - SUB_TEXT}, k2 >> {60 - SUB_ID}, k, k2, doc_id NULLS FIRST, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM placed JOIN crcs USING (k)
"""


def oracle_sql() -> dict[str, str]:
    """Registered names: the other queries have no SQL form and are held against brute force in the tests."""
    return {"op1_quality_rules": _rules(), "op2_secret_scan": _secrets(), "op3_mix_sources": _MIX, "op8_histogram_shards": _shards()}
