"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A document's fingerprint is the majority vote of the hashes of its 3-word shingles. Two fingerprints that differ in at
most ``BITS`` = 2 bits differ in at most two of their eight bytes, so they share at least six positional bytes: the
count that a pair is guaranteed to reach. A posting list by one positional byte would hold 1 / 256 of the corpus, so the
index is kept by five positional bytes at a time: eleven choices of three positions to leave out cover every two that may
differ. Inside a list the shared positional bytes of each pair are tallied, pairs that stay below the six are dropped, and
the rest are verified bit by bit. In a list of over ``PAIRS`` fingerprints (three free bytes: 2^24 at most) each looks up
the values within its reach instead. A list gives a spanning forest of its links, fewer than it has members.

Copies share a fingerprint, and each distinct fingerprint enters the index once, whatever its number of documents.
Components come from alternating large-star and small-star steps over the links; each round's table is written to the
shared folder and read again.

``drop_duplicates`` also finds copies whose edits move more bits than that: all pairs that share ``SIMILARITY`` = 0.8 of
their 5-word shingles. Shingles stand in one order by hash, those that a sample finds frequent apart from the rest. Of a
set of n no more than a fifth is missing in a partner, so among a few of its first shingles one is shared: it emits so
many that all of them are missing with a chance of ``RISK`` = 1e-12 at most over the hash, or a fifth and one more where
that is fewer and no chance is left (``risk=0`` emits these always). A set with fewer than 0.45 of its shingles outside the frequent
ones emits from these, one with 0.3 or more from the rest: two partners always meet in one of the two, since their shares
differ by less. Equal sets are linked first and enter as one. Pairs under a key are dropped only by bounds that no pair at
the least similarity can break (places of the first common key, sizes, differing bits of a parity bitmap) or if links
join them already, and the rest are verified by their very shingles. So that groups of any make are linked cheaply,
members are first compared with four centres of their key: those that hold most frequent shingles, then those whose keys
have most members, as an original does among its edited copies. The second and last round compares all pairs that are
still apart, so no centre hides a link. No list is gathered.

Edge cases. Null text, empty text, text without words: fingerprint zero, linked like any other. One or two words: one
shingle. Null ids: such documents get a component like others; a component of null ids only has a null id. Repeated
rows: one result each. Ties: the smallest id names a component and stays in ``drop_duplicates``. Very long texts are
hashed in pieces. Only the named columns are read; ``drop_duplicates`` keeps every other column, whatever its name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm._common import WORD, Scratch, each, fresh, own, settle, small_side

SHINGLE, SEED, BITS = 3, 42, 2
#: Positional bytes that two fingerprints share at least if they differ in BITS bits.
SHARED = 8 - BITS
#: The positions that each choice of the index leaves free: every two of the eight are in one of these.
FREE = ((0, 1, 6), (0, 2, 5), (0, 3, 4), (0, 5, 7), (1, 2, 4), (1, 2, 7), (1, 3, 5), (2, 3, 6), (2, 4, 7), (3, 6, 7), (4, 5, 6))
#: Fingerprints a task spreads over the index.
SPREAD_ROWS = 20_000
#: Up to so many members a list is tallied in pairs; beyond, by lookup.
PAIRS = 256
#: Shingles hashed at once, so that memory does not follow a text's length.
PIECE = 1 << 16
#: What near copies share of their shingles of NEAR_SHINGLE words.
SIMILARITY, NEAR_SHINGLE = 0.8, 5
#: The chance that a pair at SIMILARITY shares none of its emitted shingles.
RISK = 1e-12
#: Sets with this share of shingles outside the frequent ones emit such; those under the second emit frequent ones.
MOSTLY_RARE, MOSTLY_OFTEN = 0.3, 0.45
#: Bits of a shingle set's parity bitmap, kept in longs.
BITMAP = 1024
#: Centres of a key by round; the last round compares all pairs that are still apart.
ROUNDS = (4, None)
#: A shingle is called frequent if SAMPLE_LEAST of about SAMPLE texts hold it; so many of them at most.
SAMPLE, SAMPLE_LEAST, FREQUENT = 10_000, 5, 50_000
#: A-Z in lower case, white space as space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def words_at(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """A whole text's words in lower case with one space between, and the place of each word and of the end's next."""
    plain = (text or b"").translate(_PLAIN).strip(b" ")
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    if not plain:
        return plain, np.zeros(0, np.int64)
    return plain, np.concatenate(([0], np.flatnonzero(np.frombuffer(plain, np.uint8) == 32) + 1, [len(plain) + 1]))


def hashes_of(plain: bytes, at: np.ndarray, shingle: int, seed: int = 0) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, PIECE by PIECE; of fewer words the whole sequence."""
    k = max(1, min(shingle, len(at) - 1))
    starts, ends, one = at[: len(at) - k], at[k:] - 1, xxhash.xxh64_intdigest
    for i in range(0, len(starts), PIECE):
        pieces = [plain[s:e] for s, e in zip(starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist(), strict=True)]
        yield np.fromiter(map(one, pieces, repeat(seed)), np.uint64, len(pieces))


def fingerprint(words: tuple[bytes, np.ndarray], shingle: int = SHINGLE) -> int:
    """The SimHash of one whole text, given by ``words_at``, as a signed 64-bit number."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in hashes_of(*words, shingle, SEED):
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, into: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a long in column ``into``; only the text goes to Python."""
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(words_at(t), shingle) for t in each(texts)], pa.int64())

    return docs.withColumn(into, prints(F.col(text).cast("binary")))


def _forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints (int64) of one posting list."""
    u = np.unique(members).view(np.uint64)
    root = list(range(len(u)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, signed = [], u.view(np.int64)

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(signed[i]), int(signed[j])))

    if len(u) <= PAIRS:
        x = u[:, None] ^ u[None, :]
        shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
        i, j = np.nonzero(np.triu(shared >= 8 - bits, 1))
        near = np.bitwise_count(x[i, j]) <= bits
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            link(a, b)
        return out
    free = int(np.bitwise_or.reduce(u ^ u[0]))
    flips = [1 << b for b in range(64) if free >> b & 1]
    for flip in (f for n in range(1, bits + 1) for f in combinations(flips, n)):  # at most 24 free bits: 300 masks, each one sorted lookup
        other = u ^ np.uint64(sum(flip))
        at = np.minimum(np.searchsorted(u, other), len(u) - 1)
        hit = np.nonzero((u[at] == other) & (u < other))[0]
        for a, b in zip(hit.tolist(), at[hit].tolist(), strict=True):
            link(a, b)
    return out


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links that connect what is within reach. distinct: one row per fingerprint, settled."""
    spark = distinct.sparkSession
    ship(spark)
    keys = []
    for i, free in enumerate(FREE):
        m = sum(0xFF << 8 * byte for byte in range(8) if byte not in free)
        keys.append(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bytes")))
    # a row becomes eleven: dealt out by what comes of them, not by what they weigh
    spread = distinct.select(F.col(fp).alias("fp")).repartition(-(-distinct.count() // SPREAD_ROWS) or 1)
    lists = spread.select("fp", F.explode(F.array(*keys)).alias("k")).groupBy("k.choice", "k.bytes").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)

    def forests(batches):
        for batch in batches:
            found = [p for m in each(batch.column(0)) for p in _forest(np.array(m, np.int64), BITS)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lists.select("members").mapInArrow(forests, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable by edges (a, b). Nodes without an edge are absent.

    Large-star then small-star steps until only stars are left; each links nodes to smaller ones, through joins and
    minima only, so that no node's neighbours meet in one group.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        before = scratch.n
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # kept, a minimum's side of the join is a plain one, so Spark can split a hub's partition on the other
        low = scratch.side(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = scratch.side(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        stars = not low.where("n > 1").limit(1).count() and not large.join(low.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if stars:
            scratch.forget(before, scratch.n - 2)
            return large.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(large.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = scratch.keep(small)
        scratch.forget(before, scratch.n - 1)


def grouped(printed: DataFrame) -> DataFrame:
    """(fp, first_id, root) of every distinct fingerprint, from (doc_id, fp), settled."""
    firsts = settle(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(firsts))
    return settle(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ``fp`` (signed long) and ``component_id``."""
    printed = settle(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "fp").drop("text"))
    named = grouped(printed)
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return printed.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(words: tuple[bytes, np.ndarray], shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The set of a text's word shingles, hashed and sorted; of fewer words the whole sequence, of none one of its own."""
    found = list(hashes_of(*words, shingle)) or [np.zeros(1, np.uint64)]
    return np.unique(np.concatenate(found).view(np.int64))


def apart(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles outside the frequent ones and among them."""
    late = np.zeros(len(hashes), bool)
    if len(frequent):  # not isin, which would sort all of frequent for each text
        late = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    return hashes[~late], hashes[late]


def first_keys(rare: np.ndarray, often: np.ndarray, similarity: float = SIMILARITY, risk: float = RISK) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of either kind that a set emits: a partner shares one of the first or one of the second, but for risk."""
    n = len(rare) + len(often)
    missing = n - math.ceil(similarity * n - 1e-9)

    def some(part: np.ndarray) -> np.ndarray:
        enough = missing + 1
        if 0 < missing < len(part) and risk:
            enough = min(enough, math.ceil(math.log(risk) / math.log(missing / len(part))))
        return part[:enough]

    return some(rare) if len(rare) >= MOSTLY_RARE * n else rare[:0], some(often) if len(rare) < MOSTLY_OFTEN * n else often[:0]


def bitmap(hashes: np.ndarray) -> list[int]:
    """Parities of the set's hashes by remainder: two bitmaps differ in no more bits than their sets in members."""
    odd = np.bincount(hashes & (BITMAP - 1), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes of shingles that many texts of a sample hold, sorted. texts: (node, text).

    They only shorten the lists: whatever is called frequent, no pair is lost. The sample's bound is SAMPLE texts or so,
    and FREQUENT hashes reach the driver at most.
    """
    n = texts.count()

    @F.arrow_udf("array<long>")
    def shingles(found: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(words_at(t)) for t in each(found)], pa.list_(pa.int64()))

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(-(-n // SAMPLE) or 1)) == 0)
    counted = some.select(F.explode(shingles(F.col("text").cast("binary"))).alias("h")).groupBy("h").count().where(F.col("count") >= SAMPLE_LEAST)
    return np.sort(np.array([r.h for r in counted.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()], np.int64))


def near_pairs(shared: DataFrame, groups: DataFrame, centres: int | None, similarity: float, scratch: Scratch) -> DataFrame:
    """(x, y): pairs of a key, not of one group yet, that no bound keeps from ``similarity``.

    shared: (k, r, i, n, share, pop, b0, b1, ...): keys of several sets, the key's place in the set, the set's size, its
    share of frequent shingles, the members of a key of it on average, its bitmap; groups: (node, root). With centres, members are compared with so many of their key, else with each other.
    """
    known = scratch.keep(shared.join(groups.withColumnRenamed("node", "r"), "r", "left").withColumn("g", F.coalesce("root", "r")).drop("root"))
    several = scratch.side(known.groupBy("k").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("k"))
    known = scratch.keep(known.join(several, "k", "left_semi"))
    other = known
    if centres:
        part = F.pmod(F.xxhash64("r"), F.lit(centres))
        other = scratch.keep(known.groupBy("k", part.alias("part")).agg(F.max_by(F.struct(*own(known)), F.struct("share", "pop", "r")).alias("c")).select("c.*"))
    longs = [f"b{j}" for j in range(BITMAP // 64)]
    x, y = (side.select("k", *[F.col(c).alias(f"{name}_{c}") for c in ("r", "g", "i", "n", *longs)]) for name, side in (("x", known), ("y", other)))
    both = F.col("x_n") + F.col("y_n")
    differ = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in longs), F.lit(0))
    least, most = similarity / (1 + similarity) * both - 1e-6, (1 - similarity) / (1 + similarity) * both + 1e-6
    # under their first common key, all before it are in one set only and all that they share begins there
    first = (F.col("x_i") + F.col("y_i") <= most) & (F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i")) >= least)
    own_order = F.col("x_r") != F.col("y_r") if centres else F.col("x_r") > F.col("y_r")
    pairs = x.join(y, "k").where(own_order & (F.col("x_g") != F.col("y_g")) & first & (differ <= most))
    return scratch.keep(pairs.select(F.greatest("x_r", "y_r").alias("x"), F.least("x_r", "y_r").alias("y")).distinct())


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): the pairs (x, y) that share ``similarity`` of their shingles. texts: (node, text)."""

    @F.arrow_udf("array<long>")
    def shingles(found: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(words_at(t)) for t in each(found)], pa.list_(pa.int64()))

    wanted = scratch.side(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct())
    held = scratch.keep(texts.join(wanted, "node", "left_semi").select("node", shingles(F.col("text").cast("binary")).alias("s")))
    both = pairs.join(held.select(F.col("node").alias("x"), F.col("s").alias("x_s")), "x").join(held.select(F.col("node").alias("y"), F.col("s").alias("y_s")), "y")
    shared = F.size(F.array_intersect("x_s", "y_s"))
    return scratch.keep(both.where(shared >= similarity * (F.size("x_s") + F.size("y_s") - shared)).select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_groups(nodes: DataFrame, texts: DataFrame, links: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): components of links (a, b) and of all pairs of nodes that share ``similarity`` of their shingles.

    nodes: (r, sig, n, common, rare, often, bits), settled; texts: (node, text), one row per node.
    """
    scratch = Scratch(nodes.sparkSession, "near")
    firsts = scratch.keep(nodes.groupBy("sig").agg(F.min("r").alias("lo")))
    same = nodes.select("r", "sig").join(firsts, "sig").where("r <> lo").select(F.col("r").alias("a"), F.col("lo").alias("b"))
    groups = components(links.union(same))
    reps = nodes.join(scratch.side(firsts.select(F.col("lo").alias("r"))), "r", "left_semi")
    placed = lambda c: F.transform(c, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    held = scratch.keep(reps.select("r", "n", F.explode(F.concat(placed("rare"), placed("often"))).alias("e")).select("e.k", "r", "e.i", "n"))
    several = scratch.side(held.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    held = scratch.keep(held.join(several, "k"))
    emitted = F.size("rare") + F.size("often")
    more = nodes.select("r", (F.col("common") / F.col("n")).alias("share"), emitted.alias("m"), *[F.col("bits")[j].alias(f"b{j}") for j in range(BITMAP // 64)])
    told = held.groupBy("r").agg(F.sum("c").alias("cs")).join(more, "r").withColumn("pop", F.col("cs") / F.col("m")).drop("cs", "m")
    shared = scratch.keep(held.drop("c").join(told, "r"))
    for centres in ROUNDS:
        pairs = near_pairs(shared, groups, centres, similarity, scratch)
        if pairs.limit(1).count():
            stars = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            groups = components(stars.union(verified(pairs, texts, similarity, scratch)))
    scratch.forget(1, scratch.n)
    return groups


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, risk: float = RISK) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest id, nulls last, with its columns.

    A group holds what fingerprints link and what shares ``similarity`` of its shingles. Texts are shuffled once, by
    their hash, copies merged before that; the rest is read from that stored table and joined by number.
    """
    spark = docs.sparkSession
    ship(spark)
    node, words = fresh(docs, "gl_node", "gl_words")
    has = F.when(F.col(text).rlike(WORD), F.col(text)).otherwise("")
    smallest = F.min_by(F.struct(*own(docs)), F.struct(F.col(id_col).isNull(), F.col(id_col))).alias("row")
    stored = Scratch(spark, "dedup").keep(docs.groupBy(F.md5(has.cast("binary")).alias(words)).agg(smallest).select("row.*", F.monotonically_increasing_id().alias(node)))

    texts = stored.select(F.col(node).alias("node"), F.col(text).alias("text"))
    frequent = frequent_shingles(texts)

    @F.arrow_udf("struct<fp:bigint,sig:binary,n:int,common:int,rare:array<bigint>,often:array<bigint>,bits:array<bigint>>")
    def told(found: pa.Array) -> pa.Array:
        rows = []
        for t in each(found):
            s = shingle_hashes(at := words_at(t))
            kinds = apart(s, frequent)
            rows.append((fingerprint(at), xxhash.xxh3_128_digest(s.tobytes()), len(s), len(kinds[1]), *first_keys(*kinds, similarity, risk), bitmap(s)))
        longs = pa.list_(pa.int64())
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), longs, longs, longs)
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=["fp", "sig", "n", "common", "rare", "often", "bits"])

    nodes = settle(stored.select(F.col(node).alias("r"), F.col(id_col).alias("id"), told(F.col(text).cast("binary")).alias("p")).select("r", "id", "p.*"))
    firsts = settle(nodes.groupBy("fp").agg(F.min("r").alias("lo")))
    of = lambda n: firsts.select(F.col("fp").alias(n), F.col("lo").alias(f"{n}_r"))
    linked = links(firsts.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_r").alias("a"), F.col("b_r").alias("b"))
    alike = nodes.join(firsts, "fp").where("r <> lo").select(F.col("r").alias("a"), F.col("lo").alias("b"))
    groups = near_groups(nodes, texts, alike.union(linked), similarity)
    members = settle(nodes.select("r", "id").join(groups.withColumnRenamed("node", "r"), "r"))
    stay = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("least")).select("least.r")
    gone = small_side(members.select("r").join(settle(stay), "r", "left_anti").select(F.col("r").alias(node)))
    return stored.join(gone, node, "left_anti").select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
