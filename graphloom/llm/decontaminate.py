"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items and documents are taken as words: letters A-Z lowered, ASCII punctuation as space. The document frequency of every
3-word n-gram of the items is counted over the whole corpus. An item's seeds are its rare n-grams, and always the rarer
half, so that an item that leaked often has seeds too. Seeds join documents to items; the words around seeds of an item
near one diagonal are aligned to the item, words scored 2 for a match, -1 for a mismatch or a gap, unless the passage
holds too few of the item's words for any alignment to do. A passage counts as a copy if its score reaches ``least`` of a
perfect one, so edited and reworded copies count.

The items go to the executors in blocks of bounded bytes; a larger benchmark makes more blocks, each one more pass.

Edge cases. Null or empty texts on either side: no match. Items under MIN_ITEM words count as copied where a document
holds all their words in a row; those of fewer than GRAM words only where it holds nothing else, as any document would
hold them. Repeated items: each id is reported. Repeated documents: each row is judged. Null ids: reported as
null. An empty corpus or benchmark: no match; the filter then keeps everything. Ties: the first best end is reported.
Other columns: kept by ``filter_documents``, whatever their names.
"""

from __future__ import annotations

import string
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm._common import each, table

GRAM = 3
#: Items of fewer words are matched word for word.
MIN_ITEM = 8
#: Share of a perfect alignment's score from which a passage counts as a copy.
LEAST = 0.5
#: An n-gram is rare in up to this many documents, or this share of them.
RARE, RARE_SHARE = 20, 1e-5
#: Bytes of item texts in a block.
BLOCK_BYTES = 16 << 20
_TABLE = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
_FOUND = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_TABLE).split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman with match 2, mismatch and gap -1: the best score and the place in passage where it ends."""
    step = np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, 2, -1), row[1:] - 1, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step  # gaps along the passage
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Block:
    """Items of one block: their words' numbers, n-grams and, once counted, seeds."""

    def __init__(self, texts: list[bytes]) -> None:
        self.number: dict[bytes, int] = {}
        self.items: dict[int, np.ndarray] = {}
        self.whole: dict[tuple[int, ...], list[int]] = {}
        for i, text in enumerate(texts):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if len(ids) >= GRAM:
                self.items[i] = np.array(ids, np.int64)
            elif ids:
                self.whole.setdefault(tuple(ids), []).append(i)
        self.base = len(self.number) + 1
        grams = [self.codes(ids)[1] for ids in self.items.values()]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)

    def codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the n-grams whose words all occur in items."""
        known = ids > 0
        at = np.nonzero(known[:-2] & known[1:-1] & known[2:])[0]
        return at, (ids[at] * self.base + ids[at + 1]) * self.base + ids[at + 2]

    def numbers(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def seen(self, text: bytes | None) -> np.ndarray:
        """Indices of the items' n-grams that a document has."""
        ids = self.numbers(text)
        if len(ids) < GRAM or not len(self.grams):
            return np.zeros(0, np.int64)
        codes = np.unique(self.codes(ids)[1])
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        return at[self.grams[at] == codes]

    def choose(self, frequency: np.ndarray, rare: float) -> None:
        """Keep as seeds each item's rare n-grams and its rarer half."""
        seeds: dict[int, list[tuple[int, int]]] = {}
        for i, ids in self.items.items():
            places, codes = self.codes(ids)
            f = frequency[np.searchsorted(self.grams, codes)]
            for p, c in zip(places[f <= max(rare, np.median(f))].tolist(), codes[f <= max(rare, np.median(f))].tolist(), strict=True):
                seeds.setdefault(c, []).append((i, p))
        order = sorted(seeds)
        self.seeds = np.array(order, np.int64)
        self.first = np.cumsum([0] + [len(seeds[c]) for c in order])
        self.owner = np.array([i for c in order for i, _ in seeds[c]], np.int64)
        self.place = np.array([p for c in order for _, p in seeds[c]], np.int64)

    def matches(self, text: bytes | None, least: float) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, last word) of each item's best copy in a whole text."""
        ids = self.numbers(text)
        if 0 < len(ids) < GRAM:
            return [(i, 1.0, 0, len(ids) - 1) for i in self.whole.get(tuple(ids.tolist()), ())]
        if len(ids) < GRAM or not len(self.seeds):
            return []
        at, codes = self.codes(ids)
        k = np.minimum(np.searchsorted(self.seeds, codes), len(self.seeds) - 1)
        hit = self.seeds[k] == codes
        at, k = at[hit], k[hit]
        if not len(at):
            return []
        n = self.first[k + 1] - self.first[k]
        flat = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, place, spot = self.owner[flat], self.place[flat], np.repeat(at, n)
        diagonal = spot - place
        order = np.lexsort((diagonal, item))
        item, place, diagonal = item[order], place[order], diagonal[order]
        reach = np.array([len(self.items[i]) for i in item.tolist()]) // 2
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (np.diff(diagonal) > reach[1:])))
        starts = np.nonzero(new)[0].tolist()
        best: dict[int, tuple[float, int, int]] = {}
        for s, e in zip(starts, [*starts[1:], len(item)], strict=True):
            i = int(item[s])
            words = self.items[i]
            if len(words) < MIN_ITEM:
                for d in np.unique(diagonal[s:e]).tolist():
                    if d >= 0 and np.array_equal(ids[d : d + len(words)], words):
                        best.setdefault(i, (1.0, d, d + len(words) - 1))
                continue
            pad = len(words) // 2
            lo, hi = max(0, int(diagonal[s]) - pad), min(len(ids), int(diagonal[e - 1]) + len(words) + pad)
            if len(set(place[s:e].tolist())) < 2 and 2 * np.isin(ids[lo:hi], words).sum() < least * 2 * len(words):
                continue  # one seed, and fewer of the item's words around it than the least score takes
            score, end = align(words, ids[lo:hi])
            share = score / (2 * len(words))
            if share >= least and share > best.get(i, (0.0,))[0]:
                _, back = align(words[::-1], ids[lo : lo + end][::-1])
                best[i] = (share, lo + end - back, lo + end - 1)
        return [(i, *found) for i, found in sorted(best.items())]


def _blocks(docs: DataFrame, items: DataFrame, id_col: str, item_text: str, text: str):
    """(broadcast block, (item, id) of its items) for each block of items, with seeds by the whole corpus."""
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[id_col].dataType.simpleString()
    items = items.select(F.col(id_col).alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    for b in range(n):
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()  # at most about BLOCK_BYTES
        place = {t: i for i, t in enumerate(sorted({r.text for r in held}))}  # equal texts with other ids are one item here
        block = Block([t.encode() for t in place])
        if not block.items and not block.whole:
            continue
        sent = spark.sparkContext.broadcast(block)

        def frequencies(batches, sent=sent):
            counts, rows = np.zeros(len(sent.value.grams), np.int64), 0
            for batch in batches:
                for t in each(batch.column(0)):
                    counts[sent.value.seen(t)] += 1
                    rows += 1
            some = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([rows, *counts[some].tolist()], pa.int64())], ["gram", "n"])

        summed = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(len(block.grams), np.int64)
        rows = 0
        for r in summed:  # one row for each n-gram of the block at most
            if r.gram < 0:
                rows = r.n
            else:
                frequency[r.gram] = r.n
        block.choose(frequency, max(RARE, RARE_SHARE * rows))
        yield spark.sparkContext.broadcast(block), spark.createDataFrame([(place[r.text], r.id) for r in held], f"item int, item_id {kind}")


def _matcher(sent, least: float):
    @F.arrow_udf("array<struct<item:int,score:double,first:bigint,last:bigint>>")
    def found(texts: pa.Array) -> pa.Array:
        names = ("item", "score", "first", "last")
        return pa.array([[dict(zip(names, m, strict=True)) for m in sent.value.matches(t, least)] for t in each(texts)], _FOUND)

    return found


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the best copy of each item in each document that has one."""
    out = None
    for sent, named in _blocks(docs, items, item_id, item_text, text):
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(_matcher(sent, least)(F.col(text).cast("binary"))).alias("m")).select("doc_id", "m.*")
        part = found.join(F.broadcast(named), "item").select("doc_id", "item_id", "score", F.col("first").alias("first_word"), F.col("last").alias("last_word"))  # a block's items: bounded
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast(items.schema[item_id].dataType).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("last_word")).where("false")
    return out


def filter_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no copy of an item, with their columns. Texts are read twice and never shuffled."""
    out = docs
    for sent, _ in _blocks(docs, items, item_id, item_text, text):
        out = out.where(F.size(_matcher(sent, least)(F.col(text).cast("binary"))) == 0)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
