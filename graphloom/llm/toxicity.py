"""Toxicity by a learned lexicon, matched through Levenshtein automata, weighed by context.

The lexicon is learned from a bounded sample of labelled documents, held-out rows aside: words that occur in toxic
documents and hardly ever in others, and stems (word beginnings) for families of words. The words stand in a trie. A
text's word runs through the trie together with its Levenshtein automaton, the set of (place in the word, edits so far)
that a path of the trie leaves reachable, so one walk finds every term within one edit; words that the sample holds in
clean documents are exceptions. Each hit is weighed by its context: inside quotation marks, on a line quoted by >, or
close behind a reporting word it counts as quotation, else as abuse. A logistic model fitted on the sample turns the
sums of exact, stem, misspelled and quoted hits into a score.

Edge cases. Null or empty text: no hits; the score of a text without hits. No labelled rows, or of one kind: an empty
lexicon; every score is that kind's smoothed share. Repeated rows: equal scores. Null ids: scored, never learned from.
Very long texts are read whole, each line's quotation marks once; tables of words seen are bounded in bytes and start
anew. Empty tables give empty results. Only
the named columns are read.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm._common import each, held_out, settle, table
from graphloom.llm._training import labelled_sample

TRAIN_ROWS = 6000
#: Different contexts in toxic documents that a term needs, and its least share of toxic ones, for words and for stems of STEM bytes.
MIN_WORD, MIN_STEM, PURE_WORD, PURE_STEM = 5, 8, 0.95, 0.9
STEM = (5, 6, 7, 8)
#: Terms from so many bytes and code points are matched within one edit.
FUZZY, FUZZY_POINTS = 5, 3
#: Part of an exact hit that a misspelled term counts as.
TRUST = 0.7
#: Words around a hit that are its context.
CONTEXT = 4
REPORTING = frozenset(b"said says quote quoted quotes wrote writes called reported".split())
#: Bytes of words, with ENTRY for each, whose class a worker keeps; beyond, its table starts anew.
KEPT, ENTRY = 64 << 20, 100
EXACT, ROOT, EDITED = 1, 2, 3
_TABLE = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
_TOKEN = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
END = b""


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_TABLE).split()


def trie(terms: list[bytes]) -> dict:
    """Nested dicts by code point; END holds a whole term."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term.decode("utf-8", "replace"):
            node = node.setdefault(c, {})
        node[END] = term
    return root


def near(root: dict, word: str, edits: int = 1) -> Iterator[bytes]:
    """The terms of the trie within so many edits of word. Trie and automaton are walked together."""

    def closed(states: dict[int, int]) -> dict[int, int]:
        for place in sorted(states):  # a letter of the word left out
            e = states[place]
            while e < edits and place < len(word):
                place, e = place + 1, e + 1
                if states.get(place, edits + 1) <= e:
                    break
                states[place] = e
        return states

    stack = [(root, closed({0: 0}))]
    while stack:
        node, states = stack.pop()
        if END in node and len(word) in states:
            yield node[END]
        for c, below in node.items():
            if c == END:
                continue
            new: dict[int, int] = {}
            for place, e in states.items():
                if place < len(word) and word[place] == c:
                    new[place + 1] = min(new.get(place + 1, e), e)
                if e < edits:  # a letter of the term left out, or another in its place
                    new[place] = min(new.get(place, e + 1), e + 1)
                    if place < len(word):
                        new[place + 1] = min(new.get(place + 1, e + 1), e + 1)
            if new:
                stack.append((below, closed(new)))


def within(root: dict, word: str, edits: int = 1) -> bool:
    """Is any term of the trie within so many edits of word?"""
    return next(near(root, word, edits), None) is not None


class Lexicon(dict):
    """The class of each word (0 for none), found when first asked for."""

    def __init__(self, words: list[bytes], stems: list[bytes], clean: frozenset[bytes] = frozenset(), crowded: frozenset[bytes] = frozenset()) -> None:
        self.terms, self.stems, self.clean = frozenset(words), frozenset(stems), clean
        long = [w for w in words if len(w) >= FUZZY and len(w.decode("utf-8", "replace")) >= FUZZY_POINTS and w not in crowded]
        self.root, self.weight = trie(long), 0
        # one edit leaves a term's first or last code point and its bytes in place
        self.ends = frozenset(w[:2] for w in long), frozenset(w[-2:] for w in long)
        points = [len(w.decode("utf-8", "replace")) for w in long]
        self.sizes = range(min(points, default=1) - 1, max(points, default=-1) + 2)

    def __missing__(self, word: bytes) -> int:
        self.weight += len(word) + ENTRY
        if self.weight > KEPT:
            self.clear()
            self.weight = 0
        kind = 0
        if word in self.terms:
            kind = EXACT
        elif any(word[:n] in self.stems for n in STEM):
            kind = ROOT
        elif (word[:2] in self.ends[0] or word[-2:] in self.ends[1]) and word not in self.clean:
            said = word.decode("utf-8", "replace")
            if len(said) in self.sizes and within(self.root, said):
                kind = EDITED
        self[word] = kind
        return kind


class Quotations:
    """Whether places of a text, asked in their order, stand in a quotation; each line is read once."""

    MARKS = tuple((a.encode(), b.encode()) for a, b in (('"', '"'), ("“", "”"), ("«", "»")))

    def __init__(self, text: bytes) -> None:
        self.text, self.end = text, -1

    def holds(self, begin: int, stop: int) -> bool:
        """Is begin:stop on a quoted line, or between marks?"""
        text = self.text
        if begin > self.end:
            self.at = start = text.rfind(b"\n", max(self.end, 0), begin) + 1
            self.end = text.find(b"\n", stop)
            self.end = len(text) if self.end < 0 else self.end
            self.cited = re.compile(rb"\s*>").match(text, start, self.end) is not None
            self.open = [0] * len(self.MARKS)
            self.last = [text.rfind(b, start, self.end) for _, b in self.MARKS]
        for k, (a, b) in enumerate(self.MARKS):
            if self.last[k] >= 0:
                self.open[k] += text.count(a, self.at, begin) - (text.count(b, self.at, begin) if a != b else 0)
        self.at = begin
        return self.cited or any(last >= stop and (n % 2 == 1 if a == b else n > 0) for (a, b), n, last in zip(self.MARKS, self.open, self.last, strict=True))


def features(text: bytes | None, lexicon: Lexicon) -> tuple[float, ...]:
    """Damped sums of exact, stem, misspelled and quoted hits, and the share of words that are hits."""
    words = words_of(text)
    kinds = [lexicon[w] for w in words]
    if not any(kinds):
        return (0.0,) * 5
    sums = [0.0] * 4
    before: list[bytes] = []
    quotations = Quotations(text)
    for m in _TOKEN.finditer(text.lower()):
        if kind := lexicon[m[0]]:
            inside = quotations.holds(m.start(), m.end()) or not REPORTING.isdisjoint(before)
            sums[3 if inside else kind - 1] += 1
        before = [*before[-CONTEXT + 1 :], m[0]]
    # a sample may hold no misspelling: one counts as a part of a hit besides what its own weight says
    sums[0] += TRUST * sums[2]
    return (*(math.log1p(s) for s in sums), 10 * (sums[0] + sums[1]) / len(words))


def learn(sample: DataFrame) -> tuple[list[bytes], list[bytes], frozenset[bytes], frozenset[bytes]]:
    """Words, stems, the clean words close to a term and the terms with several of these, from (doc_id, y, text)."""

    def entries(batches):
        for batch in batches:
            out: list[tuple[bytes, bool, int, int]] = []
            for text, y in zip(each(batch.column(0)), each(batch.column(1)), strict=True):
                words = words_of(text)
                first: dict[tuple[bytes, bool], int] = {}
                for i, w in enumerate(words):
                    if len(w) >= 3 and (w, False) not in first:
                        around = crc32(b" ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2]))
                        for term in [(w, False), *((w[:n], True) for n in STEM if len(w) > n)]:
                            first.setdefault(term, around)
                out += [(*term, y, around) for term, around in first.items()]
            term, stem, toxic, around = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), pa.array(stem, pa.bool_()), pa.array(toxic, pa.int64()), pa.array(around, pa.int64())], ["term", "stem", "toxic", "around"])

    # copies of a document show a term between the same neighbours: together they count once
    counted = (
        sample.select(F.col("text").cast("binary").alias("t"), "y").mapInArrow(entries, "term binary, stem boolean, toxic long, around long")
        .groupBy("term", "stem", "around").agg(F.max("toxic").alias("toxic"))
        .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    )
    pure = counted.where(F.when(F.col("stem"), (F.col("toxic") >= MIN_STEM) & (F.col("toxic") >= PURE_STEM * F.col("n"))).otherwise((F.col("toxic") >= MIN_WORD) & (F.col("toxic") >= PURE_WORD * F.col("n"))))
    found = pure.orderBy(F.desc("toxic"), "stem", "term").collect()  # the model: bounded by the sample
    stems = sorted({bytes(r.term) for r in found if r.stem}, key=len)
    roots: list[bytes] = []
    for s in stems:
        if not any(s.startswith(r) for r in roots):
            roots.append(s)
    words = [bytes(r.term) for r in found if not r.stem]
    lexicon = Lexicon(words, [])

    def close(batches):
        for batch in batches:
            kept = [t for t in each(batch.column(0)) if lexicon[t] == EDITED]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["term"])

    found_close = counted.where(~F.col("stem") & (F.col("toxic") < 0.5 * F.col("n"))).select("term").mapInArrow(close, "term binary").collect()  # sample words within an edit of a term
    clean = frozenset(bytes(r.term) for r in found_close)
    # a term with several clean neighbours says nothing when it is misspelled
    close_by = Counter(term for c in clean for term in set(near(lexicon.root, c.decode("utf-8", "replace"))))
    crowded = frozenset(term for term, n in close_by.items() if n >= 2)
    return words, roots, clean, crowded


def fit(rows: list[tuple[tuple[float, ...], int]], steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model, no weight below zero."""
    y = np.array([r[1] for r in rows], float)
    share = (y.sum() + 1) / (len(y) + 2)
    bias, w = math.log(share / (1 - share)), np.zeros(5)
    if not len(y) or y.min() == y.max():
        return bias, w
    x = np.array([r[0] for r in rows], float)
    m, s = np.zeros(6), np.zeros(6)
    for t in range(1, steps + 1):
        g = (1 / (1 + np.exp(-(bias + x @ w))) - y) / len(y)
        slope = np.append(x.T @ g + 1e-4 * w, g.sum())
        m, s = 0.9 * m + 0.1 * slope, 0.99 * s + 0.01 * slope * slope
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        w, bias = np.maximum(w - step[:5], 0), bias - step[5]
    return bias, w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text"):
    """((words, stems, exceptions, crowded words), (bias, weights)) learned from at most ``rows`` labelled documents."""
    ship(docs.sparkSession)
    sample = settle(labelled_sample(docs, labels, label, rows, id_col, text))
    terms = learn(sample)

    @F.arrow_udf("array<double>")
    def sums(texts: pa.Array) -> pa.Array:
        lexicon = Lexicon(*terms)
        return pa.array([features(t, lexicon) for t in each(texts)], pa.list_(pa.float64()))

    got = sample.select("doc_id", "y", sums(F.col("text").cast("binary")).alias("x")).collect()  # five numbers a row of the sample
    return terms, fit([(tuple(r.x), r.y) for r in sorted(got, key=lambda r: r.doc_id)])


_held: dict = {}


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, hits by kind) of every document."""
    terms, (bias, weights) = train(docs, labels, label, rows, id_col, text)
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    name = hash((tuple(terms[0]), tuple(terms[1]), *terms[2:]))

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        if name not in _held:  # a worker lives on between tasks
            _held.clear()
            _held[name] = Lexicon(*sent.value)
        x = np.array([features(t, _held[name]) for t in each(texts)]).reshape(-1, 5)
        return pa.array(1 / (1 + np.exp(-np.clip(bias + x @ weights, -500, 500))), pa.float64())

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scores(F.col(text).cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
