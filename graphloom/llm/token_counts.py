"""Token counts by a count-only Viterbi search over a unigram vocabulary.

A text's spaces become the word mark, one is put in front, and the text is split before each mark, as the tokenizer's
Metaspace step does. In each part an Aho-Corasick automaton lists the vocabulary pieces that end at each place, and the
search carries, by place, the best score, the number of pieces on the way there and whether the way ends in an unknown
run; no piece is kept. Ties go as in the tokenizer: at one place the piece that begins first wins, an unknown character
comes last and only where no piece of one character fits, and only a strictly better score replaces. An unknown
character costs ten below the lowest score; with byte fallback it counts as its UTF-8 bytes, else a run counts once.

Parts recur, so each Python worker keeps their counts in a table of bounded size. Where no piece holds a line break and
all scores are whole numbers (sums are then exact in any order) parts are also split at line breaks, one byte each.

The vocabulary is a parameter: a SentencePiece model file (pieces and stored scores are read as unigram log
probabilities) or a list of (piece, score).

Only as many places as the longest piece has are carried, so a text without spaces needs no more memory than any other;
texts are cut into parts STRETCH characters at a time.

Edge cases. Null text: null count as no text, 0. Empty text: 0. Repeated rows: each is counted. Very long texts are
counted part by part. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import math
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm._common import each, table

#: Where the vocabulary is by default; nothing of it is kept here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: An unknown character's score is this much below the lowest piece's.
UNKNOWN = 10.0
#: Characters of parts, with ENTRY for each, whose counts a worker keeps; beyond, its table starts anew.
KEPT, ENTRY = 128 << 20, 100
#: Places that are carried besides the longest piece's before the oldest are dropped; characters cut into parts at once.
TRIM, STRETCH = 4096, 1 << 20


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Counts of parts, found when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.pieces = dict(reversed(vocabulary))
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest, self.weight = max(map(len, self.pieces), default=1), 0
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.by_line = self.bytes and not any("\n" in p for p in self.pieces) and all(float(s).is_integer() for s in self.pieces.values())

    def __missing__(self, part: str) -> int:
        self.weight += len(part) + ENTRY
        if self.weight > KEPT:
            self.clear()
            self.weight = 0
        n = self.count(part)
        if len(part) < TRIM:  # longer ones hardly recur
            self[part] = n
        return n

    def count(self, part: str) -> int:
        """Pieces on the best way through one part."""
        score, pieces, run = [0.0], [0], [False]  # by place, from the part's place ``base``
        base, at, longest = 0, 0, self.longest
        best, way, single = -math.inf, -1, False
        # the automaton tells matches by their ends, at one end the piece that begins first comes first; the last is a stop
        for end, (length, value) in chain(self.automaton.iter(part), ((len(part), (1, 0.0)),)):
            while base + at < end:  # all matches up to there are told
                if not single and score[at] + self.unknown > best:
                    best = score[at] + self.unknown
                    pieces.append(pieces[at] + (len(part[base + at].encode()) if self.bytes else not run[at]))
                    run.append(True)
                else:
                    pieces.append(pieces[way] + 1)
                    run.append(False)
                score.append(best)
                at += 1
                if at >= TRIM + longest:
                    for held in (score, pieces, run):
                        del held[:TRIM]
                    base, at = base + TRIM, at - TRIM
                best, way, single = -math.inf, -1, False
            s = score[at + 1 - length] + value
            if s > best:
                best, way = s, at + 1 - length
            if length == 1:
                single = True
        return pieces[-1]

    def of(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        total, at, first = 0, 0, True
        while at <= len(text):
            cut = text.find(" ", at + STRETCH)
            cut = len(text) if cut < 0 else cut
            marked = text[at:cut].replace(" ", MARK)
            parts = marked.split(MARK)
            if first and marked[:1] == MARK:
                del parts[0]
            total += self.sum(parts)
            at, first = cut + 1, False
        return total

    def sum(self, parts: list[str]) -> int:
        if not self.by_line:
            return sum(self[MARK + p] for p in parts)
        total = 0
        for p in parts:
            if "\n" in p:
                head, *rest = p.split("\n")
                total += self[MARK + head] + len(rest) + sum(self[r] for r in rest if r)
            else:
                total += self[MARK + p]
        return total


_held: dict = {}


def count_tokens(docs: DataFrame, vocabulary: str | list = VOCABULARY, id_col: str = "doc_id", text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens) of every row. The vocabulary is read on the driver and sent once to each executor."""
    ship(docs.sparkSession)
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    name = hash((tuple(pieces), byte_fallback))

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        if name not in _held:  # a worker lives on between tasks
            _held.clear()
            _held[name] = Counter(sent.value, byte_fallback)
        return pa.array([_held[name].of(t) for t in each(texts)], pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text)).alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
