"""The pipeline's stages, each held against brute force on what the stage before it kept."""

from collections import Counter

import pytest

import corpus_pipeline
from graphloom.llm import histogram_shards
from tests.llm.test_operators import LONG, WORD, classes, counts, simhash

ITEM = "the quick brown fox jumps over a lazy dog while seven green birds watch from the old stone wall"


def corpus():
    rows, say = [], lambda i: " ".join(f"w{(i * 7 + k * k * (i % 13 + 1)) % 1009}" for k in range(30 + i % 17))
    for i in range(120):
        rows.append((i, say(i), "en", f"s{i % 3}" if i % 11 else None))
    rows += [(200 + i, say(5), "en", "s1") for i in range(30)] + [(300, say(7) + " " + ITEM, "en", "s0"), (301, "few words", "en", "s0"), (302, None, None, None), (303, "", "en", "s2"), (304, "rep " * 50, "en", "s0"), (305, LONG, "en", "s0")]
    rows += [(5, say(5), "en", "s2"), (None, say(50).replace("w", "W", 2), "en", "s2"), (401, say(51).upper(), "en", "s2"), (400, " ".join(w + "###" for w in say(3).split()), "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def near_set(text):
    words = WORD.findall(text.lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark, place, tmp_path):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, place)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    rows = [(i, t, s) for i, t, _, s in corpus()]
    base = [r for r in rows if not ((c := counts(r[1]))[0] < 10 or 100 * c[4] > 20 * c[0])]
    # full of signs, or all in capitals where nobody else writes any
    assert Counter(kept[0]) == Counter(r for r in base if "###" not in r[1] and r[0] != 401)
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = classes([simhash(t) for _, t, _ in kept[0]], [near_set(t) for _, t, _ in kept[0]], near)
    first = {}
    for g, r in zip(group, kept[0], strict=True):
        first[g] = min([x for x in (first.get(g), r) if x], key=lambda x: (x[0] is None, x[0] or 0))
    assert Counter(kept[1]) == Counter(first.values())
    assert Counter(kept[2]) == Counter(r for r in kept[1] if ITEM not in r[1])
    assert {r for r in kept[3]} <= set(kept[2]) and max(Counter(kept[3]).values()) <= 2
    words = lambda rs: sum(len(WORD.findall(t or "")) for _, t, _ in rs)
    assert abs(words(kept[3]) - 1.5 * words(kept[2])) <= 4 * max(len(WORD.findall(t)) for _, t, _ in kept[2])
    assert Counter(kept[4]) == Counter(kept[3])
    places = [(r.shard, r.slot) for r in docs.collect()]
    assert len(set(places)) == len(places) and {s for s, _ in places} <= set(range(histogram_shards.SHARDS))
    assert Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, place).collect()) == Counter((r.doc_id, r.shard) for r in docs.collect())


def test_stages_of_nothing(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, place)
        assert docs.count() == 0
