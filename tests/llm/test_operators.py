"""Small cases and brute force for every operator of graphloom.llm."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import _common, decontaminate, histogram_shards, mix_sources, quality_classifier, quality_rules, quote_linking, secret_scan, simhash_dedup, token_counts, toxicity
from graphloom.llm import queries as llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Kept string, gl_f int, shard string, `size.of it` int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, "x", 1, "y", 2) for r in rows], SCHEMA)


def awkward():
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in ("th", "er", "on", "in", "é") for b in ("an", "ea", "or", "st", "ß")]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 60))) + rng.choice(["", ".\n", " | x"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, " \t\n", "en", "a"), (None, "some text", "en", "b"), (None, None, None, None), (103, LONG, "en", "a")]
    rows += [(7, rows[7][1], "en", "a")] * 3 + [(200 + i, "copy " * 30, "en", "a") for i in range(20)]
    rows += [(300, "  x y ſecret = abcdefg", "en", "a"), (301, 'API_KEY: "abcdef" AKIA' + "Q" * 20 + " " + "deadbeef" * 5 + " 日本 token=a1b2c3", "en", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_count_as_brute_force_does(docs, none):
    got = quality_rules.judge(docs).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in got) == Counter((i, *counts(t)) for i, t, *_ in awkward())
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


def test_rules_adapt_and_filter(spark, docs, none):
    rng = random.Random(1)
    say = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(2, 6) + str(rng.random())[2:5] for _ in range(40))
    rows = [(i, say(), "en", "a") for i in range(150)] + [(500 + i, say().replace(" ", "### "), "en", "a") for i in range(5)]
    kept = {r.doc_id for r in quality_rules.judge(frame(spark, rows)).where("kept").collect()}
    assert kept == set(range(150))
    out = quality_rules.filter_documents(docs)
    assert out.columns == docs.columns
    want = quality_rules.judge(docs).where("kept")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in want.collect())
    assert quality_rules.filter_documents(none).count() == 0


def test_rules_judge_equal_ratios_by_their_group(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") * rng.randint(2, 6) + rng.choice("klmnop") + str(rng.random())[2:5]

    def say(signs):
        words = [word() for _ in range(60)]
        for _ in range(signs):
            words[rng.randrange(60)] += "#"
        return " ".join(words)

    # code pages hold signs as a matter of course, letters none; then the same text in both
    rows = [(i, say(rng.randint(5, 60)), "en", "code") for i in range(400)] + [(1000 + i, say(0), "en", "letters") for i in range(400)]
    odd = say(40)
    rows += [(5000, odd, "en", "code"), (5001, odd, "en", "letters"), (5002, odd, "en", "few"), *((6000 + i, say(0), "de", None) for i in range(3))]
    both = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules.judge(both).collect()}
    assert got[5000].kept and not got[5001].kept and all(got[i].kept for i in [*range(400), *range(1000, 1400)])
    assert got[6000].kept  # a small group follows what is merged
    fences = quality_rules.thresholds(quality_rules.sketches(quality_rules.features(both, "f"), "f")).collect()
    assert len({r.upper for r in fences if r.ratio == "symbol_ratio"}) == 4
    both.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert Counter((r[0], r[-1]) for r in con.sql(llm_queries.oracle_sql()["op1_quality_rules"]).fetchall()) == Counter((i, r.kept) for i, r in got.items())


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [s for *_, s in sorted(found)]


def test_secret_spans(spark, docs, none, tmp_path):
    odd = ["secret:token:abcdefgh", "token=abc password = 'hunter22' x", "AKIAAKIA" + "A" * 30, "日本passwd:é token=aaaaaa.b", "f" * 23 + "g" + "f" * 24, "token = " * 5 + "abcdefgh", "key"]
    both = frame(spark, [*awkward(), *((900 + i, t, "en", f"s{i % 2}") for i, t in enumerate(odd))])
    both.write.parquet(str(tmp_path / "documents.parquet"))
    got = secret_scan.query(spark, str(tmp_path)).collect()
    said = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == both.count()
    for i, text in [*((r[0], r[1]) for r in awkward() if r[0] is not None), *((900 + i, t) for i, t in enumerate(odd))]:
        want = base_spans(text)
        assert said[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:80]
        assert set(want) <= set(said[i].spans.split(","))
    assert secret_scan.scan(none).count() == 0


def test_secret_ownership(spark):
    key, own = "aB3" * 10, "xY7" * 10
    rows = [(i, f"k {key} {'example' * (i % 2)}", "en", f"s{i}") for i in range(5)] + [(10, f"mine {own}", "en", "s1")] + [(20 + i, "token=copied12", "en", f"s{i}") for i in range(4)]
    rows += [(100 + i, f"token=template{i % 2}", "en", "s1" if i % 2 else f"s{i % 4}") for i in range(60)]  # many repositories of one owner, and of two
    got = {r.doc_id: r for r in secret_scan.scan(frame(spark, rows)).collect()}
    assert got[101].n_example == 1 and (got[101].spans[0].owners, got[101].spans[0].repos) == (1, 30) and got[100].n_example == 1
    assert not got[0].spans and [s.kind for s in got[10].spans] == ["opaque"] and got[10].n_live == 1
    assert got[20].n_example == 1 and got[20].spans[0].owners == 4


def test_secrets_of_a_text_with_very_many(spark, tmp_path):
    text = " ".join(f"token=a{i}bcdefg {'x' * (i % 7)}" for i in range(30_000))
    frame(spark, [(1, text, "en", "a")]).write.parquet(str(tmp_path / "documents.parquet"))
    (got,) = secret_scan.query(spark, str(tmp_path)).collect()
    assert got.n_assign == 30_000 and got.base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()


def test_mix(docs, none):
    got = mix_sources.assign(docs).collect()
    sizes = Counter()
    for _, t, _, s in awkward():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, rest = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    open_ = set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        rest -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    by_size = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    largest = {s: max([len(WORD.findall(t or "")) for _, t, _, x in awkward() if x == s]) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert Counter(map(tuple, mix_sources.assign(docs).collect())) == Counter(map(tuple, got))
    mixed = mix_sources.mix_documents(docs)
    assert mixed.columns == docs.columns and sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(taken.values())
    assert mix_sources.assign(none).count() == 0 and mix_sources.mix_documents(none).count() == 0


def test_targets_of_very_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"site-{rng.random()}": rng.choice([0, 1, 7, 7, rng.randint(1, 10**9)]) for _ in range(3000)} | {None: 12}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    frame_ = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mix_sources.targets(frame_).collect()}
    assert got.keys() == sizes.keys() and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
    level = max(t / weight[s] for s, t in got.items() if t < 2 * sizes[s])
    assert all(got[s] == pytest.approx(min(2 * n, level * weight[s])) for s, n in sizes.items())
    plan = mix_sources.ordered(frame_, [F.col("source")])
    assert [(r.rank, r.source) for r in plan.orderBy("rank").collect()] == list(enumerate(sorted(sizes, key=lambda s: (s is not None, s or ""))))


def simhash(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, sets=None, near=None):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or (near and near(sets[i], sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, none):
    rows = awkward()
    prints = [simhash(t) for _, t, *_ in rows]
    group, names = classes(prints), {}
    for (i, *_), g in zip(rows, group, strict=True):
        names[g] = min([x for x in (names.get(g), i) if x is not None], default=None)
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect())
    assert got == Counter((i, p, names[g]) for (i, *_), p, g in zip(rows, prints, group, strict=True))
    stay = simhash_dedup.drop_duplicates(docs)
    assert stay.columns == docs.columns
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall((t or "").lower()) for _, t, *_ in rows)]
    groups = classes(prints, sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    least = {g: min([i for (i, *_), x in zip(rows, groups, strict=True) if x == g and i is not None], default=None) for g in groups}
    assert Counter(r.doc_id for r in stay.collect()) == Counter(least.values())
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.drop_duplicates(none).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("aeioulnrstdm", k=rng.randint(2, 9))) for _ in range(4000)]
    common = vocab[:40]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    rows, copies = [], 0
    for i in range(200):
        words = say(rng.randint(60, 400))
        rows.append((i, " ".join(words), "en", "a"))
        if i % 2:
            other = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 70)):
                other[at] = rng.choice(vocab)
            rows.append((1000 + i, " ".join(other), "en", "b"))
            copies += 1
    hot = say(300)
    rows += [(5000 + k, " ".join([*hot[:150], f"edit{k}", *hot[150:]]), "en", "a") for k in range(150)]
    got = Counter(r.doc_id for r in simhash_dedup.drop_duplicates(frame(spark, rows)).collect())
    assert max(got.values()) == 1 and set(range(200)) <= set(got)
    assert sum(1000 <= i < 5000 for i in got) <= 0.1 * copies
    assert sum(i >= 5000 for i in got) == 1 and 5000 in got


def stays(spark, texts):
    """Ids that stay of texts numbered from 0."""
    return {r.doc_id for r in simhash_dedup.drop_duplicates(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}


def test_edited_copies_of_a_middle_original_are_one_group(spark):
    rng = random.Random(21)
    original = [f"o{i}" for i in range(200)]
    texts = []
    for k in range(1000):  # nearer than 0.8 to the original, not to each other
        words = list(original)
        for at in rng.sample(range(4, 196), 3):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    assert stays(spark, [*texts[:500], " ".join(original), *texts[500:]]) == {0}


def test_copies_that_differ_in_one_long_token_go(spark):
    rng = random.Random(22)
    texts, copies = [], []
    for n, size in [(60, 40)] * 20 + [(100, 64)] * 20 + [(300, 120)] * 20:
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        token = lambda: "".join(rng.choices("0123456789abcdef", k=size))  # noqa: B023, E731
        texts.append(" ".join([*words[: n // 2], token(), *words[n // 2 :]]))
        copies.append(" ".join([*words[: n // 2], token(), *words[n // 2 :]]))
    assert stays(spark, texts + copies) == set(range(60))


def test_lengthened_and_shortened_copies_go(spark):
    rng = random.Random(23)
    say = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts, copies = [], []
    for n, more in ((200, 20), (200, 30), (200, 45), (60, 12), (20, 3), (14, 1)):
        for k in range(12):
            words, added = say(n), say(more)
            pair = [" ".join(words), " ".join(words + added if k % 2 else added + words)]
            a, b = pair if k % 4 < 2 else pair[::-1]
            texts.append(a)
            copies.append(b)
    assert stays(spark, texts + copies) == set(range(72))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_strangers_around_a_common_passage_hide_no_pair(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    say = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts, root = [], {}
    for i in range(1500):  # strangers that share half of their shingles or more, and every fifth has a copy near the limit
        words = [*passage, *say(rng.randint(16, 45))]
        root[len(texts)] = copied = len(texts)
        texts.append(" ".join(words))
        if i % 5 == 0:
            other = [*words, *say(max(1, (len(words) - 4) // 5 if i % 2 else 1))]
            assert jaccard(*({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))) >= 0.8
            root[len(texts)] = copied
            texts.append(" ".join(other))
    prints = np.array([simhash(t) for t in texts], np.uint64)
    for i in range(len(texts)):  # fingerprints link a few more
        for j in np.nonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 2)[0].tolist():
            a, b = sorted((root[i], root[j]))
            root = {k: a if r == b else r for k, r in root.items()} if a != b else root
    assert stays(spark, texts) == set(root.values())


def test_no_risk_finds_the_same(spark):
    rng = random.Random(31)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(120):  # from all words of one's own to all words of a passage that many share
        own = [f"o{i}x{k}" for k in range(200)]
        at = rng.randrange(100)
        words = [*common[at : at + 200][: rng.randint(0, 200)], *own[: rng.randint(1, 200)]]
        rows.append((i, " ".join(words), "en", "a"))
        for k in range(3):
            other = list(words)
            for _ in range(max(1, len(words) // 50 * (k + 1))):
                other[rng.randrange(len(other))] = f"e{rng.randrange(10**6)}"
            rows.append((1000 * (k + 1) + i, " ".join(other), "en", "a"))
    got = [Counter(r.doc_id for r in simhash_dedup.drop_duplicates(frame(spark, rows), risk=risk).collect()) for risk in (simhash_dedup.RISK, 0)]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t, *_ in rows)]
    group = classes([simhash(t) for _, t, *_ in rows], sets, lambda a, b: jaccard(a, b) >= 0.8)
    least = {g: min(i for (i, *_), x in zip(rows, group, strict=True) if x == g) for g in group}
    assert got[0] == got[1] == Counter(least.values())


def test_partners_meet_in_one_kind_of_key():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n, share = int(rng.integers(30, 900)), rng.random()
        often = rng.integers(-(2**63), 2**63 - 1, n)
        base = np.unique(np.concatenate([often[: int(n * share)], rng.integers(-(2**63), 2**63 - 1, n - int(n * share))]))
        gone, more = int(rng.random() * 0.1 * n), int(rng.random() * 0.1 * n)
        other = np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(-(2**63), 2**63 - 1, more)]))
        if jaccard(set(base.tolist()), set(other.tolist())) >= 0.8:
            a, b = (simhash_dedup.first_keys(*simhash_dedup.apart(s, np.sort(often))) for s in (base, other))
            assert set(a[0].tolist()) & set(b[0].tolist()) or set(a[1].tolist()) & set(b[1].tolist())


def test_long_paths_and_hubs_are_one_component(spark):
    path = spark.range(1, 3000).selectExpr("id * 7919 % 3001 as a", "(id + 1) * 7919 % 3001 as b")
    hub = spark.range(10_000, 14_000).selectExpr("10000 as a", "id as b")
    plans = []
    scratch = simhash_dedup.Scratch

    class Watched(scratch):
        def keep(self, df):
            out = super().keep(df)
            plans.append(int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            return out

    simhash_dedup.Scratch = Watched
    try:
        got = simhash_dedup.components(path.union(hub)).collect()
    finally:
        simhash_dedup.Scratch = scratch
    assert Counter(r.root for r in got) == {1: 3000, 10_000: 4000}
    assert max(plans) < 10**7  # estimates follow the tables, not the rounds


def test_links_lose_none(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << b
        prints.append(p)
    centre = rng.getrandbits(64)
    prints += [centre ^ x for x in range(900)]  # a long list: more members than are compared in pairs
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in edges.collect())
    found = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    group = classes(prints)
    assert len({found.get(s, s) for s in signed}) == len(set(group))
    assert len({(found.get(s, s), g) for s, g in zip(signed, group, strict=True)}) == len(set(group))


ITEMS = ["the quick brown fox jumps over a lazy dog while seven green birds watch from the old stone wall", "to sum two numbers you add the units first, then carry what is over ten into the next column", "short one", None, ""]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(list(enumerate(ITEMS)) + [(9, ITEMS[1])], "item_id long, text string")
    pad = "nothing here is of any interest to anyone at all " * 20
    edited = ITEMS[0].replace("brown", "red").replace("seven", "eight").replace("old ", "")
    rows = [(1, pad + ITEMS[0].upper() + " " + pad, "en", "a"), (2, pad + edited, "en", "a"), (3, pad, "en", "a"), (4, "the quick brown fox is not here, over a lazy river", "en", "a"), (5, ITEMS[1] + " " + pad + edited, "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"), (None, ITEMS[0], "en", "a")]
    both = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(both, items).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 0), (5, 1), (5, 9), (None, 0)}
    assert got[1, 0].score == 1 and (got[1, 0].first_word, got[1, 0].last_word) == (200, 218)
    assert got[2, 0].score == (2 * 16 - 3) / 38
    # short items: word for word, those of one or two words only by themselves
    short = spark.createDataFrame([(20, "short one"), (21, "seven green birds watch"), (22, "Dog!"), (23, "short one")], "item_id long, text string")
    more = frame(spark, [(30, "a short one here", "en", "a"), (31, "Short, one", "en", "a"), (32, ITEMS[0], "en", "a"), (33, "seven green big birds watch", "en", "a"), (34, "dog", "en", "a"), (35, "birds, seven green birds watch", "en", "a")])
    found = {(r.doc_id, r.item_id): (r.score, r.first_word, r.last_word) for r in decontaminate.contaminated(more, short).collect()}
    assert found == {(31, 20): (1, 0, 1), (31, 23): (1, 0, 1), (32, 21): (1, 10, 13), (34, 22): (1, 0, 0), (35, 21): (1, 1, 4)}
    kept = decontaminate.filter_documents(both, items)
    assert kept.columns == both.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.filter_documents(docs, items.limit(0)).count() == docs.count()


def test_decontamination_against_alignment_of_everything(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocab, k=rng.randint(10, 25))) for _ in range(12)]
    rows = []
    for i in range(60):
        words = rng.choices(vocab, k=80)
        if i % 2:
            passage = [w if rng.random() > 0.15 else rng.choice(vocab) for w in rng.choice(items).split()]
            words[20:20] = passage
        rows.append((i, " ".join(words), "en", "a"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    number = {w: k for k, w in enumerate(vocab)}
    code = lambda t: np.array([number[w] for w in t.split()])
    want = {(i, j) for i, t, *_ in rows for j, x in enumerate(items) if decontaminate.align(code(x), code(t))[0] >= 2 * len(x.split()) * decontaminate.LEAST}
    assert found == want


def test_alignment_scores():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(max(r) for r in h)

    rng = random.Random(2)
    for _ in range(200):
        a, b = rng.choices(range(4), k=rng.randint(1, 9)), rng.choices(range(4), k=rng.randint(1, 15))
        assert decontaminate.align(np.array(a), np.array(b))[0] == plain(a, b)


def labelled(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(vocab, k=rng.randint(15, 80))
        bad, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for w in rng.choices(["dumbhead", "wormface", "bonkers"], k=3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, "### ".join(words) if bad else " ".join(words), "en", "a"))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, [*rows, (None, None, None, None), (5000, "", "en", "a"), (5001, LONG, "en", "a"), (5002, "a DumbHeed and wormfaec and bonkerz here, dumbhed", "en", "a")]), spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "least"), [(quality_classifier, "quality", 0.97), (toxicity, "toxic", 0.97)])
def test_classifiers_on_held_out_rows(spark, none, operator, label, least):
    both, labels = labelled(spark)
    got = {r.doc_id: r for r in operator.classify(both, labels).collect()}
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1) for i, r in got.items())
    held = [(r[label], got[r.doc_id].predicted) for r in labels.where(f"doc_id is not null and {label} is not null").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= least * len(held) > 0
    assert operator.classify(none, labels).count() == 0
    blank = operator.classify(both, labels.limit(0)).collect()
    assert len({r.score for r in blank}) == 1


def test_toxicity_misspelling_and_quotation(spark):
    both, labels = labelled(spark)
    scored = {r.doc_id: r.score for r in toxicity.classify(both, labels).collect()}
    assert scored[5002] > 0.5 > scored[5000]
    lexicon = toxicity.Lexicon([b"wormface"], [])
    assert [lexicon[w] for w in (b"wormface", b"wormfase", b"wormfce", b"wwormface", b"wrmfac", b"ormface", b"surface")] == [1, 3, 3, 3, 0, 3, 0]
    assert toxicity.features(b"you wormface", lexicon)[0] > 0
    assert toxicity.features(b'they cried "wormface" there', lexicon)[0] == 0 < toxicity.features(b'they cried "wormface" there', lexicon)[3]
    assert toxicity.features(b"> wormface\nno", lexicon)[3] > 0 and toxicity.features(b"he said wormface", lexicon)[3] > 0


def test_clean_words_close_to_a_term_stay_clean(spark):
    rng = random.Random(14)
    vocab = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(200)]
    rows = [(i, " ".join([*rng.choices(vocab, k=12), ("wormface" if i % 2 else rng.choice(["wormfact", "wormfare"])), *rng.choices(vocab, k=12)]), "en", "a") for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int")
    words, _, clean, crowded = toxicity.train(frame(spark, rows), labels)[0]
    assert b"wormface" in words and clean == {b"wormfact", b"wormfare"} and crowded == {b"wormface"}
    assert all((r.score >= 0.5) == r.doc_id % 2 for r in toxicity.classify(frame(spark, rows), labels).collect())


def test_misspellings_beyond_ascii():
    lexicon = toxicity.Lexicon([w.encode() for w in ("дурак", "傻瓜蛋", "wormface")], [])
    for term in ("дурак", "傻瓜蛋", "wormface"):
        for i in range(len(term)):  # a letter left out, another in its place, one more
            for said in (term[:i] + term[i + 1 :], term[:i] + "ж" + term[i + 1 :], term[:i] + "猫" + term[i:]):
                assert lexicon[said.encode()] == toxicity.EDITED, said
    assert not any(lexicon[w.encode()] for w in ("дождь", "大象", "дурачок", "wo"))


def test_quotations_of_a_very_long_line():
    lexicon = toxicity.Lexicon([b"wormface"], [])
    text = ("aa wormface " * 40_000 + '"' + "b wormface " * 40_000 + '" c wormface\n> wormface\nwormface').encode()
    sums = toxicity.features(text, lexicon)
    assert sums[0] == pytest.approx(np.log1p(40_002)) and sums[3] == pytest.approx(np.log1p(40_001))
    plain = lambda t: [(m.start(), m.end()) for m in re.finditer(rb"wormface", t)]
    rng = random.Random(3)
    for _ in range(300):
        said = "".join(rng.choice(['"', "“", "”", "«", "»", " wormface ", "\n", "x", "> "]) for _ in range(25)).encode()
        asked = toxicity.Quotations(said)
        for begin, stop in plain(said):
            line = said[said.rfind(b"\n", 0, begin) + 1 : begin]
            tail = said[stop:].split(b"\n")[0]
            want = line.lstrip().startswith(b">") or (line.count(b'"') % 2 == 1 and b'"' in tail)
            want = want or any(line.count(a.encode()) > line.count(b.encode()) and b.encode() in tail for a, b in ("“”", "«»"))
            assert asked.holds(begin, stop) == want, said


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(6)
    say = lambda: "".join(rng.choices("abc", k=rng.randint(1, 6)))
    for _ in range(300):
        terms, word = [say() for _ in range(4)], say()
        for edits in (0, 1, 2):
            assert toxicity.within(toxicity.trie([t.encode() for t in terms]), word, edits) == (min(distance(t, word) for t in terms) <= edits)


def test_factorisation_machine_pairs():
    rng = np.random.default_rng(1)
    model = (0.3, rng.normal(size=quality_classifier.WIDTH), rng.normal(size=(quality_classifier.WIDTH, 3)))
    index, value = np.array([3, 50, 4100]), np.array([0.5, -1.0, 2.0])
    z = model[0] + sum(model[1][i] * x for i, x in zip(index, value, strict=True))
    z += sum(float(model[2][index[a]] @ model[2][index[b]]) * value[a] * value[b] for a in range(3) for b in range(a))
    assert quality_classifier.score(model, index, value) == pytest.approx(1 / (1 + np.exp(-z)))


def unigram(vocabulary, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_token_counts_as_the_tokenizer(spark, docs, none):
    vocabulary = token_counts.read_vocabulary(token_counts.VOCABULARY)
    tokenizer = unigram(vocabulary, True)
    got = Counter(map(tuple, token_counts.count_tokens(docs).collect()))
    assert got == Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) if t else 0) for i, t, *_ in awkward())
    assert token_counts.count_tokens(none).count() == 0
    counter = token_counts.Counter(vocabulary)
    for s in ["", " ", "  a  b ", "▁▁x", "日本語 梦 ☃☃ x", "a\n\n b\n", "<0x41>", " x\ty", "né ß"]:
        assert counter.of(s) == len(tokenizer.encode(s, add_special_tokens=False).ids), s


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_token_counts_with_ties(byte_fallback):
    rng = random.Random(9)
    for trial in range(40):
        pieces = {"".join(rng.choices("ab▁\n", k=rng.randint(1, 4))) for _ in range(12)}
        scores = [-1.0, -2.0, -3.0] if trial % 2 else [-0.1, -0.2, -0.30000000000000004, -0.3]
        vocabulary = [("<unk>", 0.0), *((p, rng.choice(scores)) for p in sorted(pieces))]
        counter, tokenizer = token_counts.Counter(vocabulary, byte_fallback), unigram(vocabulary, byte_fallback)
        for _ in range(30):
            text = "".join(rng.choices("abc \né", k=rng.randint(0, 14)))
            assert counter.of(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), (vocabulary, text)


def test_token_counts_of_texts_without_spaces():
    import tracemalloc

    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("ab", -1.5), ("abc", -1.7), ("b", -2.0), ("▁", -0.5)]
    counter, tokenizer = token_counts.Counter(vocabulary, False), unigram(vocabulary, False)
    rng = random.Random(2)
    text = "".join(rng.choices("abcd", k=60_000))
    assert counter.of(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    spaced = " ".join(text[i : i + 7] for i in range(0, 700, 7)) + "  x "
    whole = counter.of(spaced)
    token_counts.STRETCH, kept = 10, token_counts.STRETCH
    try:
        assert token_counts.Counter(vocabulary, False).of(spaced) == whole == len(tokenizer.encode(spaced, add_special_tokens=False).ids)
    finally:
        token_counts.STRETCH = kept
    tracemalloc.start()
    counter.of(text * 10)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_shards(docs, none):
    rows = awkward()
    got = histogram_shards.assign(docs, shards=6).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.shard for r in got} <= set(range(6))
    assert histogram_shards.shard_documents(docs).columns == [*docs.columns, "shard_", "slot"]
    placed = histogram_shards.shard_documents(docs, shards=6, shard="my_shard")
    assert placed.columns == [*docs.columns, "my_shard", "slot"] and placed.count() == len(rows)
    assert Counter((r.my_shard, r.slot) for r in placed.collect()) == Counter((r.shard, r.slot) for r in got)
    assert histogram_shards.assign(none).count() == 0


@pytest.mark.parametrize("hot", [0, 90, 900])  # 900: a text larger than many shards, cut by ids
def test_shards_as_sql_says(spark, none, tmp_path, hot):
    # without the longest text, over which the CRC in SQL takes a minute
    rows = [*(r for r in awkward() if r[1] != LONG), *((1000 + i, f"text {i} " * (i % 7), "en", "a") for i in range(300)), *((5000 + i, "hot text " * 60, "en", "a") for i in range(hot))]
    for name, table in (("some", frame(spark, rows).repartition(4)), ("none", none)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        told = con.sql(llm_queries.oracle_sql()["op8_histogram_shards"])
        got = histogram_shards.query(spark, str(tmp_path / name))
        assert told.columns == got.columns
        assert Counter(map(tuple, got.collect())) == Counter(told.fetchall())


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(50, 150) + str(i), "en", "a") for i in range(3000)] + [(5000 + i, "copied " * 9, "en", "a") for i in range(40)]
    got = histogram_shards.assign(frame(spark, rows), shards=10).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 10 + 40 * 79
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1
    hot = histogram_shards.assign(frame(spark, rows[:1000] + [(9000 + i, "hot text of a third", "en", "a") for i in range(6000)]), shards=10).collect()
    sizes = Counter()
    for r in hot:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 10 + 300


def test_sub_ranges_follow_the_rows(spark, monkeypatch):
    rows = [(i, f"text {i}" if i % 3 else "hot text", "en", "a") for i in range(6000)]
    before = {(r.doc_id, r.shard) for r in histogram_shards.assign(frame(spark, rows), shards=5).collect()}
    monkeypatch.setattr(histogram_shards, "SUB_ROWS", 10)
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 10)
    got = histogram_shards.assign(frame(spark, rows), shards=5).collect()
    assert {(r.doc_id, r.shard) for r in got} == before
    slots = [(r.shard, r.slot) for r in got]
    shards = Counter(s for s, _ in slots)
    assert sorted(slots) == [(s, i) for s in sorted(shards) for i in range(shards[s])]


TALK = [
    (1, 0, "user", "How do I boil an egg?\nIn a pan."),
    (1, 1, "assistant", "> How do I boil an EGG?\nPut it in   water.\nWait."),
    (1, 2, "user", "On Monday, somebody wrote:\n> Put it in water.\n>> How do I boil an egg?\nHow long?"),
    (1, 3, "user", "> in a pan.\nA pot will do."),
    (1, 4, "assistant", "> How long?\n> Wait.\nTen minutes."),
    (1, 5, "user", "> never said by anyone\nHello"),
    (2, 0, "user", "> Put it in water.\nOther talk"),
    (2, 1, "user", None),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (None, 0, "user", "> How long?\nx"),
    (3, None, None, "y"),
    (2, 3, "user", LONG + "\n" + "> x"),
]


def test_quote_linking(spark):
    talk = spark.createDataFrame([(*r, "z") for r in TALK], "conv_id long, turn long, role string, text string, body string")
    got = quote_linking.link_conversations(talk).collect()
    assert len(got) == len(TALK)
    said = {(r.conv_id, r.turn): r for r in got}
    assert [said[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, 2, None]  # the last but one quotes more of message 2
    assert [(said[1, t].root_turn, said[1, t].depth) for t in range(6)] == [(0, 0), (0, 1), (0, 2), (0, 1), (0, 3), (5, 0)]
    assert said[1, 2].body == "How long?" and said[1, 5].body == "Hello" and said[2, 0].reply_to is None and said[2, 1].body == ""
    assert quote_linking.link_conversations(talk.limit(0)).count() == 0


def test_deep_thread(spark):
    rows = [(1, t, "user", (f"> line number {t - 1}\n" if t else "") + f"line number {t}") for t in range(70)]
    got = {r.turn: (r.reply_to, r.root_turn, r.depth) for r in quote_linking.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {t: (t - 1 if t else None, 0, t) for t in range(70)}


def say_again(rng, words, level):
    """Words as a quote of a level, wrapped at a width of its own."""
    width, out = rng.randint(3, 9), []
    for i in range(0, len(words), width):
        out.append(">" * level + " " + " ".join(words[i : i + width]))
    return out


def test_quote_linking_against_plain_search(spark):
    rng = random.Random(17)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for conv in range(25):
        said = []
        for t in range(8):
            own = [rng.choices(vocab, k=rng.randint(1, 12)) for _ in range(rng.randint(1, 3))]
            lines = []
            for _ in range(rng.randint(0, 3) if said else 0):
                words = [w for line in rng.choice(said) for w in line]
                i = rng.randrange(len(words))
                part = words[i : i + rng.randint(2, 14)]
                if rng.random() < 0.3:
                    part = [w.upper() for w in part]
                lines += ["On Friday, X wrote:"] * (rng.random() < 0.3) + say_again(rng, part, rng.randint(1, 3))
            rows.append((conv, t, "user", "\n".join([*lines, *(" ".join(x) for x in own)])))
            said.append(own)
    got = {(r.conv_id, r.turn): r for r in quote_linking.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}

    def pieces(lines):
        words = [w for x in lines for w in x.lower().split()]
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} | {" ".join(x.lower().split()) for x in lines if 0 < len(x.split()) < 5}

    text = {(c, t): x for c, t, _, x in rows}
    depth, linked = {}, 0
    for c, t, _, x in rows:
        own = [y for y in x.split("\n") if not y.startswith(">")]
        own = [y for k, y in enumerate(own) if not y.endswith("wrote:")]
        assert got[c, t].body == "\n".join(own)
        votes = Counter()
        levels = [(len(y) - len(y.lstrip(">")), y.lstrip("> ")) for y in x.split("\n")]
        passages = []
        for k, (level, y) in enumerate(levels):
            if level and (not k or levels[k - 1][0] != level):
                passages.append((level, []))
            if level:
                passages[-1][1].append(y)
        for level in {p[0] for p in passages}:
            for piece in {q for lv, lines in passages if lv == level for q in pieces(lines)}:
                first = next((u for u in range(8) if piece in pieces([y for y in text[c, u].split("\n") if not y.startswith(">") and not y.endswith("wrote:")])), None)
                if first is not None and first < t:
                    votes[-level, first] += len(piece.split())
        best = max(votes, key=lambda v: (v[0], votes[v], v[1])) if votes else None
        assert got[c, t].reply_to == (best[1] if best else None), (c, t)
        depth[c, t] = depth[c, best[1]] + 1 if best else 0
        linked += best is not None
        assert got[c, t].depth == depth[c, t]
        assert best is None or got[c, t].position > got[c, best[1]].position
    assert linked > 60
    for c in range(25):
        assert sorted(got[c, t].position for t in range(8)) == list(range(8))


def test_quotes_wrapped_anew_and_nested(spark):
    talk = [
        (1, 0, "user", "The meeting on Monday will\nbegin at nine in the large room."),
        (1, 1, "user", "Who brings the coffee for all of us this time?"),
        (1, 2, "user", "> the meeting on\n> Monday will begin\n> at nine in the\nI will be late."),
        (1, 3, "user", "> I will be late.\n>> meeting on Monday will begin at nine\nNo matter."),
        (1, 4, "user", "> brings the coffee for all\nI do."),
    ]
    got = {r.turn: (r.reply_to, r.depth, r.position, r.body) for r in quote_linking.link_conversations(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t][0] for t in range(5)] == [None, None, 0, 2, 1] and [got[t][1] for t in range(5)] == [0, 0, 1, 2, 1]
    assert [got[t][2] for t in range(5)] == [0, 3, 1, 2, 4] and got[3][3] == "No matter."
