import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sparkwatch.llm import jaccard, mixing, pii, quality
from sparkwatch.llm.common import materialize, pseudonym_key, read_table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_set(text, words):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(rows, words, percent):
    sets = [plain_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((rows[a][0], len(sets[a]), None if rows[a][0] is None else least[find(a)]) for a in range(len(rows)))


def corpus(seed, n=220):
    """Families of near copies around the threshold, shared passages, tiny and empty texts."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "é", "A-b"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 20, 60, 150, 400]))] for _ in range(25)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = rng.choice(vocabulary)
            else:
                del text[at : at + 1]
            text = text or ["x"]
        words = " ".join(text)
        if rng.random() < 0.2:
            words = f"{words}\n{passage}"
        rows.append((i * 3, rng.choice([str.upper, str, str])(words) if words.isascii() else words))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one two"), (6, rows[2][1]), (6, "other text here now"),
             (907, "a b c d"), (908, "a b c d e f"), (909, " ".join("z%d" % (k % 7) for k in range(3000))), (910, " ".join("z%d" % (k % 7) for k in range(3500)))]
    return rows


@pytest.mark.parametrize("seed, words, percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 1, 95)])
def test_join_equals_brute_force(spark, seed, words, percent):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n int, part int, component string").repartition(5)
    got = Counter(map(tuple, jaccard.join(frame, words, percent).collect()))
    assert got == brute(rows, words, percent)


def test_small_buffers_do_not_matter(spark, monkeypatch):
    rows = corpus(7)
    for name, value in (("TEXT_CHUNK", 700), ("GATHER", 50), ("GROUP", 2), ("BROADCAST_ROWS", 0), ("RANGE_SIGNATURES", 100), ("COMMON", 2)):
        monkeypatch.setattr(jaccard, name, value)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    # the workers import the module afresh: only what the driver decides is changed there
    assert Counter(map(tuple, jaccard.join(frame, 4, 85).collect())) == brute(rows, 4, 85)


def test_blocks_of_a_signature(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 6)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "ERRANDS", 2)
    rng = random.Random(5)
    rows = []
    for f in range(2):
        text = [f"f{f}w{i}" for i in range(200)]
        rows.append((500 + f, " ".join(text)))
        for i in range(60):  # near the first one, and rarely each other
            copy = list(text)
            for at in rng.sample(range(200), 5):
                copy[at] = f"x{rng.random()}"
            rows.append((60 * f + i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard.join(frame, 4, 80).collect())) == brute(rows, 4, 80)


def test_a_set_with_many_partners_is_their_centre(spark):
    pairs = spark.range(20_000).selectExpr("id as a", "50000L as b")
    got = jaccard._errands(pairs).collect()
    assert max(len(r["errands"]) for r in got) <= 20
    assert all(e["center"] == 50_000 for r in got for e in r["errands"])
    assert sum(e["partner"] for r in got for e in r["errands"]) == 20_000


def test_word_hashes_of_any_length(monkeypatch):
    text = ("some words é " * 50 + "x" * 500 + "\n tail").encode()
    start, h = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "TEXT_CHUNK", 64)
    start2, h2 = jaccard.word_hashes(text)
    assert start.tolist() == start2.tolist() == [m.start() for m in WORD.finditer(text)]
    assert h.tolist() == h2.tolist() and len(set(h.tolist())) == len(set(WORD.findall(text)))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 70, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, size=n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 8], rng.integers(0, 2**63, size=n // 6).astype(np.uint64)]))
        x, y = jaccard.sketches(np.array([len(a), len(b)]), np.concatenate([a, b]))
        size = min(len(x), len(y))
        bound = int(np.bitwise_count(jaccard.fold(x, size) ^ jaccard.fold(y, size)).sum())
        assert bound <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_every_similar_pair_shares_a_signature(percent):
    rng = np.random.default_rng(percent)
    bands, none = jaccard.Bands(percent), (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, size=n).astype(np.uint64))
        drop, add = rng.integers(0, 1 + n // 5, size=2)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, size=add).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < percent * (len(a) + len(b) - common) or len(np.setxor1d(a, b)) == 0:
            continue
        s, key, flags = jaccard.signatures(np.array([len(a), len(b)]), np.concatenate([a, b]), bands, none)
        shared = False
        for k in np.intersect1d(key[s == 0], key[s == 1]):
            fa, fb = (np.bitwise_or.reduce(flags[(s == i) & (key == k)]) for i in (0, 1))
            shared |= bool(jaccard.valid_pairs(percent, np.array([len(a)]), np.array([fa]), np.array([len(b)]), np.array([fb]))[0])
        assert shared


def groups(rows, words, percent):
    """The group of each row: rows linked by their own texts, whatever their ids."""
    sets = [plain_set(t, words) for _, t in rows]
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    group[find(a)] = find(b)
    return [find(a) if sets[a] and rows[a][0] is not None else None for a in range(len(rows))]


def check_kept(rows, kept, words, percent):
    """``kept``: places of the rows that stay."""
    group = groups(rows, words, percent)
    free = [i for i, g in enumerate(group) if g is None]
    assert [i for i in kept if group[i] is None] == free
    mine = [i for i in kept if group[i] is not None]
    assert sorted(group[i] for i in mine) == sorted({g for g in group if g is not None}), "one row of each group"
    for i in mine:
        assert rows[i][0] == min(r[0] for r, g in zip(rows, group) if g == group[i])


def kept_places(spark, rows, words, percent):
    frame = spark.createDataFrame([(*r, i, "x", 5) for i, r in enumerate(rows)],
                                  "doc_id long, text string, place int, twice string, gone_id int").repartition(3)
    kept = jaccard.keep_one(frame, words, percent)
    assert kept.columns == frame.columns
    return sorted(r["place"] for r in kept.collect())


def test_keep_one(spark):
    rows = corpus(9)
    check_kept(rows, kept_places(spark, rows, 4, 85), 4, 85)
    assert jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_keep_one_of_equal_ids(spark):
    """Rows that share an id hold different texts, equal ones, none, or texts of other groups."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (6, b + " more"), (8, ""), (8, c)]
    got = kept_places(spark, rows, 4, 85)
    assert got == [0, 2, 4, 5]
    rng = random.Random(4)
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in range(12)]
    rows = []
    for _ in range(150):
        words = rng.choice(texts).split()
        if rng.random() < 0.5:
            words[rng.randrange(60)] = "changed"
        rows.append((rng.choice([None, *range(8)]), rng.choice([" ".join(words), " ".join(words), None, ""])))
    check_kept(rows, kept_places(spark, rows, 4, 85), 4, 85)


def test_keep_one_where_all_rows_share_an_id(spark):
    rows = [(7, " ".join(f"t{k % 5}w{i}" for i in range(30))) for k in range(40)] + [(7, None)] * 3
    check_kept(rows, kept_places(spark, rows, 4, 85), 4, 85)


# ---- the pipeline, stage by stage against plain code on each stage's own input


def test_pipeline(spark):
    docs = read_table(spark, SF, "documents")
    labels = read_table(spark, SF, "labels")
    inputs, names = {}, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources", "best-fit packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.collect()]
        docs = materialize(stage(spark, docs, SF), "test-stage")
        if name != names[-1]:
            assert docs.columns == columns
    original = read_table(spark, SF, "documents")
    good = {r["doc_id"] for r in quality.classify(original, labels).where("predicted = 1").collect()}
    assert Counter(r for r in inputs["n-gram Jaccard join"]) == Counter(r for r in inputs["quality classifier"] if r[0] in good)
    one = {i for (i, _, c), _ in brute([r[:2] for r in inputs["n-gram Jaccard join"]], 5, 80).items() if i == c}
    assert {r[0] for r in inputs["PII"]} == one and len(inputs["PII"]) == len(one)
    p = pii.Pseudonyms(pseudonym_key(spark))
    assert Counter((r[0], p.mask(r[1])[0], *r[2:]) for r in inputs["PII"]) == Counter(inputs["mixing sources"])
    takes = {(r["doc_id"], r["source"]): r["passes"] for r in mixing.mix(spark.createDataFrame(inputs["mixing sources"], original.schema)).collect()}
    want = Counter()
    for r in inputs["mixing sources"]:
        want[r] += takes[r[0], r[3]]
    assert Counter(inputs["best-fit packing"]) == +want
    pieces = docs.collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r[0] for r in inputs["best-fit packing"])
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sorted(parts)[0][0] == 0 and sum(n for _, n in parts) <= 2048


def test_pipeline_on_an_empty_table(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
