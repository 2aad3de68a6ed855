import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkwatch.llm import packing
from sparkwatch.llm.tokens import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(reference):
    e = ChunkEncoder(PATH)
    assert e.ranked is not None
    rng = random.Random(4)
    letters = " \n\t\r'sabé1٣!$-\x85  \x1c\x1f　日😀\x00ſ"
    texts = ["", " ", "\n", "it's  we'll\n\nx", "<|endoftext|> a <|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == reference(t), repr(t)


def test_ids_equal_the_library_on_documents(spark, reference):
    e = ChunkEncoder(PATH)
    for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert np.frombuffer(e.ids(t), "<u4").tolist() == reference(t)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(4, 4) == [(0, 4)] and packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(11, 4) == [(0, 3), (3, 4), (7, 4)]


def best(weights, lengths, capacity):
    if not lengths:
        return 0.0
    value = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        value[c] = max([value[c - 1]] + [value[c - n] + w for n, w in zip(lengths, weights) if n <= c])
    return value[capacity]


def test_pricing_is_optimal():
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.randint(5, 60)
        lengths = sorted(rng.sample(range(1, capacity + 1), rng.randint(1, 5)))
        weights = [rng.random() for _ in lengths]
        config = packing.price(np.array(weights), np.array(lengths), capacity)
        assert sum(k * v for k, v in config.items()) <= capacity
        assert sum(weights[lengths.index(k)] * v for k, v in config.items()) == pytest.approx(best(weights, lengths, capacity))


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_histogram_and_are_tight(seed):
    rng = random.Random(seed)
    h = Counter(min(512, max(1, int(rng.lognormvariate(4.5, 1)))) for _ in range(4000))
    h[512] += 500
    plan = packing.pack_histogram(dict(h), 512)
    got = Counter()
    for config, times in plan:
        assert sum(k * v for k, v in config.items()) <= 512 and times > 0
        for k, v in config.items():
            got[k] += v * times
    assert got == h
    bound = -(-sum(k * v for k, v in h.items()) // 512)
    assert sum(t for _, t in plan) <= bound * 1.01 + 2


def best_fit(histogram, capacity):
    """Sequences that best fit, longest first, needs."""
    free = Counter()
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [f for f, n in free.items() if f >= length and n]
            at = min(fits) if fits else capacity
            if fits:
                free[at] -= 1
            free[at - length] += 1
    return sum(free.values())


def lognormal(pieces):
    rng = np.random.default_rng(1)
    return dict(Counter((rng.lognormal(6, 1, pieces).astype(int) % 2048 + 1).tolist()))


@pytest.mark.parametrize("pieces", [20_000, 1_000_000])
def test_the_lp_places_the_pieces(pieces):
    h, figures = lognormal(pieces), {}
    plan = packing.pack_histogram(h, 2048, figures)
    got = Counter()
    for config, times in plan:
        assert sum(k * v for k, v in config.items()) <= 2048
        for k, v in config.items():
            got[k] += v * times
    assert got == h
    assert figures["lp_share"] > 0.8 and figures["gap"] < 0.001
    # scarce short pieces, of which a sequence would hold more than there are
    packing.pack_histogram({1: 10, 2: 3, 1500: 4000}, 2048, figures)
    assert figures["gap"] == 0.0


@pytest.mark.parametrize("h, capacity, epsilon", [(lognormal(1_000_000), 2048, 0.001), (lognormal(20_000), 2048, 0.003), ({3: 10, 5: 20, 7: 9}, 12, 0.2),
                                                 (dict(zip(range(1, 2048), np.random.default_rng(0).integers(10**6, 10**7, 2047).tolist())), 2048, 0.005)])
def test_the_fractional_solution(h, capacity, epsilon):
    """It covers every length, fits, and lies within epsilon of the dual bound."""
    h = {k: v for k, v in h.items() if k < capacity}
    taken, bound = packing.solve(h, capacity)
    cover = Counter()
    for config, times in taken.items():
        assert times > 0 and sum(k * n for k, n in config) <= capacity
        for k, n in config:
            cover[k] += times * n
    assert all(cover[k] == pytest.approx(n, rel=1e-6) for k, n in h.items())
    value = sum(taken.values())
    assert bound * (1 - 1e-9) <= value <= bound * (1 + epsilon)


def test_weights_matter():
    h = lognormal(1_000_000)
    taken, bound = packing.solve(h, 2048)
    frozen, _ = packing.solve(h, 2048, rate=0.0)
    assert sum(taken.values()) / bound - 1 < 0.001 and sum(frozen.values()) / bound - 1 > 0.005


def test_no_worse_than_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.tokenise(docs, PATH).groupBy("length").count().collect()
    for h in ({r["length"]: r["count"] for r in rows}, lognormal(3_000), {260: 70, 300: 30, 512: 11, 900: 40}):
        assert sum(t for _, t in packing.pack_histogram(h, 2048)) <= best_fit(h, 2048)


def test_awkward_lengths():
    # nothing fits beside these, so one sequence each is the least
    assert sum(t for _, t in packing.pack_histogram({260: 70, 300: 30}, 512)) == 100
    # thirds and two thirds pair up
    assert sum(t for _, t in packing.pack_histogram({341: 60, 171: 60}, 512)) == 60
    assert packing.pack_histogram({}, 512) == []
    with pytest.raises(ValueError):
        packing.pack_histogram({600: 1}, 512)


def test_pack(spark, reference):
    rows = [(1, "a short text", 9), (1, "a short text", 9), (None, None, 1), (2, "", 2), (3, "word and " * 700, 3)]
    rows += [(10 + i, "some words " * (i % 23), i) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(4)
    out = packing.pack(frame, PATH, capacity=64, with_ids=True)
    got = out.collect()
    texts = Counter()
    for doc, text, _ in rows:
        ids = reference(text or "") + [0]
        for k, (start, length) in enumerate(packing.cut(len(ids), 64)):
            data = np.array(ids[start : start + length], "<u4").tobytes()
            texts[doc, k, start, length, zlib.crc32(data)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == texts
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for r in packing.sequences(out).collect():
        assert bytes(r["ids"]) == b"".join(p[2] for p in sorted(by[r["sequence_id"]]))
    assert packing.pack(frame.limit(0), PATH).count() == 0
