"""Language-model scoring: gradients, blocks against whole windows, counts against plain code."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sparkwatch.llm import attention as net
from sparkwatch.llm import lm

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _weights(classes=7, width=4, seed=1):
    rng = np.random.default_rng(seed)
    p = net.initial(classes, width, seed)
    for name in ("out", "distance", "up_bias"):
        p[name] = rng.standard_normal(p[name].shape).astype(np.float32) * 0.5
    return p, rng.dirichlet(np.ones(classes), classes).astype(np.float32)


def _plain(p, table, before, after):
    """Log10 P of every position, one query at a time, with the context that a block gives."""
    out = []
    d = p["embed"].shape[1]
    for i in range(len(before)):
        first = max(0, i // net.BLOCK * net.BLOCK - net.BLOCK)
        e = p["embed"][before[first : i + 1]].astype(np.float64)
        q = e[-1] @ p["query"]
        a = (e @ p["key"]) @ q / math.sqrt(d) + p["distance"][np.arange(len(e))[::-1]]
        a = np.exp(a - a.max())
        h = e[-1] + (a / a.sum()) @ (e @ p["value"])
        top = h + np.maximum(h @ p["up"] + p["up_bias"], 0) @ p["down"]
        z = np.exp(top @ p["out"]) * table[before[i]]
        out.append(math.log10(z[after[i]] / z.sum()))
    return np.array(out)


def test_blocks_equal_one_query_at_a_time():
    p, table = _weights()
    rng = np.random.default_rng(2)
    lengths = np.array([1, 31, 32, 33, 200, 2])
    before, after = rng.integers(0, 7, lengths.sum()), rng.integers(0, 7, lengths.sum())
    got = net.Scorer(p, table).positions(before, after, lengths)
    ends = np.cumsum(lengths)
    want = np.concatenate([_plain(p, table, before[e - n : e], after[e - n : e]) for e, n in zip(ends, lengths)])
    assert np.allclose(got, want, atol=1e-4)


def test_later_ids_do_not_change_earlier_scores():
    p, table = _weights()
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 7, 121)
    other = ids.copy()
    other[90:] = rng.integers(0, 7, 31)
    score = net.Scorer(p, table).positions
    n = np.array([120])
    assert np.array_equal(score(ids[:-1], ids[1:], n)[:89], score(other[:-1], other[1:], n)[:89])


def test_gradients():
    p, table = _weights()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 7, (3, net.WINDOW)), rng.integers(0, 7, (3, net.WINDOW))
    real = rng.random((3, net.WINDOW)) < 0.8
    _, grads = net.loss_and_gradients(p, table.astype(np.float64), x, y, real)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            kept, step = p[name][at], 1e-5
            p[name][at] = kept + step
            high = net.loss_and_gradients(p, table, x, y, real)[0]
            p[name][at] = kept - step
            low = net.loss_and_gradients(p, table, x, y, real)[0]
            p[name][at] = kept
            assert (high - low) / (2 * step) == pytest.approx(g[at], rel=2e-2, abs=2e-5), name


def _docs(spark):
    texts = {0: "The red fox. The red dog", 1: "the red fox", 2: "", 3: None, 4: "unseen words\tof  one text\n",
             5: "the " * 3000, 7: "ein Zwölf 日本  x", 9: "A" * 5000, 11: "the red fox"}
    rows = [(i, t, "x", "n") for i, t in texts.items()] + [(1, "the red fox", "x", "n"), (None, "the red hen", "y", "m")]
    rows += [(100 + i, f"the red fox ran {w}", "x", "n") for i, w in enumerate(["home", "away", "fast", "slow"] * 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n string")


def _base(rows):
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0
    tokens = [((t or "").encode().lower().split() + [b""], i) for i, t in rows]
    c = Counter(w for ws, i in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((-1 if i is None else i), held(i), len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for ws, i in tokens)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 3])
def test_counts_and_base(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = _docs(spark)
    rows = lm.score_texts(docs, PATH).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                 for r in rows)
    assert got == _base([(r.doc_id, r.text) for r in docs.collect()])
    by_id = {}
    for r in rows:
        assert math.isfinite(r.score) and r.score < 0
        by_id.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert by_id[2] == by_id[3] and by_id[1] == by_id[11] and len(by_id[1]) == 1


def test_no_rows_and_nothing_to_learn_from(spark):
    docs = _docs(spark)
    assert lm.score_texts(docs.limit(0), PATH).count() == 0
    rows = lm.score_texts(docs.where(lm.held_out(docs.doc_id)), PATH).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)


def test_probabilities_add_up(spark):
    """Over the whole vocabulary, P(id | ids before) sums to one."""
    texts = _docs(spark).selectExpr("cast(coalesce(text, '') as binary) as text")
    gathered = texts.mapInArrow(lm._gather(PATH), lm.GATHERED).cache()
    pairs = gathered.where("word is not null").mapInArrow(lm._pairs(PATH), "a int, b int, n long").groupBy("a", "b").sum("n").toDF("a", "b", "n")
    model = lm.train(gathered.where("ids is not null"), lm.tables(pairs))
    scorer = lm.TextScorer(model)
    ids = np.frombuffer(lm.WordIds(PATH)[b"the"] + lm.WordIds(PATH)[b"fox"], "<u2")
    for before in (ids[:0], ids):
        every = np.arange(lm.VOCABULARY, dtype="<u2")
        logs = []
        for part in np.array_split(every, 8):
            texts = [before.tobytes() + x.tobytes() for x in part]
            logs.append(scorer.scores(texts))
        whole = scorer.scores([before.tobytes()])[0] if len(before) else 0.0
        assert (10 ** (np.concatenate(logs) - whole)).sum() == pytest.approx(1, abs=1e-3)


def test_long_texts_in_pieces(spark, monkeypatch):
    texts = _docs(spark).selectExpr("cast(coalesce(text, '') as binary) as text")
    gathered = texts.mapInArrow(lm._gather(PATH), lm.GATHERED).cache()
    pairs = gathered.where("word is not null").mapInArrow(lm._pairs(PATH), "a int, b int, n long").groupBy("a", "b").sum("n").toDF("a", "b", "n")
    scorer = lm.TextScorer(lm.train(gathered.where("ids is not null"), lm.tables(pairs)))
    ids_of = lm.WordIds(PATH)
    text = b"".join(map(ids_of.__getitem__, b"the red fox ran home and away ".split() * 90 + [b""]))
    whole = scorer.scores([text, ids_of[b""], text])
    monkeypatch.setattr(lm, "SCORED_IDS", 4 * net.BLOCK)
    assert np.allclose(scorer.scores([text, ids_of[b""], text]), whole, rtol=1e-5)


def test_better_than_the_base(spark):
    """Held-out texts of one style, longer than what unigrams can know."""
    rng = np.random.default_rng(5)
    langs = [["to", "ta", "ti", "na", "no"], ["sch", "eu", "ung", "ber", "ein"], ["qu", "ais", "ou", "eux", "er"]]
    rows = []
    for i in range(400):
        parts = langs[int(rng.integers(3))]
        rows.append((i, " ".join("".join(rng.choice(parts, int(rng.integers(1, 5)))) for _ in range(150))))
    r = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).toPandas()
    r = r[r.held_out]
    assert len(r) > 20 and r.score.sum() > r.base_score.sum()


def test_every_position_of_a_training_text_is_in_a_span():
    import pyarrow as pa

    # many words, words of many ids, and an empty text
    texts = [" ".join(f"word{i}" for i in range(200)).encode(), ("x" + "qzj" * 300 + " end").encode(), b""]
    (spans, *_) = lm._gather(PATH)(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})]))
    ids_of = lm.WordIds(PATH)
    whole = [b"".join(ids_of[w] for w in [*lm.words_of(t), b""]) for t in texts]
    got = spans.column("ids").to_pylist()
    assert b"".join(s[2:] for s in got) == b"".join(whole)
    assert max(len(s) // 2 - 1 for s in got) <= lm.WINDOW
    end = ids_of[b""]
    before = [end[-2:], *(s[-2:] for s in got[:-1])]
    assert [s[:2] for s in got] == before  # a text ends as the next begins


def test_windows_are_full_but_for_a_texts_last_one():
    import pyarrow as pa

    texts = [" ".join(f"word{i}" for i in range(200)).encode(), b"", b"the red fox"]
    (spans, *_) = lm._gather(PATH)(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})]))
    ids_of = lm.WordIds(PATH)
    sizes = [sum(len(ids_of[w]) // 2 for w in [*lm.words_of(t), b""]) for t in texts]
    want = [min(lm.WINDOW, n - at) for n in sizes for at in range(0, n, lm.WINDOW)]
    assert [len(s) // 2 - 1 for s in spans.column("ids").to_pylist()] == want
