import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from sparkwatch.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, block int, passes int, t_id int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def corpus():
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", "Z", None, "é"]), 0) for i in range(400)]
    rows += [(900, None, "en", "a", 0), (901, "", None, "b", None), (None, "one two", "en", "b", 7), (None, "one two", "en", "b", 7),
             (902, " \t\n", "en", "q", 3), (5, rows[5][1], "en", rows[5][3], 0), (903, "word " * 3000, "de", "long", 1)]
    return rows


def level_targets(sizes, weights, repeats):
    """Caps and shares the excess again and again, as the rule says, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(repeats * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeats * sizes[s]}
        if not over:
            return {s: Fraction(repeats * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def test_targets_and_takes(spark):
    rows = corpus()
    got = mixing.mix(docs(spark, rows), block_rows=7).collect()
    assert sum(r["copies"] for r in got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = level_targets(dict(sizes), (5, 2, 1), 3)
    taken, largest = Counter(), 1
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]))
        assert 0 <= r["passes"] <= 3 and (r["size"] > 0 or r["passes"] == 0)
        taken[r["source"]] += r["size"] * r["copies"] * r["passes"]
        largest = max(largest, r["size"])
    assert sum(taken.values()) <= sum(sizes.values())
    assert sum(taken.values()) > sum(sizes.values()) - largest - 1
    for s in want:
        biggest = max(len((r[1] or "").split()) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= biggest + largest


def test_blocks_and_partitions_do_not_matter(spark):
    rows = corpus()
    key = lambda r: str(tuple(r))
    one = sorted(mixing.mix(docs(spark, rows), block_rows=1000).collect(), key=key)
    many = sorted(mixing.mix(docs(spark, rows[::-1]).repartition(5), block_rows=3).collect(), key=key)
    assert one == many


def test_documents_are_repeated(spark):
    rows = corpus()
    frame = docs(spark, rows)
    want = Counter()
    for r in mixing.mix(frame).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["passes"] * r["copies"]
    out = mixing.mix_documents(frame)
    assert out.columns == frame.columns
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in out.collect())
    assert got == +want


def in_order(rows, weights=(5, 2, 1), repeats=3):
    """Passes of every row by the rule itself: all (row, pass) pairs in one list, cut at the budget."""
    import hashlib

    size = [len((t or "").split()) for _, t, *_ in rows]
    sizes = defaultdict(int)
    for n, r in zip(size, rows):
        sizes[r[3]] += n
    target = level_targets(dict(sizes), weights, repeats)
    src = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    name = lambda i: "null" if i is None else str(i)
    queue = sorted((src[r[3]], hashlib.md5(f"mix-1|{name(r[0])}|{n}".encode()).hexdigest(), r[0] is not None, r[0] or 0, n, i)
                   for i, (n, r) in enumerate(zip(size, rows)) if n)
    upto, pairs = defaultdict(int), []
    for s, h, *rest, i in queue:
        source = rows[i][3]
        upto[s] += size[i]
        pairs += [(Fraction(upto[s] + p * sizes[source]) / target[source], s, h, *rest, p, i) for p in range(repeats)]
    total, passes = 0, Counter()
    for *_, i in sorted(pairs):
        total += size[i]
        if total > sum(sizes.values()):
            break
        passes[i] += 1
    return [(r[0], r[3], n, passes[i]) for i, (n, r) in enumerate(zip(size, rows))]


@pytest.mark.parametrize("rows", [
    corpus(),
    # rows without ids, one id many times: the cut falls inside a group of equal rows
    [(None, "w w w", "en", "ab"[i >= 2000], i % 7) for i in range(4000)],
    [(5, "w w", "en", "a", 1)] * 900 + [(6, "w " * 7, "en", "b", 1)] * 40 + [(i, "w", "en", "c", 1) for i in range(30)],
    [(1, "w w w w w", "en", "a", 1)] * 50,
    [(i, "w " * 400, "en", "abc"[i % 3], i) for i in range(7)],
])
def test_mix_equals_the_rule(spark, rows):
    frame = docs(spark, rows).repartition(3)
    got = Counter()
    for r in mixing.mix(frame, block_rows=5).collect():
        got[r["doc_id"], r["source"], r["size"], r["passes"]] += r["copies"]
    want = in_order(rows)
    assert got == Counter(want)
    out = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixing.mix_documents(frame).collect())
    expected = Counter()
    for i, s, n, p in want:
        expected[i, s, n] += p
    assert out == +expected


def test_texts_are_not_moved(spark):
    frame = docs(spark, [(i, "w " * (i % 9), "en", "abc"[i % 3], i) for i in range(300)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.mix_documents(frame)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_targets_of_rows_without_ids(spark):
    rows = [(None, "w w w", "en", "ab"[i >= 2000], i % 7) for i in range(4000)]
    taken = Counter()
    for r in mixing.mix(docs(spark, rows)).collect():
        taken[r["source"]] += r["size"] * r["copies"] * r["passes"]
    assert abs(taken["a"] - 12_000 * 5 / 7) <= 6 and abs(taken["b"] - 12_000 * 2 / 7) <= 6


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix_documents(docs(spark, [])).count() == 0
    assert [r["passes"] for r in mixing.mix(docs(spark, [(1, None, None, None, None)])).collect()] == [0]


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 5003)
    count = Counter(table.tolist())
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 5003)
    stay = sum(a == b for a, b in zip(table.tolist(), fewer.tolist()) if a != 19)
    assert stay > 0.85 * (5003 - count[19])


def naive_table(names, size):
    """Turn by turn over whole preference lists."""
    import hashlib

    lists = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        at, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        lists.append([(at + i * skip) % size for i in range(size)])
    owner = {}
    while len(owner) < size:
        for k, order in enumerate(lists):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = k
    return [owner[s] for s in range(size)]


def test_table_equals_brute_force():
    names = [f"s{i}" for i in range(7)]
    assert sharding.lookup_table(names, 101).tolist() == naive_table(names, 101)
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    import hashlib

    frame = spark.createDataFrame([(1, "x", "old"), (1, "y", "old"), (None, None, None), (2, "", "s")], "doc_id long, text string, shard string")
    got = sharding.place(frame, shards=["a", "b", "c"], size=11)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    table = naive_table(["a", "b", "c"], 11)
    for r in got.collect():
        text = "\x00null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 11
        assert (r["slot"], r["shard"]) == (slot, "abc"[table[slot]])
    assert got.count() == 4 and sharding.place(frame.limit(0)).count() == 0
    sharding.write_shards(frame, str(tmp_path / "out"), shards=["a", "b"], size=11, files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
