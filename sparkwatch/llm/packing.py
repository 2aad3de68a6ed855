"""Best-fit packing of documents into fixed-length token sequences by a configuration LP.

Tokenising writes one narrow row per piece. What is packed is the histogram of piece lengths,
which has at most ``capacity`` entries whatever the corpus: a configuration is a multiset of
lengths that fits one sequence, and the linear program asks for the fewest configurations, in
fractions, that cover the histogram. It is solved by multiplicative weights (``solve``): every
length carries a weight, which starts near its share of a sequence and is multiplied each round
by exp(-RATE * the share of its pieces that the round covered, against the mean share); the pricing
problem (the configurations of greatest weight, a knapsack) is solved by dynamic programming
over the capacity; and the best configurations that hold the longest lengths left are taken, in
fractions, as often as a share of the need allows. Each round's weights are a solution of the
dual when divided by the best configuration's, and the best of them bounds the number of
sequences from below. The fractional solution covers every length exactly.

It is rounded (``rounded``): configurations are taken a whole number of times, the fractions of
those with the same longest length carried on from one to the next, never beyond the pieces
there are; what remains is placed by best fit, longest first, into gaps and new sequences, group
by group instead of piece by piece.

Pieces find their place without a group in one task: a piece's rank among the pieces of its
length is an offset of its task (a prefix sum over a table of tasks by lengths) plus its rank
inside the task, and ranks map to sequences through the broadcast plan, whose size is bounded
by the number of lengths.

Defined cases: null or empty text: a document of one piece, its end token alone; a text longer
than the capacity is cut into pieces of exactly the capacity but for the first, which holds
the remainder; rows with equal or null doc_id are packed as separate documents; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, prepare, release_memory, require_columns, slices

CAPACITY = 2048
END_ID = 0
#: Lengths that a round covers from, the share of a length's need that a configuration may cover at a time,
#: how much more a long piece's token weighs at first, and the rate of the weights.
FRONT, STEP, LONGER, RATE = 16, 0.3, 0.1, 0.05
#: A configuration of short pieces that leaves more of a sequence free than this goes to best fit.
GAP = 0.002
#: Shares of a length's need below this count as covered.
TINY = 1e-9
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``total`` ids."""
    first = total % capacity or capacity
    ends = [first, *range(first + capacity, total + 1, capacity)] if total > capacity else [total]
    return [(s, e - s) for s, e in zip([0, *ends], ends)]


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, task, seen = encoder(path).ids, TaskContext.get().partitionId(), Counter()
        end = int(end_id).to_bytes(4, "little")
        for batch in (part for whole in batches for part in slices(whole)):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = encode(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), task, seen[length], *([part] if with_ids else [])))
                    seen[length] += 1
            if rows:
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names[: len(columns)])
        release_memory()

    return run


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``task`` and ``nth`` number the pieces of a length inside a task.
    ``with_ids`` adds the ids of each piece as little-endian uint32 bytes."""
    prepare(docs.sparkSession)
    require_columns(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_tokenise(tokenizer, capacity, end_id, with_ids), PIECES + (", ids binary" if with_ids else ""))


# ---- the plan, over the histogram of lengths only


def _table(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest weight within each capacity, and the index of a length that reaches it (-1: none)."""
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if n:
            value = best[c - lengths[:n]] + weights[:n]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], chosen[c] = value[k], k
    return best, chosen


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest weight: an unbounded knapsack by dynamic programming."""
    _, chosen = _table(weights, lengths, capacity)
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            out[int(lengths[chosen[c]])] += 1
            c -= int(lengths[chosen[c]])
    return dict(out)


def _holding(k: int, best: np.ndarray, chosen: list[int], filled: list[int], weights: np.ndarray, lengths: np.ndarray, sizes: list[int],
             left: list[float], least: list[float], capacity: int) -> dict[int, int]:
    """The configuration of greatest weight that holds length number ``k``; where a length is used
    up, the next best one takes its place. ``filled``: the greatest capacity up to each that a
    choice ends at."""
    out = {k: 1}
    c = filled[capacity - sizes[k]]
    while c > 0:
        j = chosen[c]
        if left[j] <= least[j]:
            n = int(np.searchsorted(lengths, c, side="right"))
            value = np.where(np.array(left[:n]) > np.array(least[:n]), best[c - lengths[:n]] + weights[:n], -1.0)
            j = int(value.argmax())
            if value[j] < 0:
                break
        out[j] = out.get(j, 0) + 1
        c = filled[c - sizes[j]]
    return out


def solve(histogram: dict[int, int], capacity: int, rate: float = RATE) -> tuple[dict[tuple, float], float]:
    """A fractional solution of the linear program by multiplicative weights: configurations, as
    pairs (length, copies) from the longest on, with how often each is taken; it covers every
    length exactly. And a lower bound of the number of sequences, from the dual."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    left, logs = need.copy(), np.log1p(LONGER * lengths / capacity)
    # weights of which no configuration holds more than one are a solution of the dual
    bound = max(float(lengths @ need) / capacity, float(need[2 * lengths > capacity].sum()))
    taken: Counter = Counter()
    while left.any():
        live = np.flatnonzero(left)
        sizes, wanted = lengths[live], need[live]
        weights = sizes / capacity * np.exp(logs[live])
        best, chosen = _table(weights, sizes, capacity)
        if len(live) == len(lengths):
            bound = max(bound, float(weights @ wanted / best[capacity]))
        filled = np.maximum.accumulate(np.where(chosen >= 0, np.arange(capacity + 1), 0)).tolist()
        names, choice, count = sizes.tolist(), chosen.tolist(), left[live].tolist()
        least, most = (TINY * wanted).tolist(), (STEP * wanted).tolist()
        for k in range(len(live) - 1, max(-1, len(live) - 1 - FRONT), -1):
            while count[k] > least[k]:
                config = _holding(k, best, choice, filled, weights, sizes, names, count, least, capacity)
                # no length is covered beyond its need, nor by more than a share of it at a time
                times = min(min(count[i], most[i]) / copies for i, copies in config.items())
                for i, copies in config.items():
                    count[i] -= times * copies
                taken[tuple((names[i], n) for i, n in sorted(config.items(), reverse=True))] += times
        now = np.array(count)
        now[now <= TINY * wanted] = 0.0
        covered = (left[live] - now) / wanted
        logs[live] -= rate * (covered - covered.mean())
        left[live] = now
    return dict(taken), bound


def rounded(taken: dict[tuple, float], histogram: dict[int, int], capacity: int, carry: bool, gap: float, least: float) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations near the fractional ones, within the histogram: with
    ``carry``, fractions go on to the next configuration with the same longest length.
    Configurations that leave more than ``gap`` free are left to best fit, unless a piece longer
    than half a sequence makes the gap, and so are those taken fewer than ``least`` times."""
    left, out, carried = dict(histogram), [], {}
    for config, times in sorted(taken.items(), key=lambda c: (c[0][0][0], c[1]), reverse=True):
        longest = config[0][0]
        if times < least or (capacity - sum(k * n for k, n in config) > gap and 2 * longest <= capacity):
            continue
        total = carried.get(longest, 0.0) + times + TINY
        whole = min(int(total), min(left[k] // n for k, n in config))
        carried[longest] = total - TINY - whole if carry else 0.0
        if whole:
            out.append((dict(config), whole))
            for k, n in config:
                left[k] -= whole * n
    return out


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, figures: dict | None = None,
                   rate: float = RATE) -> list[tuple[dict[int, int], int]]:
    """Whole configurations with their multiplicities that hold exactly the histogram. ``figures``
    takes the value of the fractional solution (``lp``) and the dual bound (``bound``), both with the
    pieces as long as a sequence, the share of the shorter pieces that the rounded solution places
    (``lp_share``), and how far the number of sequences is above the bound (``gap``)."""
    wanted = {k: v for k, v in histogram.items() if v > 0}
    if any(k > capacity or k <= 0 for k in wanted):
        raise ValueError("a piece is longer than a sequence")
    full = wanted.pop(capacity, 0)
    taken, bound = solve(wanted, capacity, rate) if wanted else ({}, 0.0)
    # of a few ways to round, that of the fewest sequences, then that which places the most; of a
    # handful of pieces the last one takes next to nothing from the fractions
    ways = [(carry, gap, 0.0) for carry in (True, False) for gap in (capacity, GAP * capacity)] + [(False, GAP * capacity, x) for x in (4.0, 64.0)]
    plan, placed = min((_filled(rounded(taken, wanted, capacity, *way), wanted, capacity) for way in ways), key=lambda p: (sum(p[0].values()), -p[1]))
    if full:
        plan[((capacity, 1),)] += full
    if figures is not None:
        figures |= {"lp": sum(taken.values()) + full, "bound": bound + full, "lp_share": placed / max(sum(wanted.values()), 1),
                    "gap": sum(plan.values()) / (bound + full) - 1 if bound + full else 0.0}
    return [(dict(k), v) for k, v in sorted(plan.items(), reverse=True)]


def _filled(configs: list[tuple[dict[int, int], int]], histogram: dict[int, int], capacity: int) -> tuple[Counter, int]:
    """The configurations, with what remains of the histogram placed by best fit; and the number
    of pieces that they placed themselves."""
    left, groups = dict(histogram), {}  # groups: free tokens -> [configuration, multiplicity]

    def put(config: dict[int, int], times: int):
        free = capacity - sum(k * v for k, v in config.items())
        groups.setdefault(free, []).append([config, times])

    for config, times in configs:
        put(config, times)
        for k, v in config.items():
            left[k] -= times * v
    placed = sum(histogram.values()) - sum(left.values())
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = [f for f, g in groups.items() if f >= length and g]
            if fits:
                config, times = groups[min(fits)].pop()
                used = min(n, times)
                if times > used:
                    put(config, times - used)
                put({**config, length: config.get(length, 0) + 1}, used)
                n -= used
            else:
                each = min(n, capacity // length)
                put({length: each}, n // each)
                n -= n // each * each
    plan: Counter = Counter()
    for g in groups.values():
        for config, times in g:
            plan[tuple(sorted(config.items(), reverse=True))] += times
    return plan, placed


def _places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first copy)."""
    rows, taken, sequence = [], Counter(), 0
    for config, times in plan:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            rows.append((length, taken[length], sequence, copies, offset))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _assign(places: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] * (1 << 48) + places[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = places[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)],
                                             names=[batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece; with
    ``with_ids`` also the ids. Sequences are filled without gaps from offset 0."""
    pieces = materialize(tokenise(docs, tokenizer, capacity, end_id, with_ids), "pack-pieces")
    by_task = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(pack_histogram(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("first"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(first, ["task", "length"]).select(*columns, (F.col("first") + F.col("nth")).alias("rank"))
    schema = PIECES.replace(", task int, nth long", "") + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(places), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from ``pack(with_ids=True)``. A
    group holds no more than one sequence."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts.ids, X'', (a, b) -> concat(a, b))").alias("ids"))
