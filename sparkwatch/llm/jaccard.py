"""Exact similarity join of word-shingle sets by universe partition and the pigeonhole rule.

Two sets r, s with Jaccard at least t differ in at most H = floor((1 - t) / (1 + t) (|r| + |s|))
elements. A hash deals the universe of shingles into m segments, m by size band; a
difference of at most H over m segments leaves some segment i with fewer than v_i differences
whenever the v_i add up to H + 1. With v_i = 1 that segment is equal in both sets; with
v_i = 2 it is equal or differs in one element, which the one-deletion neighbourhood of the
segment finds. So each set is indexed by the hashes of its segments (and the one-deletion
neighbourhood of the first) in its own band, and probes, in the bands of its possible
partners, the segments that its allocation chooses. The allocation takes the cheapest
segments that add up to H + 1; the cost of a segment is how many sets are expected to share
it, from how common its rarest shingle is in a bounded sample (empty segments cost most).
Costs only steer the work: every allocation finds all pairs. Candidates are verified on the
whole sets.

On Spark: equal sets are one class before anything is compared. Tasks write their signatures
as columnar blocks dealt by signature range; a range is sorted in one task. Of the sets that
share a signature, each is first paired with the smallest one only; the verified links make
components. Where a signature's sets still lie in different components, each is paired with
the medoid, the set nearest to the bitwise majority of their sketches (the text that near
copies were made from, or one next to it); and then only pairs of sets that share a signature
and lie in different components remain to be verified. So a group of thousands of near copies
costs a few pairs per set and signature, not all its pairs. A parity sketch (a bit per hash value, set if an odd number of
elements has it) bounds the difference of two sets from below, and drops candidates that
can't reach the threshold before any set is moved. Verification groups pairs by the set with
more partners, large groups salted, and streams the partners past it; sets are made anew from the
texts of the sets involved, so no table of all sets is stored. The sets of a signature are dealt
in blocks: each block names a medoid, the medoid of these meets every block, and then pairs of
blocks meet.

Sets are held as 64-bit hashes of shingles; "exact" is up to collisions of these hashes.

Defined cases: null or empty text or one without words: an empty set, linked with nothing;
with fewer words than a shingle: the whole sequence is the only shingle; repeated rows and
texts with equal sets are linked; rows without id get no component and link nothing; several
rows with one id are linked each by its own text; an empty table gives an empty result; extra
columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, materialize, mix64, partitions, prepare, release_memory, require_columns, slices, text_bytes
from .components import components

WORDS, PERCENT = 5, 80
#: Documents of the sample that costs are drawn from, and how many of them make a shingle common.
SAMPLE_DOCS, COMMON = 2_000, 3
#: Bytes of text hashed at once, signatures of a range, signatures a task gathers per block.
TEXT_CHUNK, RANGE_SIGNATURES, GATHER = 1_000_000, 800_000, 600_000
#: Sets that a task remembers, so as to index copies once.
REMEMBERED = 50_000
#: Partners of a set that one task verifies; rows of a table that may be broadcast.
GROUP, BROADCAST_ROWS = 1_000, 300_000
#: Errands of a row, bytes of sets sent at once, sets of a signature in a block.
ERRANDS, SEND_BYTES, MEMBERS = 1_000, 16_000_000, 4_096
# what a signature row stands for
INDEX, PROBE, INDEX_DELETED, PROBE_DELETED = 1, 2, 4, 8

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


# ---- shingle sets


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_P), -1, 1 << 64))
    return np.cumprod(np.full(n, _P)), np.cumprod(np.full(n, inverse))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of at most TEXT_CHUNK bytes: differences of a running sum of
    byte times power, scaled back by the power of the place."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, dtype=_U)
    up, down = _powers(1 << max(len(raw) - 1, 1).bit_length())
    total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)])])
    return start, mix64((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of lower-cased UTF-8 bytes of any length, cut at white space."""
    if len(data) <= TEXT_CHUNK:
        return _hash_words(data)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = at + TEXT_CHUNK
        if end < len(data):
            cut = max(data.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # one word beyond the chunk
                ahead = [x for x in (data.find(b, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                cut = min(ahead, default=len(data))
            end = cut + 1
        start, h = _hash_words(data[at:end])
        starts.append(start + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places of the texts, sizes, elements): the sets of the texts, in chunks; each set is a
    sorted run of distinct hashes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < TEXT_CHUNK):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        start, h = word_hashes(b" ".join(part).lower())
        bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in part]))
        rolled = h[: max(len(h) - words + 1, 0)].copy()
        for k in range(1, words):
            rolled = rolled * _P + h[k : k + len(rolled)]
        rolled = mix64(rolled)
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= words:
                sets.append(np.unique(rolled[a : b - words + 1]))
            else:
                one = _U(b - a)
                for x in h[a:b]:
                    one = _mul(one, x)
                sets.append(mix64(np.array([one], dtype=_U)) if b > a else np.zeros(0, dtype=_U))
        yield list(range(at, end)), np.array([len(s) for s in sets], dtype=np.int64), np.concatenate(sets)
        at = end


def _mul(one: np.uint64, x: np.uint64) -> np.uint64:
    return _U((int(one) * int(_P) + int(x)) & 0xFFFFFFFFFFFFFFFF)


def _sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of uint64 values by group, modulo 2**64 (halves add up exactly in doubles)."""
    low = np.bincount(groups, (values & _U(0xFFFFFFFF)).astype(np.float64), n).astype(_U)
    high = np.bincount(groups, (values >> _U(32)).astype(np.float64), n).astype(_U)
    return (high << _U(32)) + low


def prints(sizes: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's elements: with the size, a set's identity."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return _sums(owner, mix64(elements), len(sizes)), _sums(owner, mix64(elements ^ _P), len(sizes))


def sketches(sizes: np.ndarray, elements: np.ndarray) -> list[bytes]:
    """The parity sketch of each set: about a bit per element, a power of two of bits."""
    bits = 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = offset[owner] + (mix64(elements + _U(2)) & (bits[owner] - 1).astype(_U)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(offset[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(offset[:-1], offset[1:])]


def fold(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as 64-bit words, folded to ``size`` bytes: the parity of fewer, coarser values."""
    x = np.frombuffer(sketch, dtype=_U)
    return np.bitwise_xor.reduce(x.reshape(-1, size // 8), axis=0)


# ---- size bands and signatures


class Bands:
    """Size bands and the number of segments of each, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def differences(self, total):
        """H for two sizes that add up to ``total``."""
        return (100 - self.percent) * total // (100 + self.percent)

    def lower(self, size):
        """The smallest partner of a set."""
        return -(-self.percent * size // 100)

    def _reach(self, band: int) -> None:
        while len(self.lows) <= band + 1:
            low = self.lows[-1]
            self.lows.append(max(low + 1, -(-100 * low // self.percent)))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self.lows[-1] <= sizes.max(initial=0):
            self._reach(len(self.lows))
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def high(self, band):
        self._reach(int(np.max(band, initial=0)))
        return np.array(self.lows)[np.asarray(band) + 1] - 1

    def segments(self, band: np.ndarray) -> np.ndarray:
        """H + 1 for the band's largest pair, and some more, so that costly ones can be left out."""
        high = self.high(band)
        h = self.differences(high + 100 * high // self.percent)
        return np.where(h > 0, h + 1 + -(-h // 20), 0)


def signatures(sizes: np.ndarray, elements: np.ndarray, bands: Bands, common: tuple[np.ndarray, np.ndarray]):
    """(set number, key, flags) arrays of the signatures of all sets of a chunk."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own_band = bands.of(sizes)
    hashed = mix64(elements + _U(1))
    commonness = np.zeros(len(elements), dtype=np.float32)
    if len(common[0]) and len(elements):
        at = np.minimum(np.searchsorted(common[0], elements), len(common[0]) - 1)
        commonness = np.where(common[0][at] == elements, common[1][at], 0).astype(np.float32)
    lowest = bands.of(np.maximum(bands.lower(sizes), 1))
    depth = int((own_band - lowest).max(initial=0))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for back in range(depth + 1):
        band = own_band - back
        active = (sizes > 0) & (band >= lowest)
        m = np.where(active, bands.segments(np.maximum(band, 0)), 0)
        if not m.any():
            continue
        offset = np.concatenate([[0], np.cumsum(m)])
        total = int(offset[-1])
        mine = active[owner] & (m[owner] > 0)
        who, element = owner[mine], hashed[mine]
        place = ((element >> _U(32)) * m[who].astype(_U) >> _U(32)).astype(np.int64)
        slot = offset[who] + place
        content = _sums(slot, element, total)
        count = np.bincount(slot, minlength=total)
        # the sets expected to share a segment: as many as its rarest shingle; all, if empty
        rare = np.full(total, np.inf, dtype=np.float32)
        np.minimum.at(rare, slot, commonness[mine])
        seg_owner = np.repeat(np.arange(len(sizes)), m)
        seg = np.arange(total) - offset[seg_owner]
        cost = np.where(count == 0, 1e9, 1.0 + np.where(np.isinf(rare), 0, rare) + 1.0 / (1.0 + count))
        salt = mix64((band[seg_owner].astype(_U) << _U(32)) + seg.astype(_U))
        key = mix64(content + salt)
        # the allocation: H + 1 increments of least cost; the first segment can take a second
        high = np.minimum(bands.high(np.maximum(band, 0)), sizes)
        need = np.where(m > 0, bands.differences(sizes + high) + 1, 0)
        first = offset[:-1][m > 0]
        sets = np.flatnonzero(m > 0)
        second = np.maximum((1 + count[first]) * 4.0 + cost[first], cost[first])
        all_owner, all_cost = np.concatenate([seg_owner, sets]), np.concatenate([cost, second])
        order = np.lexsort((all_cost, all_owner))
        rank = np.arange(len(order)) - np.concatenate([[0], np.cumsum(np.where(m > 0, m + 1, 0))])[all_owner[order]]
        chosen = np.zeros(len(order), dtype=bool)
        chosen[order] = rank < need[all_owner[order]]
        probe, doubled = chosen[:total], np.zeros(len(sizes), dtype=bool)
        doubled[sets] = chosen[total:]
        # no second increment without the first
        probe[first] |= doubled[sets]
        flags = np.where(probe, PROBE, 0) | (INDEX if back == 0 else 0)
        emit = flags > 0
        out.append((seg_owner[emit], key[emit], flags[emit]))
        # one-deletion neighbourhoods of first segments: of all in the index, of the doubled as probes
        gone = place == 0
        if back:
            gone &= doubled[who]
        w = who[gone]
        deleted = mix64(content[slot[gone]] - element[gone] + salt[slot[gone]])
        out.append((w, deleted, (INDEX_DELETED if back == 0 else 0) | np.where(doubled[w], PROBE_DELETED, 0)))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U), np.zeros(0, dtype=np.uint8)
    s, k, f = (np.concatenate(x) for x in zip(*out))
    return s.astype(np.int64), k, f.astype(np.uint8)


# ---- tasks


def _scan(words: int, percent: int, common, ranges: int):
    """Texts -> a row per document (part -1: id, size, prints, sketch) and blocks of signatures."""
    names = ["part", "doc_id", "n", "print_a", "print_b", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, known, held, gathered = Bands(percent), set(), [], 0

        def blocks() -> pa.RecordBatch:
            key = np.concatenate([h[0] for h in held])
            rest = [np.concatenate([h[k] for h in held]) for k in (1, 2, 3)]
            part = ((key >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=ranges))
            rows = []
            for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                if b > a:
                    o = order[a:b]
                    rows.append((p, pack_block(key[o], *(r[o] for r in rest))))
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), none, none, none, none, pa.array([r[1] for r in rows], pa.binary())], names=names)

        for batch in (part for whole in batches for part in slices(whole)):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for at, sizes, elements in shingle_sets(texts, words):
                a, b = prints(sizes, elements)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), -1), pa.int32()), ids.slice(at[0], len(at)), pa.array(sizes),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sketches(sizes, elements), pa.binary())], names=names)
                # sets seen in this task are indexed already; the memory of them is bounded
                fresh = np.zeros(len(sizes), dtype=bool)
                for k, one in enumerate(zip(sizes.tolist(), a.tolist(), b.tolist())):
                    if one[0] and one not in known and ids[at[k]].is_valid:
                        known.add(one)
                        fresh[k] = True
                if len(known) > REMEMBERED:
                    known.clear()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                s, key, flags = signatures(sizes[fresh], elements[fresh[owner]], bands, common)
                if len(key):
                    held.append((key, a[fresh][s], sizes[fresh][s].astype(np.uint32), flags))
                    gathered += len(key)
                if gathered > GATHER:
                    yield blocks()
                    held, gathered = [], 0
                    release_memory()
        if held:
            yield blocks()
        release_memory()

    return run, "part int, doc_id long, n long, print_a long, print_b long, block binary"


def pack_block(key, ident, size, flags) -> bytes:
    """Signatures as columns: keys, then each set once, and which set each key is of."""
    sets, first, which = np.unique(ident, return_index=True, return_inverse=True)
    return b"".join([np.array([len(key), len(sets)], dtype="<u8").tobytes(), key.tobytes(), sets.tobytes(), size[first].astype("<u4").tobytes(),
                     which.astype("<u2" if len(sets) < 1 << 16 else "<u4").tobytes(), flags.astype(np.uint8).tobytes()])


def unpack_block(data: bytes):
    n, m = (int(x) for x in np.frombuffer(data, "<u8", 2))
    at = 16
    out = []
    for kind, k in (("<u8", n), ("<u8", m), ("<u4", m), ("<u2" if m < 1 << 16 else "<u4", n), ("u1", n)):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    return out


def _shared_rows(blocks: list[bytes]):
    """The rows (key, set, size, flags) of the blocks whose key occurs more than once. Keys are
    sorted alone, and the other columns read for the few rows that go on."""
    columns = [unpack_block(b) for b in blocks]
    key = np.concatenate([c[0] for c in columns])
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    keep = np.zeros(len(key), dtype=bool)
    keep[order[1:][same]] = keep[order[:-1][same]] = True
    del order, key, same
    rows, at = [], 0
    for k, sets, size, which, flags in columns:
        i = np.flatnonzero(keep[at : at + len(k)])
        at += len(k)
        rows.append((k[i], sets[which[i]], size[which[i]], flags[i]))
    return [np.concatenate([r[c] for r in rows]) for c in range(4)]


def _matches(p, i):
    """Whether a probe with flags p finds an index entry with flags i."""
    return (((p & PROBE) > 0) & ((i & (INDEX | INDEX_DELETED)) > 0)) | (((p & PROBE_DELETED) > 0) & ((i & INDEX) > 0))


def valid_pairs(percent: int, n_a, f_a, n_b, f_b):
    """Whether sets of these sizes, with these flags on a shared signature, are candidates."""
    similar = (100 * np.minimum(n_a, n_b).astype(np.int64) >= percent * np.maximum(n_a, n_b).astype(np.int64))
    return similar & (((n_a >= n_b) & _matches(f_a, f_b)) | ((n_b >= n_a) & _matches(f_b, f_a)))


PAIR_NAMES = ["key", "a", "b", "flags", "n"]


def _pair_rows(key, a, b, flags, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(flags, pa.int32()), pa.array(n, pa.int64())], names=PAIR_NAMES)


def _stars(percent: int):
    """Signature blocks of a range -> pairs with the smallest set of each signature (flags 0),
    and the groups of three sets or more (a = set, b = the smallest, flags 2 for probes and 1
    for others, size). A group's key is a hash of its members, as many signatures share them."""
    def close(parts):
        key, ident, size, flags = _shared_rows(parts)
        order = np.lexsort((ident, key))
        key, ident, size, flags = key[order], ident[order], size[order], flags[order]
        # one row for each set of a key, with all its flags
        head = np.concatenate([[True], (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])]) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        if not len(at):
            return
        flags = np.bitwise_or.reduceat(flags, at)
        key, ident, size = key[at], ident[at], size[at]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        members = np.diff([*start, len(key)])
        center = np.repeat(start, members)
        other = np.arange(len(key)) != center
        fits = other & valid_pairs(percent, size[center], flags[center], size, flags)
        pairs = np.unique(np.stack([ident[center][fits].view(np.int64), ident[fits].view(np.int64)], axis=1), axis=0)
        zero = np.zeros(len(pairs), dtype=np.int64)
        yield _pair_rows(zero, pairs[:, 0], pairs[:, 1], zero, zero)
        probe = (flags & (PROBE | PROBE_DELETED)) > 0
        nth = np.repeat(np.arange(len(start)), members)
        group = mix64(_sums(nth, mix64(ident ^ (probe.astype(_U) << _U(63))), len(start)) + members.astype(_U))
        first = np.zeros(len(start), dtype=bool)
        first[np.unique(group, return_index=True)[1]] = True
        left = (first & (members > 2) & np.logical_or.reduceat(probe, start))[nth]
        yield _pair_rows(group[nth][left].view(np.int64), ident[left].view(np.int64), ident[center][left].view(np.int64),
                         (1 + probe[left]).astype(np.int32), size[left].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts = None, []
        for batch in batches:
            for p, block in zip(batch.column("part").to_pylist(), batch.column("block")):
                if p != part:
                    if parts:
                        yield from close(parts)
                        release_memory()
                    part, parts = p, []
                parts.append(block.as_py())
        if parts:
            yield from close(parts)
        release_memory()

    return run, "key long, a long, b long, flags int, n long"


def _plausible(percent: int):
    """Pairs (a, b) with sizes and sketches of both -> those whose sketches allow the threshold."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = bands.differences(batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy())
            keep = []
            for x, y, h in zip(batch.column("sketch_a"), batch.column("sketch_b"), most):
                x, y = x.as_buffer(), y.as_buffer()
                size = min(x.size, y.size)
                keep.append(int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= h)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run, "a long, b long"


def _medoid(sketch: np.ndarray) -> int:
    """The row nearest to the bitwise majority."""
    raw, count = sketch.view(np.uint8), 0
    for i in range(0, len(raw), 4096):
        count = count + np.unpackbits(raw[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * count > len(raw)).view(_U)
    return int(np.bitwise_count(sketch ^ majority).sum(axis=1).argmin())


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one group after another, of batches sorted by the columns ``names``."""
    key, rows = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for s, e in zip([0, *edges], [*edges, len(keys)]):
            if s == e:
                continue
            if key is None or (keys[s] != key).any():
                if rows:
                    yield rows
                key, rows = keys[s], []
            rows.append(batch.slice(s, e - s))
    if rows:
        yield rows


def _sketches(rows: list[pa.RecordBatch]) -> np.ndarray:
    raw = [x for r in rows for x in r.column("sketch").to_pylist()]
    size = min(len(x) for x in raw)
    return np.stack([fold(x, size) for x in raw])


def _medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (key, block) after another -> the medoid of each."""
    for rows in _runs(batches, ["key", "block"]):
        k = _medoid(_sketches(rows))
        for r in rows:
            if k < r.num_rows:
                yield r.slice(k, 1)
                break
            k -= r.num_rows


def _across(percent: int, stars: bool):
    """Rows of one group after another (key, block, other, side, a, b = the smallest set of the
    key, flags, n, component, sketch) -> pairs of sets in different components whose sketches
    allow the threshold; with ``stars`` only those with the medoid. Where rows of side 1 are in a
    group, pairs of one of them and one of side 0."""
    bands = Bands(percent)

    def close(rows):
        a, b, flags, n, component, side = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("a", "b", "flags", "n", "component", "side"))
        sketch = _sketches(rows)
        found = [np.zeros((0, 2), dtype=np.int64)]
        step = max(1, 200_000 // len(a))
        two = side.any()
        if stars and not two:
            parts = [np.array([_medoid(sketch)])]
        else:
            first = np.flatnonzero(side == 1) if two else np.arange(len(a))
            parts = np.split(first, range(step, len(first), step))
        for i in parts:
            fits = (component[i, None] != component) & ((flags[i, None] | flags) > 1)
            fits &= 100 * np.minimum(n[i, None], n) >= percent * np.maximum(n[i, None], n)
            # each pair once; the smallest set's pairs are verified already
            fits &= ((side == 0) if two else (a[i, None] != a) if stars else (a[i, None] < a)) & (a != b) & (a[i, None] != b)
            x, y = np.nonzero(fits)
            x = i[x]
            # sketches of pairs in steps of bounded bytes, whatever their number and size
            per = max(1, SEND_BYTES // sketch[0].nbytes)
            near = np.concatenate([np.bitwise_count(sketch[x[j : j + per]] ^ sketch[y[j : j + per]]).sum(axis=1) for j in range(0, max(len(x), 1), per)])
            near = near <= bands.differences(n[x] + n[y])
            found.append(np.stack([np.minimum(a[x], a[y]), np.maximum(a[x], a[y])], axis=1)[near])
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["key", "block", "other"]):
            pairs = close(rows)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return run, "a long, b long"


def _deal(shared: DataFrame, medoids: bool) -> DataFrame:
    """Rows of signatures (key, a, blocks, ...), blocks = how many blocks the key's sets are cut
    into, to the groups (key, block, other) in which they meet the medoid, or each other."""
    home = shared.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")))
    zero = F.lit(0).cast("long")
    if not medoids:
        # a block meets itself and every other one; of two, the later one is side 1
        met = home.withColumn("c", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        return met.withColumn("side", (F.col("block") > F.col("c")).cast("int")).withColumn("other", F.greatest("block", "c")).withColumn(
            "block", F.least("block", "c")).drop("c", "blocks")
    dealt = home.withColumn("other", zero).withColumn("side", F.lit(0))
    named = dealt.where("blocks > 1")
    for block in (None, zero):  # of each block, and of the medoids of the blocks
        named = named if block is None else named.withColumn("block", block)
        named = named.repartition("key", "block").sortWithinPartitions("key", "block", "a").mapInArrow(_medoids, named.schema)
    pivots = named.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("side", F.lit(1))
    return dealt.unionByName(pivots).drop("blocks")


def _send_sets(words: int):
    """Texts with their errands -> the set, once for each group it is verified in."""
    def sent(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["center", "salt", "partner", "ident", "elements"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 200)):
            idents, errands = batch.column("ident").to_numpy(), batch.column("errands").to_pylist()
            for at, sizes, elements in shingle_sets(batch.column("text").to_pylist(), words):
                a, _ = prints(sizes, elements)
                ends = np.cumsum(sizes)
                rows, held = [], 0
                for k, i in enumerate(at):
                    # another row with the same id may hold another text
                    if a[k].view(np.int64) == idents[i]:
                        data = elements[ends[k] - sizes[k] : ends[k]].tobytes()
                        for e in errands[i]:
                            rows.append((e["center"], e["salt"], e["partner"], idents[i], data))
                            held += len(data)
                            if held > SEND_BYTES:
                                yield sent(rows)
                                rows, held = [], 0
                if rows:
                    yield sent(rows)

    return run, "center long, salt int, partner int, ident long, elements binary"


def _verify(percent: int):
    """Groups (center first, then partners) -> the pairs that reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, center = None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("center", "salt", "partner", "ident")]
            for c, salt, partner, ident, data in zip(*columns, batch.column("elements")):
                x = np.frombuffer(data.as_buffer(), dtype=_U)
                if (c, salt) != key:
                    key, center = (c, salt), None
                if not partner:
                    center = x
                elif center is None:
                    raise ValueError(f"the set {c} didn't come with its partners")
                else:
                    at = np.minimum(np.searchsorted(center, x), len(center) - 1)
                    common = int((center[at] == x).sum())
                    if 100 * common >= percent * (len(center) + len(x) - common):
                        a.append(c)
                        b.append(ident)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release_memory()

    return run, "a long, b long"


# ---- the join


def _common(docs: DataFrame, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several documents of the sample share, and in how many. The
    sample is all documents whose hashed id falls into the first of rows / SAMPLE_DOCS classes."""
    classes = max(1, rows // SAMPLE_DOCS)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(classes)) == 0).select(text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, elements in shingle_sets(batch.column("text").to_pylist(), words):
                h, n = np.unique(elements, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    found = drawn.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    top = found.orderBy(F.desc("n"), "h").limit(100_000).collect()
    h = np.array([r["h"] for r in top], dtype=np.int64).view(_U)
    order = np.argsort(h)
    return h[order], np.array([r["n"] for r in top], dtype=np.float32)[order] * classes


def _errands(pairs: DataFrame) -> DataFrame:
    """(print_a, slot, errands): to which groups a set goes, ERRANDS of them a row. The set with
    more partners is the centre of a pair, and goes to a group for each GROUP of them or so."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    both = pairs.select("a", "b").join(degree.toDF("a", "k_a"), "a").join(degree.toDF("b", "k_b"), "b")
    first = F.col("k_a") >= F.col("k_b")
    sided = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("center"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"),
                        F.ceil(F.greatest("k_a", "k_b") / GROUP).alias("salts"), F.ceil(F.least("k_a", "k_b") / ERRANDS).alias("slots"))
    salted = sided.withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int"))
    partners = salted.select(F.col("other").alias("print_a"), F.pmod(F.xxhash64("center"), F.col("slots")).alias("slot"),
                             F.struct("center", "salt", F.lit(1).alias("partner")).alias("e"))
    centers = salted.select("center", "salt").distinct().select(F.col("center").alias("print_a"), F.floor(F.col("salt") / ERRANDS).alias("slot"),
                                                                F.struct("center", "salt", F.lit(0).alias("partner")).alias("e"))
    return partners.unionByName(centers).groupBy("print_a", "slot").agg(F.collect_list("e").alias("errands"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of sets that reach the threshold."""
    errands = materialize(_errands(pairs).join(classes.select("print_a", "rep"), "print_a").select(
        F.col("rep").alias("doc_id"), F.col("print_a").alias("ident"), "errands"), "join-errands")
    n = errands.agg(F.coalesce(F.sum(F.size("errands")), F.lit(0)).alias("n")).first()["n"]
    send = F.broadcast(errands) if n <= BROADCAST_ROWS else errands
    texts = docs.select("doc_id", text_bytes().alias("text")).join(send, "doc_id")
    run, schema = _send_sets(words)
    sets = texts.select("ident", "text", "errands").mapInArrow(run, schema)
    dealt = sets.repartition(partitions(n, 1_000, 12), "center", "salt").sortWithinPartitions("center", "salt", "partner")
    run, schema = _verify(percent)
    links = materialize(dealt.mapInArrow(run, schema).distinct(), "join-links")
    discard(errands)
    return links


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text): documents
    whose sets have a Jaccard similarity of at least ``percent`` / 100 are linked."""
    rows, grouped = _linked(docs, words, percent)
    # sets -> documents: the smallest id of all classes of a component
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.join(smallest, "component").select("print_a", "print_b", "n", "component_id")
    linked = rows.where("n > 0 and doc_id is not null").join(named, ["print_a", "print_b", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, print_a, print_b) of every row, and (print_a, print_b, n, rep, component) of
    every set: its smallest doc_id, and the component of sets that it is in."""
    prepare(docs.sparkSession)
    require_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # a set has about as many signatures as its pairs differ, in its own band and the next lower one
    expected = (size["bytes"] or 0) / 6 * 2.2 * (100 - percent) / percent
    ranges = partitions(int(expected), RANGE_SIGNATURES, 12)
    run, schema = _scan(words, percent, _common(docs, size["n"], words), ranges)
    found = materialize(docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, schema), "join-signatures")
    rows = found.where("part < 0").select("doc_id", "n", "print_a", "print_b", F.col("block").alias("sketch"))
    classes = materialize(rows.where("n > 0 and doc_id is not null").groupBy("print_a", "print_b", "n").agg(
        F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "join-classes")
    rows = materialize(rows.drop("sketch"), "join-rows")
    run, schema = _stars(percent)
    blocks = found.where("part >= 0").select("part", "block").repartition(ranges, "part").sortWithinPartitions("part")
    stars = materialize(blocks.mapInArrow(run, schema), "join-stars")
    discard(found)
    sets = [classes.select(F.col("print_a").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    run, schema = _plausible(percent)
    likely = stars.where("flags = 0").select("a", "b").distinct().join(sets[0], "a").join(sets[1], "b").mapInArrow(run, schema)
    likely = materialize(likely, "join-likely")
    groups, done = materialize(stars.where("flags > 0").distinct(), "join-groups"), None
    discard(stars)
    near = _verified(docs, classes, likely, words, percent)
    parts = components(near)
    for medoids in (True, False):
        # groups whose sets lie in different components
        entries = groups.join(parts.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        mixed = entries.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / MEMBERS).alias("blocks"))
        mixed = mixed.where("x <> y").select("key", "blocks")
        shared = entries.join(mixed, "key").join(sets[0].select("a", F.col("sketch_a").alias("sketch")), "a")
        run, schema = _across(percent, medoids)
        met = _deal(shared, medoids).repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "a")
        more = met.mapInArrow(run, schema).distinct()
        more = materialize(more if done is None else more.join(done, ["a", "b"], "left_anti"), "join-across")
        if not more.isEmpty():
            near = near.unionByName(_verified(docs, classes, more, words, percent))
            parts = components(near)
        done = more
    grouped = classes.drop("sketch").join(parts.withColumnRenamed("id", "print_a"), "print_a", "left")
    return rows, grouped.withColumn("component", F.coalesce("component", "print_a"))


def _identities(words: int, text: int, names: list[str]):
    """Rows -> the rows with the size and the prints of their sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 200)):
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            for at, sizes, elements in shingle_sets(texts, words):
                a, b = prints(sizes, elements)
                own = [pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*batch.slice(at[0], len(at)).columns, *own], names=[*batch.schema.names, *names])
        release_memory()

    return run


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked ones: that of the smallest id, and of several rows
    with that id and sets of the group, one. Rows without id and rows without words stay. Every
    row is judged by its own text: rows that share an id and belong to different groups, or to
    none, don't touch each other."""
    rows, grouped = _linked(docs, words, percent)
    # of each component one set, and one id that has it
    best = grouped.groupBy("component").agg(F.min(F.struct("rep", "print_a", "print_b", "n")).alias("w"))
    best = materialize(best.select(F.col("w.rep").alias("doc_id"), "w.print_a", "w.print_b", "w.n"), "join-kept")
    known = rows.where("doc_id is not null")
    several = materialize(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"), "join-several")
    # an id of one row is decided by the id alone
    gone = known.where("n > 0").join(several, "doc_id", "left_anti").join(best, ["doc_id", "print_a", "print_b", "n"], "left_anti")
    gone = materialize(gone.select("doc_id"), "join-gone")

    def listed(frame: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        name = free_name(docs, "listed_id")
        named = ids.select(F.col("doc_id").alias(name))
        return frame.join(F.broadcast(named) if ids.count() <= BROADCAST_ROWS else named, F.col("doc_id") == F.col(name), how)

    if several.isEmpty():
        return listed(docs, gone, "left_anti")
    single = listed(listed(docs, several, "left_anti"), gone, "left_anti")
    # ids of several rows: each row by its own set
    again = listed(docs, several, "left_semi")
    names = [free_name(docs, x) for x in ("set_n", "set_a", "set_b")]
    schema = T.StructType([*again.schema.fields, *(T.StructField(x, T.LongType()) for x in names)])
    marked = again.mapInArrow(_identities(words, docs.columns.index("text"), names), schema)
    n, a, b = (F.col(x) for x in names)
    other = [free_name(marked, x) for x in ("best_id", "best_a", "best_b", "best_n")]
    best = best.toDF(*other)
    mine = (F.col("doc_id").cast("long"), a, b, n)
    on = [x == F.col(y) for x, y in zip(mine, other)]
    one = marked.where(n > 0).join(best, on, "left_semi").dropDuplicates(["doc_id", *names])
    return single.unionByName(marked.where(n == 0).drop(*names)).unionByName(one.drop(*names))
