"""Fill-in-the-middle examples: texts cut into prefix, middle and suffix at unit borders.

A unit is a word with the ASCII white space before it; white space at the end of a text is one
more. Where units end is found without looking at characters one by one: the UTF-8 bytes of a
whole batch are viewed as 64-bit words, arithmetic on words marks the bytes that end a unit
(a byte that isn't white space before one that is, and the last byte of a text), the marks of
each word are counted (``bitwise_count``) and summed up; the k-th end of a text lies in the word
that a search in those sums finds, at the byte that in-word prefix counts give. Code points are
counted the same way, from marks on the bytes that begin one.

Where a text is cut, and the form it takes, follow from the SHA-256 of a seed and its id alone:
``plain`` leaves it as it is, ``psm`` writes prefix, suffix, middle, and ``spm`` suffix, prefix,
middle, each behind its marker. Texts that hold a marker stay plain, so every example can be
read back (``restore``).

Defined cases: null text counts as empty; an empty text is plain with no units; a null doc_id
hashes as the empty string; equal rows give equal examples; a cut may leave any part empty; an
empty table gives an empty result; the result has the columns of the table, then its own, which
replace columns of the same name (whatever its case).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, release_memory, require_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The seed, the percentage of texts that aren't plain, and of these the percentage of form spm.
SEED, TRANSFORMED, SUFFIX_FIRST = 42, 50, 80
#: Bytes of text that one numpy step works on, unless a single text is longer.
STEP_BYTES = 4 << 20

_LOW, _HIGH, _SEVEN = (np.uint64(0x0101010101010101 * x) for x in (0x01, 0x80, 0x7F))
_SPACES = np.uint64(0x0101010101010101 * 0x20)
_FROM_TAB, _PAST_RETURN = (np.uint64(0x0101010101010101 * (0x80 - x)) for x in (0x09, 0x0E))


def white_space(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or 0x09 to 0x0D. No sum carries into another byte."""
    other = words ^ _SPACES
    space = ~(((other & _SEVEN) + _SEVEN) | other)
    low = words & _SEVEN
    between = (low + _FROM_TAB) & ~(low + _PAST_RETURN) & ~words
    return (space | between) & _HIGH


def code_points(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


class Marks:
    """Counting and finding marked bytes of a buffer."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before the byte positions ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte position of the nth mark, from 1."""
        word = np.searchsorted(self.upto[1:], nth)
        left = (nth - self.upto[word]).astype(np.uint64)
        # byte j of the product holds the marks of bytes 0 to j
        prefix = ((self.marks[word] >> np.uint64(7)) & _LOW) * _LOW
        reached = ((prefix | _HIGH) - left * _LOW) & _HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


class Units:
    """The units of texts that stand one after another in a buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = np.zeros((len(data) >> 3) + 2, dtype=np.uint64)
        words.view(np.uint8)[: len(data)] = data
        space = white_space(words)
        after = space >> np.uint64(8)
        after[:-1] |= space[1:] << np.uint64(56)
        ends = ~space & after & _HIGH
        self.starts, self.stops = offsets[:-1], offsets[1:]
        # the last byte of a text ends its last unit, white space or not
        ends.view(np.uint8)[self.stops[self.stops > self.starts] - 1] = 0x80
        self.ends = Marks(ends)
        self.points = Marks(code_points(words))
        self.before = self.ends.rank(self.starts)
        self.counts = self.ends.rank(self.stops) - self.before

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte position behind the first ``units`` units of each text."""
        out = self.starts.copy()
        some = np.flatnonzero(units > 0)
        out[some] = self.ends.select(self.before[some] + units[some]) + 1
        return out

    def length(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.points.rank(stop) - self.points.rank(start)


def draws(seed: int, ids: list) -> np.ndarray:
    """Four 32-bit numbers for each id."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest() for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8)[:, :4].astype(np.int64)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most STEP_BYTES of text, one row at least."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


def _examples(texts: pa.Array, ids: list, seed: int, transformed: int, suffix_first: int) -> list[pa.Array]:
    """n, form, output, prefix_chars, middle_chars of a few texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    units = Units(data, offsets - offsets[0])
    h = draws(seed, ids)
    one, two = h[:, 0] % (units.counts + 1), h[:, 1] % (units.counts + 1)
    first, second = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
    marked = np.zeros(len(texts), bool)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
    plain = (units.counts == 0) | marked | (h[:, 2] % 100 >= transformed)
    spm = h[:, 3] % 100 < suffix_first
    whole = data.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out, form = [], []
    for start, a, b, stop, is_plain, is_spm in zip(*(x.tolist() for x in (units.starts, first, second, units.stops, plain, spm))):
        if is_plain:
            out.append(whole[start:stop])
        elif is_spm:
            out.append(b"".join((s, whole[b:stop], p, whole[start:a], m, whole[a:b])))
        else:
            out.append(b"".join((p, whole[start:a], s, whole[b:stop], m, whole[a:b])))
        form.append("plain" if is_plain else "spm" if is_spm else "psm")
    return [pa.array(units.counts, pa.int64()), pa.array(form, pa.string()), pa.array(out, pa.binary()).cast(pa.string()),
            pa.array(units.length(units.starts, first), pa.int64(), mask=plain),
            pa.array(units.length(first, second), pa.int64(), mask=plain)]


COLUMNS = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("output", T.StringType()),
                        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])


def infill(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The table with, for each text, its number of units, the form, the example, and the code
    points of prefix and middle (null where plain)."""
    prepare(docs.sparkSession)
    require_columns(docs, "doc_id", "text")
    own = {f.name for f in COLUMNS}
    kept = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    text, doc_id = kept.index("text"), kept.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text).cast(pa.binary()), b"")
            ids = batch.column(doc_id).to_pylist()
            for at, to in _pieces(texts):
                new = _examples(texts.slice(at, to - at), ids[at:to], seed, transformed, suffix_first)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, *new], names=[*batch.schema.names, *own_names])
        release_memory()

    own_names = [f.name for f in COLUMNS]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *COLUMNS.fields]))


def restore(output: Column, form: Column) -> Column:
    """The text that an example was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
