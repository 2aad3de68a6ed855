"""Language-model scores of whole texts by causal self-attention over subword ids.

A text is its words (runs other than ASCII white space, A-Z in lower case) and one end; words
become subword ids of a public byte-level vocabulary, each with a space before it, and the end
its end-of-text id. The model gives P(id | ids before) = P(class | ids before) * P(id | class, id
before): a causal self-attention network (``attention.py``) for the class, smoothed counts for
the id within it. A text's score is the log10 probability of its ids, end included.

1. One pass over the training texts counts words (partial counts in tasks, summed by Spark) and
   writes all their ids as spans of WINDOW ids, each with the id before it.
2. Counts of ids, and of pairs of ids within words, follow from the table of distinct words, so
   every training text counts fully. Frequent ids are classes of their own, the others are
   grouped by the ids they stand beside (spectral k-means on a table bounded by the vocabulary).
   The counts give the within-class distributions and the transitions between classes, which
   are part of the network's logits.
3. The network learns in ROUNDS: every task runs Adam over its spans from the same weights, and
   the weighted mean of the tasks' weights, formed by Spark, begins the next round.
4. One pass over all texts scores them, in blocks whose context overlaps.

The unigram base is exact over all words. Logs of the most frequent words, FREQUENT at most, travel with
the tasks; other words of a text are written out and joined with the word counts by word. Such
a word is a small share of the training words, so no join key is hot unless words that training
hardly has fill the other texts; then adaptive skew joins split it.

Broadcast: the tables of the model (at most vocabulary + FINE * FINE + FINE * classes numbers,
about 6 MB) and FREQUENT words. Collected: pair counts of ids, where one is among the NEAR most
frequent or both among the FINE most frequent.

Defined cases: null text counts as empty, an empty text is its end alone; a null doc_id hashes as
'null'; repeated rows count as often as they occur; without training texts all words are
unknown, N and V are 0 and the base is 0; words of any length are encoded whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import BLOCK, WINDOW, Adam, Scorer, flatten, initial, loss_and_gradients, unflatten
from .common import materialize, partitions, prepare, release_memory, require_columns, slices, text_bytes

#: Ids of the vocabulary; the last one ends a text. Both fit 16 bits.
VOCABULARY, END = 50_257, 50_256
#: Classes of one id, and classes that group the other ids; one more for ids never seen.
SINGLE, GROUPED = 126, 65
CLASSES = SINGLE + GROUPED + 1
WIDTH = 16
#: Ids whose pairs refine the distribution within a class, and ids that describe others by standing beside them.
FINE, NEAR = 1_024, 64
#: Sixteenths of the spans of each round, and its learning rate.
ROUNDS = ((1, 0.01), (2, 0.007), (4, 0.004), (9, 0.002))
MINIBATCH = 16
#: Spans that one task learns from in a round, so that small corpora are learned from in few long runs.
TASK_SPANS = 20_000
FREQUENT = 100_000
#: Distinct words, and pairs of ids, that a task holds; beyond it, partial counts are emitted and counting
#: starts anew.
HELD_WORDS = 300_000
HELD_PAIRS = 2_000_000
#: Bytes of a remembered word, ids scored at once, rows of a slice.
LONG_WORD, SCORED_IDS, SLICE = 64, 65_536, 200
#: Pseudo-counts: an id within its class, a class after a class, an id after an id.
ALPHA, BETA, GAMMA = 0.02, 5.0, 5.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 10 == 0


def words_of(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text; ``bytes`` methods know ASCII alone, as the rule asks."""
    return data.lower().split()


class WordIds(dict):
    """Word -> its ids as uint16 bytes; the empty word is the end."""

    def __init__(self, path: str):
        from .tokens import encoder

        super().__init__()
        self.chunks = encoder(path)
        self.ranked = self.chunks.ranked and self.chunks.ranked.encode_ordinary
        self[b""] = array("H", [END]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if not word:
            return self[b""]
        text = " " + word.decode("utf-8", "replace")
        out = array("H", self.ranked(text) if self.ranked else np.frombuffer(self.chunks.encode(text), "<u4").tolist()).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= HELD_WORDS:
                end = self[b""]
                self.clear()
                self[b""] = end
            self[word] = out
        return out


# 1. words and spans

GATHERED = "word binary, n long, turn int, ids binary"


def _gather(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, counts = WordIds(path), Counter()

        def words() -> pa.RecordBatch:
            n = len(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64()), pa.nulls(n, pa.int32()),
                 pa.nulls(n, pa.binary())], names=["word", "n", "turn", "ids"])
            counts.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            turns, spans = [], []
            for text in batch.column("text"):
                data = text.as_py()
                tokens = words_of(data)
                tokens.append(b"")
                counts.update(tokens)
                mark = zlib.crc32(data)
                ids = ids_of[b""][-2:] + b"".join(map(ids_of.__getitem__, tokens))
                # the id before, and all that a window holds: none but a text's last one is padded
                own = [ids[at : at + 2 * WINDOW + 2] for at in range(0, len(ids) - 2, 2 * WINDOW)]
                turns.extend([(mark + j) % 16 for j in range(len(own))])
                spans.extend(own)
            if spans:
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(turns, pa.int32()), pa.array(spans, pa.binary())],
                    names=["word", "n", "turn", "ids"])
            if len(counts) >= HELD_WORDS:
                yield words()
        if counts:
            yield words()
        release_memory()

    return run


# 2. counts of ids, classes, tables

def _pairs(path: str):
    """Counts of (id, id after it within a word); -1 stands for a word's border."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            ids = list(map(ids_of.__missing__, batch.column("word").to_pylist()))
            times = batch.column("n").to_numpy()
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            # each word's ids between two borders; ids count from 1, 0 is the border
            ends = np.cumsum(size + 1)
            line = np.zeros(ends[-1] + 1 if len(ids) else 1, np.int64)
            inner = np.ones(len(line), bool)
            inner[0], inner[ends] = False, False
            line[inner] = np.frombuffer(b"".join(ids), "<u2").astype(np.int64) + 1
            fresh = line[:-1] * (VOCABULARY + 1) + line[1:]
            keys, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.repeat(times, size + 1)]), len(keys)).astype(np.int64)
            if len(keys) >= HELD_PAIRS:
                yield _pair_batch(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield _pair_batch(keys, counts)

    return run


def _pair_batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    a, b = np.divmod(keys, VOCABULARY + 1)
    return pa.RecordBatch.from_arrays([pa.array(a - 1, pa.int32()), pa.array(b - 1, pa.int32()), pa.array(counts)], names=["a", "b", "n"])


def group_ids(near: np.ndarray, counts: np.ndarray, groups: int, width: int = 12, seed: int = 0) -> np.ndarray:
    """A group for each row of ``near`` (counts of what an id stands beside): k-means, weighted by
    ``counts``, on the leading principal components of the square roots of the shares."""
    if len(near) <= groups:
        return np.arange(len(near))
    x = np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1e-9))
    x -= counts @ x / counts.sum()
    values, axes = np.linalg.eigh((x * counts[:, None]).T @ x / counts.sum())
    z = x @ axes[:, -width:]
    centers = z[np.random.default_rng(seed).choice(len(z), groups, replace=False, p=counts / counts.sum())]
    for _ in range(15):
        nearest = ((centers**2).sum(1) - 2 * z @ centers.T).argmin(1)
        total = np.bincount(nearest, weights=counts, minlength=groups)
        for k in np.flatnonzero(total):
            own = nearest == k
            centers[k] = counts[own] @ z[own] / total[k]
    return nearest


@dataclass
class Tables:
    """What the counts give; ids stand by rank (most frequent first)."""

    rank: np.ndarray  # of each id
    group: np.ndarray  # class of each rank
    within: np.ndarray  # ln P(id | its class)
    fine: np.ndarray  # ln P(id | its class, id before), both among the FINE first
    lack: np.ndarray  # ln of what the FINE first leave to others of a class, by id before
    turns: np.ndarray  # P(class | class before)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def refine(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """ln P(id | its class, id before) of ranks."""
        out = self.within[after].astype(np.float64)
        known = np.flatnonzero(before < FINE)
        b, a = before[known], after[known]
        inside = a < FINE
        out[known[inside]] = self.fine[b[inside], a[inside]]
        rest = ~inside
        out[known[rest]] += self.lack[b[rest], self.group[a[rest]]]
        return out


def tables(pairs: DataFrame) -> Tables:
    """Classes and count tables from (a, b, n)."""
    borders = pairs.where("a = -1 or b = -1").toPandas()
    inner = pairs.where("a >= 0 and b >= 0")
    seen = inner.groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    starts, lasts, counts = (np.zeros(VOCABULARY) for _ in range(3))
    for name, into, side in (("b", starts, borders[borders.a == -1]), ("a", lasts, borders[borders.b == -1])):
        into[side[name].to_numpy()] = side["n"].to_numpy()
    counts[seen["b"].to_numpy()] = seen["n"].to_numpy()
    counts += starts
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(VOCABULARY, np.int64)
    rank[order] = np.arange(VOCABULARY)
    # by rank from here on
    counts, starts, lasts = counts[order], starts[order], lasts[order]
    spark = pairs.sparkSession
    first = spark.createDataFrame([(int(i), r) for r, i in enumerate(order[:FINE])], "id int, r int")
    left, right = F.broadcast(first.toDF("a", "ra")), F.broadcast(first.toDF("b", "rb"))
    known = inner.join(left, "a", "left").join(right, "b", "left")
    kept = known.where(f"ra < {NEAR} or rb < {NEAR} or (ra is not null and rb is not null)").select("a", "b", "n").toPandas()
    a, b, n = rank[kept["a"].to_numpy()], rank[kept["b"].to_numpy()], kept["n"].to_numpy().astype(np.float64)

    # classes: the most frequent alone, those seen by what they stand beside, those never seen
    used = int((counts > 0).sum())
    group = np.full(VOCABULARY, CLASSES - 1)
    group[:SINGLE] = np.arange(SINGLE)
    if used > SINGLE:
        near = np.zeros((used - SINGLE, 2 * NEAR + 2))
        for x, y, at in ((a, b, 0), (b, a, NEAR)):
            own = (x >= SINGLE) & (y < NEAR)
            np.add.at(near, (x[own] - SINGLE, at + y[own]), n[own])
        near[:, -2], near[:, -1] = starts[SINGLE:used], lasts[SINGLE:used]
        group[SINGLE:used] = SINGLE + group_ids(near, counts[SINGLE:used], GROUPED)

    total = np.bincount(group, weights=counts + ALPHA, minlength=CLASSES)
    within = np.log((counts + ALPHA) / total[group])
    begin = starts / max(starts.sum(), 1.0)
    # pairs across a border: any word may follow any other
    pair = np.zeros((FINE, FINE))
    both = (a < FINE) & (b < FINE)
    pair[a[both], b[both]] = n[both]
    pair += lasts[:FINE, None] * begin[None, :FINE]
    by_class = np.zeros((FINE, CLASSES))
    for c in np.unique(group[:FINE]):
        by_class[:, c] = pair[:, group[:FINE] == c].sum(1)
    fine = np.log((pair + GAMMA * np.exp(within[None, :FINE])) / (by_class[:, group[:FINE]] + GAMMA))
    lack = np.log(GAMMA / (by_class + GAMMA))

    classes = spark.createDataFrame([(int(i), int(c)) for i, c in zip(order[:used], group[:used])], "id int, c int")
    turns = (inner.join(F.broadcast(classes.toDF("a", "ca")), "a").join(F.broadcast(classes.toDF("b", "cb")), "b")
             .groupBy("ca", "cb").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((CLASSES, CLASSES))
    table[turns["ca"].to_numpy(dtype=np.int64), turns["cb"].to_numpy(dtype=np.int64)] = turns["n"].to_numpy(dtype=np.float64)
    table += np.outer(np.bincount(group, weights=lasts, minlength=CLASSES), np.bincount(group, weights=begin, minlength=CLASSES))
    share = total / total.sum()
    table = (table + BETA * share) / (table.sum(1, keepdims=True) + BETA)
    return Tables(rank, group, within.astype(np.float32), fine.astype(np.float32), lack.astype(np.float32),
                  np.maximum(table, 1e-30).astype(np.float32))


# 3. the network

def settle() -> None:
    """Prepares a worker for many small steps: the allocator keeps freed arrays, since fresh pages
    cost as much as the arithmetic (``release_memory`` hands them back), and matrix products run
    on one thread, since a task has one core and waiting threads would spin on others'."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 26)  # arrays below 64 MB from the heap
        libc.mallopt(-1, 1 << 28)
        with open("/proc/self/maps") as f:
            blas = {line.split()[-1] for line in f if "openblas" in line}
        for path in blas:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
    except (OSError, AttributeError):
        pass  # another C library or platform; nothing depends on it


def _train(model: Tables, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        classes = model.group[model.rank]
        flat = model.weights.astype(np.float32)
        weights = unflatten(flat, CLASSES, WIDTH)  # views of it
        adam, rng, seen = Adam(flat, rate), np.random.default_rng(0), 0
        for batch in batches:
            spans = [classes[np.frombuffer(s, "<u2")] for s in batch.column("ids").to_pylist()]
            order = rng.permutation(len(spans))
            for i in range(0, len(order), MINIBATCH):
                part = [spans[j] for j in order[i : i + MINIBATCH]]
                x, y = np.zeros((len(part), WINDOW), np.int64), np.zeros((len(part), WINDOW), np.int64)
                real = np.zeros((len(part), WINDOW), bool)
                for row, s in enumerate(part):
                    n = len(s) - 1
                    x[row, :n], y[row, :n], real[row, :n] = s[:-1], s[1:], True
                adam.update(loss_and_gradients(weights, model.turns, x, y, real)[1])
            seen += len(spans)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen, np.int64))],
                names=["i", "v", "n"])
        release_memory()

    return run


def train(spans: DataFrame, model: Tables) -> Tables:
    """The network's weights, from spans (turn, ids)."""
    model.weights = flatten(initial(CLASSES, WIDTH))
    done, total = 0, spans.count()
    for sixteenths, rate in ROUNDS:
        part = spans.where(F.col("turn").between(done, done + sixteenths - 1)).select("ids")
        part = part.coalesce(partitions(total * sixteenths // 16, TASK_SPANS))
        done += sixteenths
        mean = part.mapInArrow(_train(model, rate), "i int, v double, n long").groupBy("i").agg(
            (F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if len(mean):
            model.weights = np.empty(len(mean), np.float32)
            model.weights[mean["i"].to_numpy()] = mean["v"].to_numpy()
    return model


# 4. scores

class TextScorer:
    """Log10 probabilities of whole id sequences."""

    def __init__(self, model: Tables):
        self.model = model
        self.net = Scorer(unflatten(model.weights, CLASSES, WIDTH), model.turns)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of each text's ids (uint16 bytes, end included), the log10 probability."""
        out = np.zeros(len(texts))
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) // 2
            if size >= SCORED_IDS or i + 1 == len(texts):
                out[start : i + 1] = self._together(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _together(self, texts: list[bytes]) -> np.ndarray:
        """Long texts are scored in pieces, each with the block before it as context."""
        pieces, owner, skip = [], [], []
        end = self.model.rank[END]
        for k, t in enumerate(texts):
            ranks = np.concatenate([[end], self.model.rank[np.frombuffer(t, "<u2")]])
            for s in range(0, max(len(ranks) - 1, 1), SCORED_IDS):
                lead = BLOCK if s else 0
                pieces.append(ranks[s - lead : s + SCORED_IDS + 1])
                owner.append(k)
                skip.append(lead)
        out = np.zeros(len(texts))
        done = 0
        while done < len(pieces):
            upto, size = done, 0
            while upto < len(pieces) and (size == 0 or size + len(pieces[upto]) <= 2 * SCORED_IDS):
                size += len(pieces[upto])
                upto += 1
            part = pieces[done:upto]
            before, after = np.concatenate([p[:-1] for p in part]), np.concatenate([p[1:] for p in part])
            lengths = np.array([len(p) - 1 for p in part])
            logs = self.net.positions(self.model.group[before], self.model.group[after], lengths)
            logs += self.model.refine(before, after) / np.log(10)
            at = np.concatenate([[0], np.cumsum(lengths)])
            for j in range(len(part)):
                out[owner[done + j]] += logs[at[j] + skip[done + j] : at[j + 1]].sum()
            done = upto
        return out


SCORED = "uid long, doc_id long, n_tokens long, known long, base double, score double, rare array<struct<word:binary,n:long>>"


def _score(path: str, model: Tables, frequent: dict[bytes, float]):
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        ids_of, scorer = WordIds(path), TextScorer(model)
        uid = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            rows, texts, held = [], [], 0

            def flush() -> pa.RecordBatch:
                scores = scorer.scores(texts)
                ids, docs, n, known, base, rare = zip(*rows)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, kind)],
                    names=["uid", "doc_id", "n_tokens", "known", "base", "score", "rare"])
                rows.clear()
                texts.clear()
                return out

            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                tokens = words_of(text.as_py())
                tokens.append(b"")
                logs = list(map(frequent.get, tokens))
                found = [x for x in logs if x is not None]
                rare = Counter(w for w, x in zip(tokens, logs) if x is None) if len(found) < len(logs) else {}
                rows.append((uid, doc, len(tokens), len(found), sum(found), [{"word": w, "n": c} for w, c in rare.items()]))
                texts.append(b"".join(map(ids_of.__getitem__, tokens)))
                uid, held = uid + 1, held + len(texts[-1])
                if held >= 4 * SCORED_IDS:
                    yield flush()
                    held = 0
            if rows:
                yield flush()
        release_memory()

    return run


def _frequent(counts: DataFrame) -> dict[bytes, float]:
    """log10(n + 0.1) of the words from a count on that at most FREQUENT words reach."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    least, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["words"]
        if total > FREQUENT:
            break
        least = r["least"]
    top = counts.where(F.col("n") >= (least or 0)).toPandas() if least else counts.limit(0).toPandas()
    return dict(zip(map(bytes, top["word"]), np.log10(top["n"].to_numpy(dtype=np.float64) + 0.1).tolist()))


def score_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = prepare(docs.sparkSession)
    require_columns(docs, "doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    training = texts.where(~held_out(F.col("doc_id"))).select("text")
    gathered = materialize(training.mapInArrow(_gather(path), GATHERED), "lm-gathered")
    counts = materialize(gathered.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("n").alias("v")).first()
    pairs = materialize(counts.mapInArrow(_pairs(path), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "lm-pairs")
    model = train(gathered.where("ids is not null"), tables(pairs))
    frequent = _frequent(counts)

    scored = materialize(texts.mapInArrow(_score(path, model, frequent), SCORED), "lm-scored")
    rare = scored.select("uid", F.explode("rare").alias("w")).select("uid", "w.word", F.col("w.n").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1))).alias("rare_base"))
    each = float(np.log10(totals["n"] + 0.1 * (totals["v"] + 1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare").join(rare, "uid", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(int(totals["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")
