"""Mixing sources to target weights by weighted fair queueing.

Every source gets a weight; targets are shares of the token budget, capped at
``max_repeats`` times what the source holds, with the excess shared out again by weight.
Each document of a source, in a keyed random order, has a virtual finish time for every
pass over the source: the source's tokens up to its end, divided by the source's target.
All (document, pass) pairs are sorted by finish time over all sources, and the sequence is
cut where the running total reaches the budget. Because finish times are in units of each
source's own target, every source is near its target wherever the sequence is cut.

The targets add up to the budget, so all that finishes by 1 is taken: how much of a row's
copies that is follows by division. The cut lies behind 1, and before the time by which
targets, capped at what the sources hold, exceed the budget by one document of each source.
Only what finishes in between is sorted over all sources.

Only DataFrame functions. Running totals never put a source (or the whole table) into one
task: rows are dealt into blocks of their order axis, block totals are summed on a small
table, and a window runs inside each block only.

Defined cases: null text or a text without words has size 0, takes 0 and is kept in the
result; a null source is a source of its own, last in code point order; rows that agree in
(doc_id, source, size), null ids included, are copies that follow each other in the queue; the cut
may fall between them, so that some are taken once more than the others, without a row for each
copy before the cut; an empty table gives an empty result; other columns are ignored by ``mix``
and carried along by ``mix_documents``, whose columns must be of types that can be grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, free_name, materialize, prepare, require_columns

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: Rows that one block of a running total should hold, and the most blocks of a source.
BLOCK_ROWS = 5_000
MAX_BLOCKS = 1 << 16
#: Sources whose cuts are broadcast.
BROADCAST_ROWS = 300_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(source, src, source_size, target, budget), one row per source, from (source, source_size).

    Sources are ranked by code point, null last, and weigh ``weights`` in turn. The targets
    solve ``target = least(max_repeats * size, level * weight)`` with the level that spends
    the whole budget, the fixed point of capping and sharing the excess out again: with
    sources in the order of ``max_repeats * size / weight``, the level is the largest of
    (budget - caps before) / (weights from here on). The windows run over one row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    ranked = (ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats)
              .withColumn("budget", F.sum("source_size").over(everything)))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("src").asc())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (ranked.withColumn("level_here", (F.col("budget") - before).cast("double") / rest)
            .withColumn("level", F.max("level_here").over(everything))
            .select("source", "src", "source_size", "budget",
                    F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target")))


def _running(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each row, in the order of (keys, block, order)."""
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_sum"))
    over = (Window.partitionBy(*keys) if keys else Window).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, block, F.coalesce(F.sum("_sum").over(over), F.lit(0)).cast("long").alias("_before"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_inside", F.sum(value).over(inside)).join(offsets, [*keys, block])
            .withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside"))


def _shuffled(seed: str, doc_id: Column, size: Column) -> Column:
    """The keyed random order of a source's documents."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string")))


def _place(seed: str, doc_id: Column, size: Column) -> Column:
    """A row's place in the queue of its source; null ids come first."""
    return F.struct(_shuffled(seed, doc_id, size).alias("h"), doc_id.alias("doc_id"), size.alias("size"))


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): one row per distinct document row."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))


def _last_finish(targets: DataFrame, largest: DataFrame, max_repeats: int) -> float:
    """A time behind the cut: with every source at its target times this, or at all that it holds,
    the budget is exceeded by the largest document of each source. The windows run over one row
    per source."""
    per = targets.join(largest, "src").withColumn("cap", F.col("source_size") * max_repeats)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("cap") / F.col("target")).asc(), F.col("src").asc())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("target").over(order.rowsBetween(0, Window.unboundedFollowing))
    here = (F.col("budget") + F.sum("largest").over(everything) - before) / rest
    return max(1.0, per.select(here.alias("here")).agg(F.max("here")).first()[0] or 1.0)


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, size, copies, source_size, target, passes): how many passes the mix takes
    of ``copies`` of the rows that agree in (doc_id, source, size): one row for all of them, or
    two where the cut falls between them."""
    spark = prepare(docs.sparkSession)
    require_columns(docs, "doc_id", "source", "text")
    units = materialize(_units(docs), "mix-units")
    n = units.count()
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, max_repeats).coalesce(1), "mix-targets")
    blocks = min(MAX_BLOCKS, max(1, n // block_rows))
    # the keyed order of a source's documents; its first 16 bits deal the rows into blocks
    block = F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * blocks / (1 << 16))
    queued = (units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
              .select("u.*", "t.src", "t.source_size", "t.target", "t.budget")
              .withColumn("h", _shuffled(seed, F.col("doc_id"), F.col("size"))).withColumn("block", block).withColumn("tokens", F.col("size") * F.col("copies")))
    sized = queued.where(F.col("size") > 0)
    sized = _running(sized, ["src"], "block", [F.col("h"), F.col("doc_id"), F.col("size")], "tokens", "upto")

    def copies_by(end: Column, one_pass: Column) -> Column:
        """How many copies end at or before ``end`` (a whole number of the source's tokens) in a pass."""
        begun = F.col("upto") - F.col("tokens") + one_pass * F.col("source_size")
        return F.least(F.greatest(F.floor((end - begun) / F.col("size")), F.lit(0)), F.col("copies"))

    one = F.floor("target")
    sure = sum((copies_by(one, F.lit(p)) for p in range(max_repeats)), F.lit(0))
    sized = materialize(sized.withColumn("sure", sure.cast("long")), "mix-queued")
    spent = sized.agg(F.coalesce(F.sum(F.col("sure") * F.col("size")), F.lit(0))).first()[0]
    last = _last_finish(targets, sized.groupBy("src").agg(F.max("size").alias("largest")), max_repeats)
    passes = sized.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    passes = passes.withColumn("low", copies_by(one, F.col("pass"))).withColumn(
        "high", copies_by(F.floor(F.col("target") * last) + 1, F.col("pass")))
    near = passes.where("high > low").withColumn("copy", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    near = near.withColumn("finish", (F.col("upto") - F.col("tokens") + F.col("copy") * F.col("size") + F.col("pass") * F.col("source_size"))
                           .cast("double") / F.col("target"))
    near = near.withColumn("slot", F.floor((F.col("finish") - 1) / max(last - 1, 1e-9) * blocks)).select(
        "src", "doc_id", "source", "size", "budget", "h", "pass", "copy", "finish", "slot")
    order = [F.col("finish"), F.col("src"), F.col("h"), F.col("doc_id"), F.col("size"), F.col("pass"), F.col("copy")]
    cut = _running(near, [], "slot", order, "size", "total").where(F.col("total") + spent <= F.col("budget"))
    more = cut.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("more")).alias("m")
    same = F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("s.source").eqNullSafe(F.col("m.source")) & (F.col("s.size") == F.col("m.size"))
    taken = sized.alias("s").join(more, same, "left").select("s.*", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("taken"))
    # passes follow one another: a few copies are one pass ahead of the others
    full, ahead = F.floor(F.col("taken") / F.col("copies")), F.col("taken") % F.col("copies")
    parts = F.array(F.struct(ahead.alias("copies"), (full + 1).alias("passes")), F.struct((F.col("copies") - ahead).alias("copies"), full.alias("passes")))
    keep = ["doc_id", "source", "size", "copies", "source_size", "target", "passes"]
    split = taken.withColumn("part", F.explode(F.filter(parts, lambda p: p["copies"] > 0)))
    split = split.select("doc_id", "source", "size", "part.copies", "source_size", "target", "part.passes")
    return split.unionByName(queued.where(F.col("size") == 0).withColumn("passes", F.lit(0).cast("long")).select(*keep))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` repeated as often as the mix takes it.
    Columns as in ``docs``. A source's queue is taken round after round and cut at one place: rows up to
    it are taken once more than those behind. So a row for each source travels to the rows, and
    no text is moved."""
    size, copy, number = (free_name(docs, x) for x in ("mix_size", "mix_copy", "mix_n"))
    seed = options.get("seed", SEED)
    rows = docs.withColumn(size, word_count(F.col("text"))).where(F.col(size) > 0).alias("d")
    mixed = materialize(mix(docs, **options), "mix-taken").where("size > 0")
    place = _place(seed, F.col("doc_id"), F.col("size"))
    # the last one taken once more, with its copies, and the first of the others
    part = F.struct("passes", place.alias("last"), "copies")
    ends = mixed.groupBy("source").agg(F.max(part).alias("top"), F.min(part).alias("rest"))
    ends = materialize(ends.select("source", "top.last", F.col("top.passes").alias("most"), F.col("top.copies").alias("ahead"), F.col("rest.passes").alias("passes"),
                                   ((F.col("top.last") == F.col("rest.last")) & (F.col("top.passes") > F.col("rest.passes"))).alias("split")), "mix-ends")
    few = ends.count() <= BROADCAST_ROWS
    met = rows.join((F.broadcast(ends) if few else ends).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    here = _place(seed, F.col("d.doc_id"), F.col(f"d.{size}"))
    at_cut = F.col("t.split") & (here == F.col("t.last"))
    passes = F.when(here <= F.col("t.last"), F.col("t.most")).otherwise(F.col("t.passes"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    # one output row for each pass
    whole = met.where(~at_cut & (passes > 0)).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), passes)).alias(copy)).drop(copy)
    # at the cut, one group of copies of a source at most: equal rows are counted, and the counts numbered
    if ends.where("split").isEmpty():
        return whole
    names = [f"`{c}`" for c in docs.columns]
    marks = {x: free_name(docs, x) for x in ("mix_group", "mix_less", "mix_ahead", "mix_block", "mix_upto")}
    group, less, ahead, block, upto = marks.values()
    some = met.where(at_cut).select(
        *columns, F.xxhash64("d.doc_id", "d.source", f"d.{size}").alias(group), F.col("t.passes").alias(less), F.col("t.ahead").alias(ahead))
    counted = materialize(some.groupBy(*names, group, less, ahead).agg(F.count(F.lit(1)).alias(number)), "mix-split")
    counted = counted.withColumn(block, F.pmod(F.xxhash64(*names), F.lit(1_024)))
    counted = _running(counted, [group], block, [F.col(c) for c in names], number, upto)
    ahead_here = F.greatest(F.least(F.col(ahead) - (F.col(upto) - F.col(number)), F.col(number)), F.lit(0))
    times = F.col(number) * F.col(less) + ahead_here
    repeated = counted.withColumn(copy, times).where(F.col(copy) > 0)
    return whole.unionByName(repeated.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))).alias(copy)).drop(copy))
