"""Distributed running totals, ranks, trailing windows and exact percentiles.

A plain ``sum() OVER (PARTITION BY key ORDER BY v)`` puts every row of one key into one
task. Here it is a two-level prefix sum: rows are dealt into blocks of their key's order axis, a
window runs inside each (key, block), and what a block needs from the blocks before it comes
from a small table of one row per block, over which ordinary windows run.

1. Rows are counted by key (combined before the shuffle). A key of few rows is one block.
   A key that holds more than its share is cut at approximate quantiles into as many blocks as
   it holds shares; a share is the input divided by the session's shuffle partitions, at least
   LEAST_ROWS rows. So there are at most as many large keys as partitions, and twice as many
   edges, whatever the number of rows and keys: that is the bound of the broadcast.
2. The block of a row is found by binary search in its key's edges. Equal order values share
   a block, and blocks follow the order, so results are exact; edges only decide how evenly the
   work splits. Where no key is large there are no edges and no second pass at all.
3. Block totals, summed up over the blocks of a key, are offsets of the running totals inside
   the blocks. Trailing windows carry the last k - 1 rows before a block, runs of true the start
   of the run that is open there.

The rows move once, by (key, block); windows that follow on the same blocks and order add no
further exchange (``Blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows that a block has at least, where the number of blocks isn't given.
LEAST_ROWS = 50_000
#: Ranks of quantiles are right within 1 / accuracy of a key's rows; finer for more blocks.
EDGE_ACCURACY = 10_000
_UPTO_HERE = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Joins on keys that may be null; the result has the columns of ``left``, then the rest."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _bisect(edges: Column, axis: Column, longest: int) -> Column:
    """How many of the sorted ``edges`` are at most ``axis``, in log2(longest) steps."""
    zero = F.lit(0)
    start = F.struct(zero.alias("lo"), F.coalesce(F.size(edges), zero).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(edges, mid) <= axis
        inside = s["lo"] < s["hi"]
        return F.struct(F.when(inside & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(inside & ~right, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.array(*[F.lit(i) for i in range(max(1, longest.bit_length()))])
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def with_blocks(df: DataFrame, keys: Sequence[str], block_expr: Column, blocks: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with ``_blk``, the block of each row on its key's order axis, and whether any key has
    more than one; null order values, which sort first, are in block 0. ``df`` is read up to three
    times: callers pass a table, or cut its lineage."""
    n = int(blocks or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    axis = block_expr.cast("double")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    size = counts.agg(F.sum("_c").alias("rows"), F.max("_c").alias("most")).first()
    share = max(1 if blocks else LEAST_ROWS, -(-(size["rows"] or 0) // n))
    if n < 2 or (size["most"] or 0) < 2 * share:
        return df.withColumn("_blk", F.lit(0)), False
    quantiles = F.percentile_approx(axis, [i / n for i in range(1, n)], max(EDGE_ACCURACY, 4 * n))
    if keys:
        # at most n keys hold two shares
        large = counts.where(F.col("_c") >= 2 * share)
        found = _null_safe_join(df, F.broadcast(large), keys, "inner").groupBy(*keys).agg(quantiles.alias("_q"), F.first("_c").alias("_c"))
    else:
        found = df.agg(quantiles.alias("_q"), F.count(F.lit(1)).alias("_c"))
    # every so manieth quantile: an edge for each share
    own = F.floor(F.col("_c") / share).cast("int")
    thin = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.get("_q", F.floor(i * n / own).cast("int") - 1))
    edges = F.array_sort(F.array_distinct(F.filter(F.coalesce(thin, F.array().cast("array<double>")), lambda e: e.isNotNull())))
    found = cut_lineage(found.select(*keys, edges.alias("_edges")))
    longest = found.agg(F.max(F.size("_edges"))).first()[0] or 0
    if not longest:
        return df.withColumn("_blk", F.lit(0)), False
    if keys:
        out = _null_safe_join(df, F.broadcast(found), keys)
        block = _bisect(F.col("_edges"), axis, longest)
    else:
        out, block = df, _bisect(F.lit(found.first()["_edges"]).cast("array<double>"), axis, longest)
    return out.withColumn("_blk", F.when(axis.isNull(), F.lit(0)).otherwise(block)).drop("_edges"), True


def _kind(df: DataFrame, c: str) -> str:
    t = df.schema[c].dataType.simpleString()
    return "double" if t in ("float", "double") else "bigint" if not t.startswith("decimal") else "decimal(38,6)"


@dataclass(frozen=True)
class Blocks:
    """Rows dealt into blocks: ``frame`` has ``_blk``; ``split`` where a key has several."""

    frame: DataFrame
    keys: list[str]
    order: list[Column]
    split: bool

    @property
    def _inside(self):
        return Window.partitionBy(*self.keys, "_blk").orderBy(*self.order)

    def _along(self, *columns: str):
        """A window over the blocks of a key: over the table of one row per block."""
        own = [*self.keys, *columns]
        return (Window.partitionBy(*own) if own else Window).orderBy("_blk")

    def _per_block(self, frame: DataFrame, **aggs: Column) -> DataFrame:
        return frame.groupBy(*self.keys, "_blk").agg(*[c.alias(name) for name, c in aggs.items()])

    def _attach(self, frame: DataFrame, per_block: DataFrame) -> DataFrame:
        return _null_safe_join(frame, per_block, [*self.keys, "_blk"])

    def running(self, sum_cols: Sequence[str], prefix: str = "cum_") -> Blocks:
        """Adds ``<prefix><c>``: the sum of ``c`` up to and with this row of its key."""
        upto = self._inside.rowsBetween(*_UPTO_HERE)
        if not self.split:
            return replace(self, frame=self.frame.select("*", *[F.sum(c).over(upto).alias(prefix + c) for c in sum_cols]))
        totals = self._per_block(self.frame, **{f"_t_{c}": F.sum(c) for c in sum_cols})
        offsets = totals.select(*self.keys, "_blk", *[
            F.coalesce(F.sum(f"_t_{c}").over(self._along().rowsBetween(*_BEFORE)), F.lit(0)).cast(_kind(self.frame, c)).alias(f"_o_{c}") for c in sum_cols])
        summed = self.frame.select("*", *[F.sum(c).over(upto).alias(f"_i_{c}") for c in sum_cols])
        out = self._attach(summed, offsets).select(
            *self.frame.columns, *[(F.col(f"_i_{c}") + F.coalesce(F.col(f"_o_{c}"), F.lit(0))).alias(prefix + c) for c in sum_cols])
        return replace(self, frame=out)

    def trailing(self, sum_cols: Sequence[str], k: int) -> Blocks:
        """Adds ``rn`` (1-based position in the key), ``fill`` = min(rn, k) and ``win_<c>``, the sum
        of ``c`` over the last ``k`` rows, this one included."""
        w, columns = self._inside, self.frame.columns
        inside = self.frame.select("*", F.row_number().over(w).alias("_i"),
                                   *[F.sum(c).over(w.rowsBetween(1 - k, 0)).alias(f"_w_{c}") for c in sum_cols])
        if not self.split:
            rn = F.col("_i").cast("long")
            return replace(self, frame=inside.select(*columns, rn.alias("rn"), F.least(rn, F.lit(k)).alias("fill"),
                                                     *[F.col(f"_w_{c}").alias(f"win_{c}") for c in sum_cols]))
        along = self._along()
        sizes = self._per_block(self.frame, _n=F.count(F.lit(1)))
        starts = sizes.select(*self.keys, "_blk", "_n", F.coalesce(F.sum("_n").over(along.rowsBetween(*_BEFORE)), F.lit(0)).alias("_first"))
        out = self._attach(inside, starts.select(*self.keys, "_blk", "_first"))
        if k > 1 and sum_cols:
            out = self._attach(out, self._carried(starts, sum_cols, k))
        sums = []
        for c in sum_cols:
            total = F.col(f"_w_{c}")
            if k > 1:
                # row i of a block needs the last k - i rows before the block
                kind = _kind(self.frame, c)
                before = F.filter("_carry", lambda x: x["_back"] <= F.lit(k) - F.col("_i"))
                more = F.aggregate(before, F.lit(0).cast(kind), lambda s, x: s + F.coalesce(x[f"_x_{c}"], F.lit(0)).cast(kind))
                total = F.when((F.col("_i") < k) & F.col("_carry").isNotNull(), F.coalesce(total, F.lit(0)) + more).otherwise(total)
            sums.append(total.alias(f"win_{c}"))
        rn = (F.col("_first") + F.col("_i")).cast("long")
        return replace(self, frame=out.select(*columns, rn.alias("rn"), F.least(rn, F.lit(k)).alias("fill"), *sums))

    def _carried(self, starts: DataFrame, sum_cols: Sequence[str], k: int) -> DataFrame:
        """(keys..., _blk, _carry): of the k - 1 rows before each block, how far back they are and
        their values. A block holds a row at least, so the k - 1 blocks that follow one are enough
        to find those that its last rows are carried to."""
        later = self._along().rowsBetween(1, k - 1)
        following = starts.select(*self.keys, "_blk", "_n", "_first", F.collect_list(F.struct(F.col("_blk").alias("b"), F.col("_first").alias("f"))).over(later).alias("_next"))
        back = F.row_number().over(Window.partitionBy(*self.keys, "_blk").orderBy(*[_reverse(c) for c in self.order]))
        tails = self.frame.select(*self.keys, "_blk", *[F.col(c).alias(f"_x_{c}") for c in sum_cols], back.alias("_b")).where(F.col("_b") <= k - 1)
        tails = self._attach(tails, following).withColumn("_at", F.col("_first") + F.col("_n") - F.col("_b"))  # position in the key, from 0
        sent = tails.select(*self.keys, *[f"_x_{c}" for c in sum_cols], "_at", F.explode("_next").alias("_to")).where(F.col("_to.f") - F.col("_at") <= k - 1)
        row = F.struct((F.col("_to.f") - F.col("_at")).alias("_back"), *[f"_x_{c}" for c in sum_cols])
        return sent.groupBy(*self.keys, F.col("_to.b").alias("_blk")).agg(F.collect_list(row).alias("_carry"))

    def runs(self, cond_col: str, time_col: str) -> Blocks:
        """Adds ``run_start``: where ``cond_col`` is true, ``time_col`` of the first row of its
        uninterrupted run of true rows, else null."""
        w = self._inside
        upto = w.rowsBetween(*_UPTO_HERE)
        base = self.frame.withColumn("_c", F.coalesce(F.col(cond_col), F.lit(False)))
        marked = base.select("*", F.row_number().over(w).alias("_i"), F.coalesce(F.lag("_c").over(w), F.lit(False)).alias("_p"))
        marked = marked.select("*", F.last(F.when(F.col("_c") & ~F.col("_p"), F.col(time_col)), ignorenulls=True).over(upto).alias("_own"),
                               F.min(F.col("_c").cast("int")).over(upto).alias("_open"))
        start = F.col("_own")
        if self.split:
            # of each block: whether all rows are true, and the start of the run that its last row is in
            per = self._per_block(marked, _all=F.min("_open"), _end=F.max_by(F.when(F.col("_c"), F.col("_own")), "_i"))
            # blocks of true rows alone continue what the block before them ends with
            along = self._along()
            per = per.withColumn("_g", F.sum(F.lit(1) - F.col("_all")).over(along.rowsBetween(*_UPTO_HERE)))
            state = F.first("_end", ignorenulls=True).over(self._along("_g").rowsBetween(*_UPTO_HERE))
            per = per.withColumn("_state", state).select(*self.keys, "_blk", F.lag("_state").over(along).alias("_carry"))
            marked = self._attach(marked, per)
            start = F.when(F.col("_open") == 1, F.coalesce(F.col("_carry"), F.col("_own"))).otherwise(F.col("_own"))
        return replace(self, frame=marked.select(*self.frame.columns, F.when(F.col("_c"), start).alias("run_start")))


def blocked(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column], block_expr: Column | None = None,
            blocks: int | None = None) -> Blocks:
    """``df`` dealt into blocks. ``order_cols`` must be a total order within a key (add a tie-break
    column); ``block_expr`` is a numeric expression that doesn't decrease in that order (default: the
    first order column)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    frame, split = with_blocks(df, list(keys), order[0] if block_expr is None else block_expr, blocks)
    return Blocks(frame, list(keys), order, split)


def running_totals(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column], sum_cols: Sequence[str],
                   block_expr: Column | None = None, blocks: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows of the same keys up to and including
    this row in ``order_cols`` order (ROWS frame)."""
    return blocked(df, keys, order_cols, block_expr, blocks).running(sum_cols, prefix).frame.drop("_blk")


def exact_percentiles(counts: DataFrame, keys: Sequence[str], value_col: str, probs: Sequence[float],
                      blocks: int | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles per key from ``counts`` (keys..., value, c), without
    holding a key's values in one task: ranks of the distinct values are running totals. The
    blocks that hold one of the wanted ranks floor/ceil(p*(n-1)) are known from the block totals,
    and only their rows are sorted.

    Returns (keys..., p_idx, p, q) - one row per key and requested probability.
    """
    dealt = blocked(counts, keys, [value_col], blocks=blocks)
    keys, along = dealt.keys, dealt._along()
    per = dealt._per_block(dealt.frame, _t=F.sum("c")).select(
        *keys, "_blk", "_t", F.coalesce(F.sum("_t").over(along.rowsBetween(*_BEFORE)), F.lit(0)).alias("_first"),
        F.sum("_t").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("p_idx"), F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_h"))
                       for i, p in enumerate(probs)])

    def among(first: Column, behind: Column):
        """Whether the rank below or above a wanted position is one of first .. behind - 1."""
        held = lambda r: (r >= first) & (r < behind)
        return lambda x: held(F.floor(x["_h"])) | held(F.ceil(x["_h"]))

    # only blocks that hold a wanted rank go on
    per = per.select(*keys, "_blk", "_first", F.filter(wanted, among(F.col("_first"), F.col("_first") + F.col("_t"))).alias("_wanted")).where(F.size("_wanted") > 0)
    rows = _null_safe_join(dealt.frame, per, [*keys, "_blk"], "inner")
    upto = F.col("_first") + F.sum("c").over(dealt._inside.rowsBetween(*_UPTO_HERE))
    cum = rows.select(*keys, value_col, "_wanted", (upto - F.col("c")).alias("_lo"), upto.alias("_hi"))  # ranks _lo .. _hi - 1
    met = cum.select(*keys, value_col, "_lo", "_hi", F.explode(F.filter("_wanted", among(F.col("_lo"), F.col("_hi")))).alias("_x"))
    met = met.select(*keys, "_x.p_idx", "_x.p", "_x._h", value_col, "_lo", "_hi")
    value_at = lambda r: F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col(value_col)))
    vals = met.groupBy(*keys, "p_idx", "p", "_h").agg(value_at(F.floor("_h")).alias("_v0"), value_at(F.ceil("_h")).alias("_v1"))
    return vals.select(*keys, "p_idx", "p", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_h") - F.floor("_h"))).alias("q"))


def percentile_array(pct: DataFrame, keys: Sequence[str], name: str = "q") -> DataFrame:
    """Collect the percentiles of each key into an array ordered by probability."""
    return (pct.groupBy(*keys)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "q"))), lambda s: s["q"]).alias(name)))


def trailing_sums(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column], sum_cols: Sequence[str],
                  k: int, block_expr: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Sum of ``sum_cols`` over the last ``k`` rows (this one included) of each key in
    ``order_cols`` order, as ``win_<c>``, plus ``rn`` (1-based position) and ``fill`` = min(rn, k)."""
    return blocked(df, keys, order_cols, block_expr, blocks).trailing(sum_cols, k).frame.drop("_blk")


def _reverse(c: Column) -> Column:
    """The opposite sort order of an order column."""
    text = str(c)
    if "DESC" in text:
        raise ValueError("trailing windows need ascending order columns")
    return c.desc()


def runs_of_true(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column], cond_col: str,
                 time_col: str, block_expr: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Gaps and islands: for every row where ``cond_col`` is true, ``run_start`` = the
    ``time_col`` of the first row of its uninterrupted run of true rows (NULL when false)."""
    return blocked(df, keys, order_cols, block_expr, blocks).runs(cond_col, time_col).frame.drop("_blk")
