"""Ordered series: rolling, lagged, running and exponentially weighted columns.

`Series` collects derived columns and lays them out as a few layers of `withColumns`, so that any number of
indicators over one table share one exchange and, in most cases, one sort.

How this holds for large tables:

* Bars have one row per (symbol, time bucket): a symbol that holds a third of all *ticks* has collapsed, by map-side
  aggregation, to at most one row per bucket before any window sees it.  A century of daily bars is 36,525 rows.
* A window holds the sorted rows of its task, once for each order.  Keys are therefore dealt over partitions whose number follows
  the bytes of the input (`dealt`), so that a task's memory does not grow with the tables.
* Series without such a bound (ticks, second bars) use `Series(..., block_rows=B, lookback=L)`.  Rows are numbered
  exactly without a window over the whole symbol, cut into blocks of B rows, and each block also receives the L rows
  before it.  Windows then run per (symbol, block); a hot symbol spreads over as many tasks as it has blocks.
  Running totals add the totals of earlier blocks.
"""

from __future__ import annotations

import math
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import corr_of, div, strict_greatest

_TMP = re.compile(r"_q\d+_")
ROW, BLOCK, OWN = "_row", "_block", "_own"
#: Bytes of input files per partition of a window stage.
PART_BYTES = 4_000_000
_BYTES: dict[tuple, int] = {}


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that `df` reads, from the listing alone; 0 where it reads none (local rows, checkpoints)."""
    files = tuple(sorted(df.inputFiles()))
    if files and files not in _BYTES:
        listed = df.sparkSession.read.format("binaryFile").load([unquote(f) for f in files])
        _BYTES[files] = listed.agg(F.sum("length")).first()[0]
    return _BYTES.get(files, 0)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by key over partitions whose number follows the input.

    The session's own number of partitions is fixed and small ones are merged by their compressed size, of which a window's sorted rows take fifty times as much.
    One part is left to the session; more are dealt over the session's cores at least, since a merge would bring them together again.
    """
    n = math.ceil(input_bytes(df) / PART_BYTES) if keys else 0
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def number_rows(df: DataFrame, keys: list[str], ts: str, chunk: Column) -> DataFrame:
    """Exact 1-based row number per key, without one window over the whole key.

    `chunk` must grow with `ts` (for example the month).  Rows are counted per (key, chunk); the running total of
    those counts, a table of one row per (key, chunk), gives the offset of each chunk.
    """
    chunked = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    return (
        chunked.join(offsets, [*keys, "_chunk"])
        .withColumn(ROW, F.col("_offset") + F.row_number().over(inside))
        .drop("_offset", "_chunk")
    )


def into_blocks(df: DataFrame, rows: int, lookback: int) -> DataFrame:
    """Each row goes to its own block and, when a later block looks back at it, to that block as well."""
    own = F.floor((F.col(ROW) - 1) / rows)
    last = F.floor((F.col(ROW) - 1 + lookback) / rows)
    return (
        df.withColumn("_home", own)
        .withColumn(BLOCK, F.explode(F.sequence(own, last)))
        .withColumn(OWN, F.col(BLOCK) == F.col("_home"))
        .drop("_home")
    )


class Layers:
    """Derived columns grouped by dependency: each layer is one `withColumns`."""

    def __init__(self, df: DataFrame):
        self._df, self._known, self._level, self._pending = df, {}, {}, {}
        self.source_columns = df.columns

    def let(self, expr: Column) -> Column:
        """Name an intermediate column.  Equal expressions are computed once."""
        text = str(expr)
        if text in self._known:
            return F.col(self._known[text])
        name = f"_q{len(self._known)}_"
        level = 1 + max([self._level[r] for r in set(_TMP.findall(text))], default=0)
        self._known[text], self._level[name] = name, level
        self._pending.setdefault(level, {})[name] = expr
        return F.col(name)

    def _flush(self) -> DataFrame:
        for level in sorted(self._pending):
            self._df = self._df.withColumns(self._pending[level])
        self._pending = {}
        return self._df

    def frame(self, outputs: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
        """Source columns (or `keep`) and the named outputs."""
        lets = {name: self.let(expr) for name, expr in outputs.items()}
        keep = self.source_columns if keep is None else keep
        return self._finish(self._flush()).select(*keep, *[c.alias(n) for n, c in lets.items()])

    def _finish(self, df: DataFrame) -> DataFrame:
        return df


class Series(Layers):
    """Rows of `df` ordered by `ts` inside `keys`, with a builder for derived columns."""

    def __init__(self, df: DataFrame, keys=("symbol",), ts: str = "ts", block_rows: int | None = None,
                 lookback: int = 0, chunk: Column | None = None):
        self.keys, self.ts, self.blocked = list(keys), ts, block_rows is not None
        source = df.columns
        if self.blocked:
            chunk = F.date_trunc("month", F.col(ts)) if chunk is None else chunk
            # cells divide a block; the margin is two cells of at least `lookback` rows: in the first one lagged
            # values settle, from the second one on running totals are exact as well
            self.cell = max(lookback, -(-block_rows // 16))
            self.cells = -(-block_rows // self.cell)
            df = into_blocks(number_rows(df, self.keys, ts, chunk), self.cell * self.cells, 2 * self.cell if lookback else 0)
            self.margin = 2 if lookback else 0
            self.part = [*self.keys, BLOCK]
            self.order = Window.partitionBy(*self.part).orderBy(ROW)
        else:
            self.part = self.keys
            self.order = Window.partitionBy(*self.part).orderBy(ts)
            df = dealt(df, self.keys).withColumn(ROW, F.row_number().over(self.order).cast("long"))
        super().__init__(df)
        self.source_columns = source
        self._dense: set[str] = set()

    def _finish(self, df: DataFrame) -> DataFrame:
        """Rows of the look-back margin are gone."""
        return df.where(OWN) if self.blocked else df

    # ---- bar columns (looked up when used, a Column needs a running session) ------------------------------------
    @property
    def open(self) -> Column:
        return F.col("open")

    @property
    def high(self) -> Column:
        return F.col("high")

    @property
    def low(self) -> Column:
        return F.col("low")

    @property
    def close(self) -> Column:
        return F.col("close")

    @property
    def volume(self) -> Column:
        return F.col("volume")

    # ---- windows --------------------------------------------------------------------------------------------
    @property
    def row(self) -> Column:
        return F.col(ROW)

    def last_rows(self, n: int):
        return self.order.rowsBetween(-(n - 1), 0)

    def over(self, agg: Column, start: int, end: int) -> Column:
        """Aggregate over rows start..end relative to the current one."""
        return agg.over(self.order.rowsBetween(start, end))

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(x, n).over(self.order)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(x, n).over(self.order)

    def diff(self, x, n: int = 1) -> Column:
        return x - self.lag(x, n)

    def pct(self, x, n: int = 1) -> Column:
        return div(x, self.lag(x, n)) - 1

    def roll(self, f, n: int, *xs, guard=None) -> Column:
        """f over the last n rows, null until all n rows hold a value."""
        w = self.last_rows(n)
        xs = [F.col(x) if isinstance(x, str) else x for x in xs]
        seen = guard if guard is not None else xs[0]
        for other in xs[1:]:
            seen = F.when(other.isNotNull(), seen)
        return F.when(F.count(seen).over(w) == n, f(*xs).over(w))

    def roll_corr(self, n: int, x, y) -> Column:
        """Correlation over the last n rows, null until n complete pairs exist."""
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        w = self.last_rows(n)
        return F.when(F.count(F.when(y.isNotNull(), x)).over(w) == n, corr_of(x, y, w))

    def window_array(self, n: int, x) -> Column:
        """The last n values as an array, oldest first; null until n values exist."""
        w = self.last_rows(n)
        return F.when(F.count(x).over(w) == n, F.collect_list(x).over(w))

    def running(self, f, x, combine=None) -> Column:
        """Running aggregate from the first row of the key.

        In blocked mode the totals of earlier rows come from a table of one row per (key, cell).
        """
        return self.running_all([(f, x, combine)])[0]

    def running_all(self, specs) -> list[Column]:
        """Several running aggregates (f, x, combine) that share one table of cell totals."""
        upto = Window.unboundedPreceding
        if not self.blocked:
            return [f(x).over(self.order.rowsBetween(upto, 0)) for f, x, _ in specs]
        specs = [(f, self.let(x), combine or (lambda a, b: a + b)) for f, x, combine in specs]
        df = self._flush()
        marks = [f"_c{len(df.columns)}_{i}" for i in range(len(specs))]
        cell = F.floor((F.col(ROW) - 1) / self.cell)
        totals = df.where(OWN).groupBy(*self.keys, cell.alias("_cell")).agg(*[f(x).alias(m) for m, (f, x, _) in zip(marks, specs)])
        through = Window.partitionBy(*self.keys).orderBy("_cell").rowsBetween(upto, 0)
        # a block starts from the totals through the first cell of its margin (without margin: all earlier cells)
        last = self.margin if self.margin else 1
        at = F.col("_cell") + last
        carry = totals.select(*self.keys, "_cell", *[f(m).over(through).alias(m) for m, (f, _, _) in zip(marks, specs)]).where(
            at % self.cells == 0).select(*self.keys, (at / self.cells).cast("long").alias(BLOCK), *marks)
        self._df = df.join(carry, self.part, "left")
        counted = F.col(ROW) - 1 >= (F.col(BLOCK) * self.cells - (last - 1)) * self.cell
        out = []
        for m, (f, x, combine) in zip(marks, specs):
            local = f(F.when(counted, x)).over(self.order.rowsBetween(upto, 0))
            out.append(F.when(F.col(m).isNull(), local).when(local.isNull(), F.col(m)).otherwise(combine(F.col(m), local)))
        return out

    def running_sum(self, x) -> Column:
        return self.running(F.sum, x)

    def running_product(self, x) -> Column:
        return self.running(F.product, x, lambda a, b: a * b)

    def running_max(self, x) -> Column:
        return self.running(F.max, x, F.greatest)

    def ewm(self, x, span: float | None = None, alpha: float | None = None) -> Column:
        """Weighted mean with weights (1-alpha)^age over all earlier rows; nulls only age the weights.

        Rows are cut into segments on which (1-alpha)^-position stays far inside double range.  A row combines the
        running sums of its own segment with the sums of the segment before; anything older weighs less than e^-300.
        A null row has the mean of the last row with a value, however far back.  Cost per row is constant, whatever the span.
        """
        alpha = 2.0 / (span + 1) if alpha is None else alpha
        if alpha >= 1:
            return x
        lam = -math.log(1 - alpha)
        size = max(int(300 / lam), 2)
        x = self.let(x)
        seg = self.let(F.floor((self.row - 1) / size))
        pos = self.let((self.row - 1) % size)
        grow = F.exp(lam * pos)
        fade = F.exp(-lam * (size - 1 - pos))
        inside = Window.partitionBy(*self.part, seg).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*self.part).orderBy(seg).rangeBetween(-1, -1)
        has = x.isNotNull()
        zero = F.lit(0.0)
        num = self.let(F.sum(F.when(has, x * grow)).over(inside))
        den = self.let(F.sum(F.when(has, grow)).over(inside))
        num0 = self.let(F.sum(F.when(has, x * fade)).over(before))
        den0 = self.let(F.sum(F.when(has, fade)).over(before))
        here, there = F.exp(-lam * pos), F.exp(-lam * (pos + 1))
        top = F.coalesce(num * here, zero) + F.coalesce(num0 * there, zero)
        bottom = F.coalesce(den * here, zero) + F.coalesce(den0 * there, zero)
        mean = self.let(F.when(has, div(top, bottom)))
        return self._carried(mean, seg, self._is_dense(x))

    def _is_dense(self, x: Column) -> bool:
        """Whether x is a carried mean or a sum, difference or product of such: once it has a value, it has one on every row."""
        text = str(x)
        return bool(self._dense) and set(_TMP.findall(text)) <= self._dense and not re.search(r"[A-Za-z/%]", _TMP.sub("", text.removeprefix("Column<'")))

    def _carried(self, x: Column, seg: Column, dense: bool) -> Column:
        """The last value of x so far.  Rows stay in the order of segments in which their running sums left them, so nothing is sorted again.

        In blocked mode a block starts from the last value of all rows through the first cell of its margin, a table of one row per (key, cell).
        A mean of a dense column needs no table: the margin has its value.
        """
        upto = Window.partitionBy(*self.part).orderBy(seg, ROW).rowsBetween(Window.unboundedPreceding, 0)
        local = F.last(x, ignorenulls=True).over(upto)
        if not self.blocked or dense:
            return self._remember(self.let(local))
        df = self._flush()
        mark = f"_c{len(df.columns)}_last"
        cell = F.floor((F.col(ROW) - 1) / self.cell)
        last = df.where(OWN).groupBy(*self.keys, cell.alias("_cell")).agg(F.max_by(x, F.when(x.isNotNull(), F.col(ROW))).alias(mark))
        through = Window.partitionBy(*self.keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        first = self.margin if self.margin else 1           # as for running totals: exact values begin after the first cell of the margin
        at = F.col("_cell") + first
        carry = last.select(*self.keys, "_cell", F.last(mark, ignorenulls=True).over(through).alias(mark)).where(
            at % self.cells == 0).select(*self.keys, (at / self.cells).cast("long").alias(BLOCK), mark)
        self._df = df.join(carry, self.part, "left")
        settled = F.col(ROW) - 1 >= (F.col(BLOCK) * self.cells - (first - 1)) * self.cell
        exact = F.last(F.when(settled, x), ignorenulls=True).over(upto)
        return self._remember(self.let(F.when(settled, F.coalesce(exact, F.col(mark))).otherwise(F.coalesce(local, F.col(mark)))))

    def _remember(self, x: Column) -> Column:
        self._dense |= set(_TMP.findall(str(x)))
        return x

    @staticmethod
    def ewm_lookback(span: float | None = None, alpha: float | None = None) -> int:
        """Rows after which a weight is below double precision."""
        alpha = 2.0 / (span + 1) if alpha is None else alpha
        return math.ceil(36.8 / -math.log(1 - alpha)) if alpha < 1 else 1

    def true_range(self, high="high", low="low", close="close") -> Column:
        """Largest of the bar range and the two gaps from the previous close; null on the first row."""
        high, low = F.col(high), F.col(low)
        before = self.let(self.lag(close))
        return self.let(strict_greatest(high - low, F.abs(high - before), F.abs(low - before)))
