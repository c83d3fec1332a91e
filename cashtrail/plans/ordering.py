"""Ordered work per key that does not rely on a key fitting one task.

A window ``PARTITION BY account`` puts an account in one task. That is the cheapest plan
while every account is small, so ``Ordered`` counts rows per key first (one column, combined
map-side) and uses it when the largest key stays below ``cashtrail.maxRowsPerTask``.
Otherwise the rows are range-partitioned by (key, order) into chunks and written once; windows
then run per (key, chunk) and small per-chunk summaries carry running values across chunks.
Both ways give the same rows. With no keys the same rule covers table-wide numbering.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

MAX_ROWS_CONF = "cashtrail.maxRowsPerTask"
MAX_ROWS_DEFAULT = 2_000_000
BROADCAST_CHUNKS = 500_000
CHUNK = "_chunk"


def row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(MAX_ROWS_DEFAULT)))


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in total)."""
    return sizes_of(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), F.col("n"))


def sizes_of(counts: DataFrame, n: Column) -> tuple[int, int]:
    """The same from a table of a row per key that holds its rows as ``n``."""
    row = counts.agg(F.max(n).alias("largest"), F.sum(n).alias("total")).first()
    return int(row.largest or 0), int(row.total or 0)


class Ordered:
    """Rows of ``df`` in a total order within each key. ``order`` must end in a unique column."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 sizes: tuple[int, int] | None = None):
        self.keys, self.order = list(keys), list(order)
        self.limit = row_limit(df)
        self.sizes = sizes or group_sizes(df, self.keys)
        self.chunked = self.sizes[0] > self.limit
        if self.chunked:
            self.n_chunks = max(2, math.ceil(2 * self.sizes[1] / self.limit))
            df = written(
                df.repartitionByRange(self.n_chunks, *self.keys, *self.order)
                .withColumn(CHUNK, F.spark_partition_id()), "ranged")
        self.df = df

    # -- windows -------------------------------------------------------------------------
    @property
    def parts(self) -> list[str]:
        return self.keys + ([CHUNK] if self.chunked else [])

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def _rows_so_far(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _with_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        """Attach per-chunk carries. Only a key that crosses a chunk border has one, and a border is crossed by one key:
        without the empty ones there are at most as many rows as chunks, so the check bounds what is broadcast."""
        held = [F.col(c).isNotNull() for c in carry.columns if c not in self.parts]
        carry = carry.filter(reduce(Column.__or__, held))
        if self.n_chunks <= BROADCAST_CHUNKS:
            carry = F.broadcast(carry)
        return df.join(carry, self.parts, "left")

    def _chunk_window(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def plain(self) -> DataFrame:
        return self.df.drop(CHUNK)

    def _set(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.__dict__.update(self.__dict__)
        other.df = df
        return other

    # -- operations ----------------------------------------------------------------------
    def with_columns(self, **cols: Column) -> "Ordered":
        return self._set(self.df.withColumns(cols))

    def previous(self, **cols: str) -> "Ordered":
        """``out=source``: the value of ``source`` one row earlier (null on the first row)."""
        w = self.window()
        if not self.chunked:
            return self._set(self.df.withColumns({o: F.lag(s).over(w) for o, s in cols.items()}))
        pack = F.struct(*[F.col(s).alias(o) for o, s in cols.items()])
        last = (
            self.df.groupBy(*self.parts)
            .agg(F.max_by(pack, F.struct(*self.order)).alias("_last"))
            .withColumn("_carry", F.lag("_last").over(self._chunk_window())).drop("_last")
        )
        got = self._with_carry(self.df.withColumn("_in", F.lag(pack).over(w)), last)
        pick = F.coalesce(F.col("_in"), F.col("_carry"))
        return self._set(
            got.withColumns({o: pick[o] for o in cols}).drop("_in", "_carry"))

    def running(self, **measures: Column) -> "Ordered":
        """Inclusive running sums of ``measures`` (nulls count as nothing)."""
        w = self._rows_so_far()
        if not self.chunked:
            return self._set(self.df.withColumns({o: F.sum(m).over(w) for o, m in measures.items()}))
        names = list(measures)
        src = self.df.withColumns({f"_m_{o}": m for o, m in measures.items()})
        before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        carry = src.groupBy(*self.parts).agg(*[F.sum(f"_m_{o}").alias(f"_s_{o}") for o in names])
        carry = carry.select(*self.parts, *[F.sum(f"_s_{o}").over(before).alias(f"_c_{o}") for o in names])
        got = self._with_carry(
            src.withColumns({o: F.sum(f"_m_{o}").over(w) for o in names}), carry)
        both = {o: F.when(F.col(f"_c_{o}").isNull(), F.col(o))
                   .otherwise(F.coalesce(F.col(o), F.col(f"_c_{o}") * 0) + F.col(f"_c_{o}"))
                for o in names}
        return self._set(got.withColumns(both).drop(
            *[f"_m_{o}" for o in names], *[f"_c_{o}" for o in names]))

    def numbered(self, name: str = "rn") -> "Ordered":
        """1-based position within the key."""
        if not self.chunked:
            return self._set(self.df.withColumn(name, F.row_number().over(self.window()).cast("long")))
        return self.running(**{name: F.lit(1).cast("long")})

    def next_known(self, **cols: str) -> "Ordered":
        """``out=source``: the first non-null ``source`` on a later row of the key.

        Looked up as the last known value before this row in the reverse order, so that a key of n rows takes n steps.
        """
        back = [F.col(o).desc() if isinstance(o, str) else o.desc() for o in self.order]
        w = Window.partitionBy(*self.parts).orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
        if not self.chunked:
            return self._set(self.df.withColumns(
                {o: F.last(s, ignorenulls=True).over(w) for o, s in cols.items()}))
        later = Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        order = F.struct(*self.order)
        carry = self.df.groupBy(*self.parts).agg(
            *[F.min_by(F.col(s), F.when(F.col(s).isNotNull(), order)).alias(f"_f_{o}")
              for o, s in cols.items()])
        carry = carry.select(*self.parts, *[
            F.last(f"_f_{o}", ignorenulls=True).over(later).alias(f"_c_{o}") for o in cols])
        got = self._with_carry(
            self.df.withColumns({o: F.last(s, ignorenulls=True).over(w) for o, s in cols.items()}),
            carry)
        return self._set(got.withColumns(
            {o: F.coalesce(F.col(o), F.col(f"_c_{o}")) for o in cols}
        ).drop(*[f"_c_{o}" for o in cols]))

    def trailing(self, ts: str, width: int, **measures: Column) -> "Ordered":
        """Sums over rows at or before this one (by order) with ``ts >= this.ts - width``.

        ``ts`` is an integer column that leads the order. The sum is the running sum minus the
        sum of the rows that are too old, so ties in ``ts`` follow row order.
        """
        if not self.chunked:
            old = Window.partitionBy(*self.keys).orderBy(ts).rangeBetween(
                Window.unboundedPreceding, -width - 1)
            rows = self._rows_so_far()
            return self._set(self.df.withColumns({
                o: F.sum(m).over(rows) - F.coalesce(F.sum(m).over(old), F.sum(m).over(rows) * 0)
                for o, m in measures.items()}))
        return self._difference(ts, -width, 0, measures, lambda run, cut, own: run - F.coalesce(cut, run * 0))

    def leading(self, ts: str, width: int, **measures: Column) -> "Ordered":
        """Sums over rows at or after this one (by order) with ``ts <= this.ts + width``.

        Measures must not be null.
        """
        if not self.chunked:
            upto = Window.partitionBy(*self.keys).orderBy(ts).rangeBetween(
                Window.unboundedPreceding, width)
            rows = self._rows_so_far()
            return self._set(self.df.withColumns({
                o: F.sum(m).over(upto) - F.sum(m).over(rows) + m for o, m in measures.items()}))
        return self._difference(ts, width, 2, measures, lambda run, cut, own: cut - run + own)

    def _difference(self, ts, shift, kind, measures, combine) -> "Ordered":
        """Running sum at ``ts + shift`` against the running sum at the row.

        The cut-off times join the same ordered sequence as the rows (ahead of rows of equal time
        for kind 0, behind them for kind 2) and read off the running sum there, so no task needs
        the whole key and no window its whole span.
        """
        names = list(measures)
        run = self.running(**{f"_r_{o}": m for o, m in measures.items()})
        rows = run.df.withColumns({f"_m_{o}": m for o, m in measures.items()})
        back = self.keys + self.order
        cut = rows.select(
            *back, (F.col(ts) + shift).alias("_at"), F.lit(kind).alias("_kind"),
            *[F.lit(None).cast(rows.schema[f"_m_{o}"].dataType).alias(f"_m_{o}") for o in names])
        data = rows.select(*back, F.col(ts).alias("_at"), F.lit(1).alias("_kind"),
                           *[f"_m_{o}" for o in names])
        seq = Ordered(cut.unionByName(data), self.keys, ["_at", "_kind"] + self.order,
                      (2 * self.sizes[0], 2 * self.sizes[1]))
        cuts = (seq.running(**{f"_o_{o}": F.col(f"_m_{o}") for o in names}).df
                .filter(F.col("_kind") == kind).select(*back, *[f"_o_{o}" for o in names]))
        got = rows.join(cuts, back, "left").withColumns({
            o: combine(F.col(f"_r_{o}"), F.col(f"_o_{o}"), F.col(f"_m_{o}")) for o in names})
        return self._set(got.drop(*[f"{p}{o}" for o in names for p in ("_r_", "_m_", "_o_")]))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float],
                      sizes: tuple[int, int] | None = None) -> DataFrame:
    """Linear-interpolated percentiles per key (nulls ignored).

    Small keys use Spark's ``percentile``, whose state is a map of one key's values. Beyond the
    row limit, equal values are counted first and ranks are read off running counts instead; the two values are
    weighed as ``percentile`` weighs them, so that both ways give the same bits.
    """
    df = df.filter(F.col(value).isNotNull())
    sizes = sizes or group_sizes(df, keys)
    if sizes[0] <= row_limit(df):
        return df.groupBy(*keys).agg(*[F.percentile(value, q).alias(o) for o, q in wanted.items()])
    ranked = counted_values(df, keys, value)
    aggs, out = [], []
    for o, q in wanted.items():
        pos = (F.col("total") - 1) * F.lit(float(q))
        aggs += [F.min(F.when(F.col("cum") > F.floor(pos), F.col(value))).alias(f"_lo_{o}"),
                 F.min(F.when(F.col("cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{o}")]
        lo, hi = F.col(f"_lo_{o}").cast("double"), F.col(f"_hi_{o}").cast("double")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi).alias(o))
    return ranked.groupBy(*keys).agg(F.max("total").alias("total"), *aggs).select(*keys, *out)


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with ``n``, running count ``cum`` and the key's ``total``."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = Ordered(counted, keys, [value]).running(cum=F.col("n")).plain()
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    if keys:
        return ranked.join(totals, keys)
    return ranked.join(F.broadcast(totals), F.lit(True))     # one row


def value_at_rank(ranked: DataFrame, keys: list[str], value: str, rank: Column, name: str) -> DataFrame:
    """Smallest value whose running count reaches ``rank`` (an expression over total)."""
    return ranked.groupBy(*keys).agg(F.min(F.when(F.col("cum") >= rank, F.col(value))).alias(name),
                                     F.max("total").alias("total"))


def interpolated(ranked: DataFrame, keys: list[str], value: str, level: Column, name: str) -> DataFrame:
    """Linear-interpolated quantile at ``level`` (an expression over total)."""
    pos = (F.col("total") - 1) * level
    got = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("cum") > F.floor(pos), F.col(value))).alias("_lo"),
        F.min(F.when(F.col("cum") > F.ceil(pos), F.col(value))).alias("_hi"), F.max("total").alias("total"))
    frac = pos - F.floor(pos)
    return got.withColumn(name, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).drop("_lo", "_hi")
