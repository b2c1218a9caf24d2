"""Order-sensitive operators over ranges of rows.

The rows are cut into contiguous ranges of (group, order) and written once. A window then works inside
one range, and what it needs from earlier ranges is carried in: the last ``k`` rows for fixed look-back,
one summary row for running values. A group may therefore be as long as the whole table, and no window
ever holds more than one range.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegerType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from weft.operators.skew import attach, key_profiles, same_keys
from weft.sources.workspace import materialize

BUCKET = "_bucket"
_HALO = "_halo"


class OrderedRows:
    """Rows in ranges of (``group``, ``order``). ``order`` has to be total within a group."""

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[str],
                 buckets: int | None = None) -> None:
        self.group = list(group)
        self.order = list(order)
        by = [F.col(c) for c in (*self.group, *self.order)]
        ranged = df.repartitionByRange(buckets, *by) if buckets else df.repartitionByRange(*by)
        self.columns = df.columns
        self.rows = materialize(ranged.withColumn(BUCKET, F.spark_partition_id()), "ranges")

    def _window(self) -> WindowSpec:
        return Window.partitionBy(BUCKET, *self.group).orderBy(*self.order)

    def _edge_rows(self) -> DataFrame:
        """Rows of the groups that touch an end of a range: only these can cross into another range."""
        if not self.group:
            return self.rows
        ends = self.rows.groupBy(BUCKET).agg(F.min(F.struct(*self.group)).alias("a"),
                                             F.max(F.struct(*self.group)).alias("b"))
        ends = ends.select(F.explode(F.array("a", "b")).alias("g")).distinct()
        ends = ends.select(*[F.col(f"g.{c}").alias(f"_e{i}") for i, c in enumerate(self.group)])
        # two groups per range at most
        return self.rows.join(F.broadcast(ends), same_keys([F.col(c) for c in self.group],
                              [F.col(f"_e{i}") for i in range(len(self.group))]), "left_semi")

    def _carry(self, summary: Mapping[str, Column], running: Mapping[str, Column]) -> DataFrame:
        """Running value of each summary over the earlier ranges of the same group.

        A range continues at most one group, so this has fewer rows than there are ranges.
        """
        per_range = self._edge_rows().groupBy(BUCKET, *self.group).agg(
            *[c.alias(n) for n, c in summary.items()])
        before = Window.partitionBy(*(self.group or [F.lit(0)])).orderBy(BUCKET).rowsBetween(
            Window.unboundedPreceding, -1)
        seen = F.count(F.lit(1)).over(before)
        return per_range.select(
            F.col(BUCKET).alias("_cb"), *[F.col(c).alias(f"_cg{i}") for i, c in enumerate(self.group)],
            *[c.over(before).alias(f"_c_{n}") for n, c in running.items()], seen.alias("_seen"),
        ).where(F.col("_seen") > 0).drop("_seen")

    def _join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        on = F.col(BUCKET) == F.col("_cb")
        if self.group:
            on = on & same_keys([F.col(c) for c in self.group],
                                [F.col(f"_cg{i}") for i in range(len(self.group))])
        return df.join(F.broadcast(carry), on, "left")

    def _with_halo(self, k: int) -> DataFrame:
        """The rows plus, in each range, the ``k`` rows of the same group that come before it."""
        edge = self._edge_rows()
        counts = edge.groupBy(BUCKET, *self.group).count()
        chains: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for r in counts.collect():  # two rows per range at most
            chains[tuple(r[c] for c in self.group)].append((r[BUCKET], r["count"]))
        links = []
        for key, chain in chains.items():
            chain.sort()
            for i, (source, _) in enumerate(chain):
                between = 0
                for target, n in chain[i + 1:]:
                    if between >= k:
                        break
                    links.append((*key, source, target, between))
                    between += n
        rows = self.rows.withColumn(_HALO, F.lit(False))
        if not links:
            return rows
        schema = StructType(
            [StructField(f"_g{i}", self.rows.schema[c].dataType) for i, c in enumerate(self.group)]
            + [StructField(n, IntegerType()) for n in ("_source", "_target", "_between")])
        link_df = self.rows.sparkSession.createDataFrame(links, schema)
        tail_order = Window.partitionBy(BUCKET, *self.group).orderBy(*[F.desc(c) for c in self.order])
        tails = edge.withColumn("_r", F.row_number().over(tail_order)).where(F.col("_r") <= k)
        on = F.col(BUCKET) == F.col("_source")
        if self.group:
            on = on & same_keys([F.col(c) for c in self.group],
                                [F.col(f"_g{i}") for i in range(len(self.group))])
        halo = tails.join(F.broadcast(link_df), on).where(F.col("_r") + F.col("_between") <= k)
        halo = halo.select(*self.columns, F.col("_target").alias(BUCKET), F.lit(True).alias(_HALO))
        return rows.unionByName(halo)

    def look_back(self, k: int, make: Mapping[str, object]) -> DataFrame:
        """Add columns that look at most ``k`` rows back; each value of ``make`` takes the window."""
        w = self._window()
        out = self._with_halo(k).select("*", *[f(w).alias(n) for n, f in make.items()])
        return out.where(~F.col(_HALO)).select(*self.columns, *make)

    def differences(self, columns: Sequence[str], orders: Sequence[int] = (1, 2),
                    name: str = "{c}_diff_{k}") -> DataFrame:
        """``x - x[k rows earlier]``; 0 where there is no earlier row or a value is missing."""
        make = {}
        for k in orders:
            for c in columns:
                make[name.format(c=c, k=k)] = (
                    lambda w, c=c, k=k: F.coalesce(F.col(c) - F.lag(c, k).over(w), F.lit(0.0)))
        return self.look_back(max(orders), make)

    def rolling(self, columns: Sequence[str], size: int = 10,
                stats: Sequence[str] = ("mean", "max", "min"), name: str = "{c}_roll_{s}") -> DataFrame:
        """Statistics over the last ``size`` rows including the current one; short windows count."""
        fns = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
        make = {}
        for s in stats:
            for c in columns:
                make[name.format(c=c, s=s)] = (
                    lambda w, c=c, s=s: fns[s](c).over(w.rowsBetween(-(size - 1), 0)))
        return self.look_back(size - 1, make)

    def row_number(self, name: str = "row_number") -> DataFrame:
        """Position of the row within its group, from 1."""
        inner = self.rows.withColumn("_p", F.row_number().over(self._window()).cast("long"))
        carry = self._carry({"n": F.count(F.lit(1))}, {"n": F.sum("n")})
        out = self._join_carry(inner, carry)
        return out.select(*self.columns, (F.col("_p") + F.coalesce("_c_n", F.lit(0))).alias(name))

    def running_sum(self, columns: Sequence[str], name: str = "{c}_cum") -> DataFrame:
        """Sum of each column over the rows up to and including this one."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        inner = self.rows.select("*", *[F.sum(c).over(w).alias(f"_s_{c}") for c in columns])
        carry = self._carry({c: F.sum(c) for c in columns}, {c: F.sum(c) for c in columns})
        out = self._join_carry(inner, carry)
        return out.select(*self.columns, *[
            (F.coalesce(f"_s_{c}", F.lit(0)) + F.coalesce(f"_c_{c}", F.lit(0))).alias(name.format(c=c))
            for c in columns])

    def forward_fill(self, columns: Sequence[str], name: str = "{c}") -> DataFrame:
        """Latest non-null value of each column at or before the row, within its group."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        inner = self.rows.select("*", *[F.last(c, True).over(w).alias(f"_f_{c}") for c in columns])
        last = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*self.order))) for c in columns}
        carry = self._carry(last, {c: F.last(c, True) for c in columns})
        out = self._join_carry(inner, carry)
        kept = [c for c in self.columns if c not in columns or name != "{c}"]
        return out.select(*kept, *[F.coalesce(f"_f_{c}", f"_c_{c}").alias(name.format(c=c)) for c in columns])


# Bits of the whole numbers that doubles are summed as.
_FIXED_BITS = 62


@dataclass(frozen=True)
class _Exact:
    """A column as parts whose sums are exact, so that the difference of two running sums is the sum between them.

    Doubles become whole multiples of a power of two, the largest with ``_FIXED_BITS`` bits; what is not a finite
    number is counted.
    """

    column: str
    kind: DataType
    shift: int = 0

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str]) -> list[_Exact]:
        """The form of each column, after one pass for the largest doubles."""
        kinds = {c: df.schema[c].dataType for c in columns}
        real = [c for c, k in kinds.items() if isinstance(k, (FloatType, DoubleType))]
        found = df.agg(*[F.max(F.when(F.abs(c) < float("inf"), F.abs(c))).cast("double").alias(c) for c in real]
                       ).first() if real else {}
        # a power that a double holds, whatever the largest value
        shift = {c: min(_FIXED_BITS - math.frexp(found[c] or 1.0)[1], 1000) for c in real}
        return [cls(c, k, shift.get(c, 0)) for c, k in kinds.items()]

    def parts(self) -> dict[str, Column]:
        c = F.col(self.column)
        out = {"n": F.when(c.isNotNull(), 1).otherwise(0).cast("decimal(38,0)")}
        if isinstance(self.kind, (FloatType, DoubleType)):
            c = c.cast("double")
            finite = F.abs(c) < float("inf")
            out["s"] = F.when(finite, F.rint(c * 2.0 ** self.shift).cast("bigint").cast("decimal(38,0)")).otherwise(0)
            for name, value in (("nan", float("nan")), ("up", float("inf")), ("down", float("-inf"))):
                out[name] = F.when(c == F.lit(value), 1).otherwise(0).cast("decimal(38,0)")
        else:
            scale = self.kind.scale if isinstance(self.kind, DecimalType) else 0
            out["s"] = F.coalesce(c.cast(f"decimal(38,{scale})"), F.lit(0).cast(f"decimal(38,{scale})"))
        return {f"_{name}_{self.column}": e for name, e in out.items()}

    def value(self, part: Callable[[str], Column]) -> Column:
        """The sum from the sums of the parts; null where no value took part."""
        def at(name: str) -> Column:
            return part(f"_{name}_{self.column}")

        if isinstance(self.kind, (FloatType, DoubleType)):
            total = at("s").cast("double") * 2.0 ** -self.shift
            odd = (at("nan") > 0) | ((at("up") > 0) & (at("down") > 0))
            total = F.when(odd, float("nan")).when(at("up") > 0, float("inf")).when(at("down") > 0, float("-inf")).otherwise(total)
        else:
            total = at("s") if isinstance(self.kind, DecimalType) else at("s").cast("bigint")
        return F.when(at("n") > 0, total)


def trailing_sum(df: DataFrame, time_col: str, columns: Sequence[str], seconds: int = 120,
                 name: str = "{c}_sum_{s}s", spread: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Sum of each column over the ``seconds`` up to and including the row's time, over all rows.

    Rows are summed per instant first, so an instant shared by very many rows is one row of what follows. The sum of
    a stretch of time is the running sum at its end less the one before its start, which a look-up along the time order
    finds. Both run over ranges of equally many instants: no task's share depends on how many fall into ``seconds``.
    Running sums are kept exact (whole numbers of a fixed unit), so nothing is lost in the difference. Rows without a time have no sum.
    """
    micros = seconds * 1_000_000
    rows = df.withColumn("_us", epoch_micros(F.col(time_col)))
    exact = _Exact.of(df, columns)
    parts = {n: e for x in exact for n, e in x.parts().items()}
    instants = rows.where("_us is not null").groupBy("_us").agg(*[F.sum(e).alias(n) for n, e in parts.items()])
    ends = OrderedRows(instants, [], ["_us"], buckets).running_sum(list(parts), "_run{c}").select(
        "_us", *[F.col(f"_run{n}").alias(n) for n in parts])
    # one line of instants and of the times just before each window; the latest instant's running sum is carried on
    before = [F.col(n).alias(f"_b{n}") for n in parts]
    line = ends.select(F.col("_us").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_of"), *before).unionByName(
        ends.select((F.col("_us") - micros - 1).alias("_at"), F.lit(1).alias("_side"), F.col("_us").alias("_of")),
        allowMissingColumns=True)
    found = OrderedRows(line, [], ["_at", "_side"], buckets).forward_fill([f"_b{n}" for n in parts]).where("_side = 1")
    both = ends.join(found.select(F.col("_of").alias("_us"), *[f"_b{n}" for n in parts]), "_us")
    sums = both.select("_us", *[
        x.value(lambda n: F.col(n) - F.coalesce(F.col(f"_b{n}"), F.lit(0))).alias(name.format(c=x.column, s=seconds)) for x in exact])
    return attach(rows, sums, ["_us"], key_profiles(rows, [("_us",)])[("_us",)], spread=spread).drop("_us")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)
