"""Group features of many key sets from one table of frequencies.

Every feature asks about some set of columns: a count about its keys, a distinct count or a mode about its keys and its value.
One pass over the rows gives the frequency of every combination of values of every such set, by grouping sets in one table. Counts are its rows; distinct counts and modes are roll-ups of it along the value. Numeric statistics of all key sets
come from one more pass in the same form. The result has a row per key with all statistics of that key, so however many
pairs are asked for, it takes the same number of scans and exchanges.

Putting the statistics back: key sets with few keys share one broadcast table, probed once per key set, and the rows
stay where they are. For the others each distinct combination of key values in the rows looks up all its key sets in one
join, and the rows take the answers in a second one. Both joins know the weight of every key, so the few that hold a large part
of the rows go by broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.skew import BROADCAST_KEYS, HOT_ROWS
from weft.sources.workspace import materialize

#: The key sets that share a broadcast table hold at most this many characters, ``ROW_CHARS`` for a row besides its text.
BROADCAST_CHARS = 64 << 20
ROW_CHARS = 64
#: Keys with more than this part of the rows are served by broadcast; there are fewer than this many in a key set.
HOT_PARTS = 2000
_SALTS = 1 << 20
#: Columns whose sets are grouped at once: a grouping id has a bit for each.
MASK_COLUMNS = 60

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Statistic:
    """``fn`` (count, nunique, mode or a numeric statistic) of ``value`` over the rows that share ``keys``."""

    name: str
    keys: tuple[str, ...]
    fn: str
    value: str | None = None

    @property
    def slot(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.keys)))


def text_of(df: DataFrame, column: str, name: str | None = None) -> Column:
    """The string by which equal values of a column meet, now under ``name``; both zeros are one."""
    return _text(F.col(name or column), df.schema[column].dataType)


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0).cast(kind)
    return c if isinstance(kind, T.StringType) else c.cast("string")


def _key(slot: Column, parts: Sequence[Column]) -> Column:
    """One unambiguous string for a key set and its values, null included."""
    written = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("n")) for p in parts]
    return F.concat(slot.cast("string"), *[x for w in written for x in (F.lit("|"), w)])


class Lattice:
    """The key sets of some statistics and how each is answered; ``source`` may have no rows left when they are only read."""

    def __init__(self, source: DataFrame, stats: Sequence[Statistic], aggregates: dict) -> None:
        self.source, self.stats, self.aggregates = source, list(stats), aggregates
        self.slots = sorted({s.slot for s in self.stats})
        self.slot_id = {s: i for i, s in enumerate(self.slots)}
        # what is rolled up along a value: (slot, value) -> number
        rolled = sorted({(s.slot, s.value) for s in self.stats if s.fn in ("nunique", "mode")})
        self.rolls = {r: i for i, r in enumerate(rolled)}
        self.sets = sorted(set(self.slots) | {tuple(sorted({*slot, value})) for slot, value in rolled})
        self.moments = sorted({(s.fn, s.value) for s in self.stats if s.fn not in ("count", "nunique", "mode")})
        self.columns = {c: i for i, c in enumerate(sorted({c for s in self.sets for c in s}))}

    def frequencies(self) -> DataFrame:
        """(columns, n, set): one scan and one exchange for all sets, for each ``MASK_COLUMNS`` columns."""
        out = None
        for batch in self._batches():
            cols = sorted({c for i in batch for c in self.sets[i]})
            names = {c: f"_c{self.columns[c]}" for c in cols}
            rows = self.source.select(*[F.col(c).alias(n) for c, n in names.items()])
            keys = [F.col(n) for n in names.values()]
            found = rows.groupingSets([[F.col(names[c]) for c in self.sets[i]] for i in batch], *keys).agg(
                F.grouping_id(*names.values()).alias("_mask"), F.count(F.lit(1)).alias("n"))
            number = F.create_map(*[F.lit(x) for i in batch for x in (self._mask(cols, i), i)])
            part = found.select(*names.values(), "n", number[F.col("_mask")].alias("set"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _mask(self, columns: list[str], i: int) -> int:
        """The grouping id of a set: a bit for each column that it leaves out, the first column's highest."""
        return sum(1 << (len(columns) - 1 - j) for j, c in enumerate(columns) if c not in self.sets[i])

    def _batches(self) -> list[list[int]]:
        batches: list[list[int]] = []
        held: set[str] = set()
        for i, s in enumerate(self.sets):
            if not batches or len(held | set(s)) > MASK_COLUMNS:
                batches, held = [*batches, []], set()
            batches[-1].append(i)
            held |= set(s)
        return batches

    def _entries(self) -> list[tuple[int, Column]]:
        """Per set what its rows are entries of: (set, (slot, roll, key, n, v, o, x)); roll -1 is the plain count."""
        out = []
        n = F.col("n")
        for i, s in enumerate(self.sets):
            at = {c: text_of(self.source, c, f"_c{self.columns[c]}") for c in s}
            if s in self.slot_id:
                out.append((i, self._entry(s, -1, at, n, F.lit(None).cast("string"), T.StringType())))
            for (slot, value), roll in self.rolls.items():
                if tuple(sorted({*slot, value})) == s:
                    out.append((i, self._entry(slot, roll, at, n, at[value], self.source.schema[value].dataType)))
        return out

    def _entry(self, slot: tuple[str, ...], roll: int, at: dict[str, Column], n: Column, v: Column, kind: T.DataType) -> Column:
        """``o`` and ``x`` order numbers as numbers where a mode has ties."""
        whole = v.try_cast("decimal(20,0)") if isinstance(kind, _INTEGRAL) else F.lit(None).cast("decimal(20,0)")
        real = v.try_cast("double") if isinstance(kind, _REAL) else F.lit(None).cast("double")
        number = self.slot_id[slot]
        return F.struct(F.lit(number).alias("slot"), F.lit(roll).alias("roll"),
                        _key(F.lit(number), [at[c] for c in slot]).alias("key"), n.alias("n"), v.alias("v"),
                        whole.alias("o"), real.alias("x"))

    def counts(self) -> DataFrame:
        """(slot, key, n, vals): per key its rows and, by number of the roll-up, distinct values and the mode."""
        by_set: dict[int, list[Column]] = {}
        for i, e in self._entries():
            by_set.setdefault(i, []).append(e)
        (first, entries), *rest = by_set.items()
        chosen = reduce(lambda c, item: c.when(F.col("set") == item[0], F.array(*item[1])), rest,
                        F.when(F.col("set") == first, F.array(*entries)))
        rows = self.frequencies().select(F.explode(chosen).alias("e")).select("e.*")
        nothing = F.lit(None).cast("string")
        if not self.rolls:  # every row of the frequencies is a key
            return rows.select("slot", "key", "n", F.array().cast("array<struct<roll:int,u:bigint,v:string>>").alias("vals"))
        keys = ("slot", "key", "roll")
        modes = sorted({self.rolls[s.slot, s.value] for s in self.stats if s.fn == "mode"})
        number = [F.sum("n").alias("n"), F.count("v").alias("u")]
        # numbers combine in hash tables; texts of modes need sorted groups and go by themselves
        rolled = rows.where(~F.col("roll").isin(modes)).groupBy(*keys).agg(*number).withColumn("v", nothing)
        if modes:
            best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("m"), "o", "x", "v")))
            rolled = rolled.unionByName(rows.where(F.col("roll").isin(modes)).groupBy(*keys).agg(*number, best["v"].alias("v")))
        return rolled.groupBy("slot", "key").agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("roll", "u", "v"))).alias("vals"))

    def numbers(self) -> DataFrame | None:
        """(key, m0, m1, ..): the numeric statistics, for all key sets that need any, in one scan and one exchange."""
        if not self.moments:
            return None
        slots = sorted({s.slot for s in self.stats if (s.fn, s.value) in self.moments})
        keys = [_key(F.lit(self.slot_id[s]), [text_of(self.source, c) for c in s]) for s in slots]
        values = sorted({v for _, v in self.moments})
        rows = self.source.select(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)],
                                  F.explode(F.array(*keys)).alias("key"))
        return rows.groupBy("key").agg(*[
            self.aggregates[fn](f"_v{values.index(v)}").alias(f"m{i}") for i, (fn, v) in enumerate(self.moments)])

    def table(self) -> DataFrame:
        """One row per key of every key set with all its statistics."""
        out, numbers = self.counts(), self.numbers()
        return out if numbers is None else out.join(numbers, "key", "left")

    def read(self, stat: Statistic, row: Column) -> Column:
        """The statistic from a row of the table."""
        if stat.fn == "count":
            return row["n"]
        if (stat.fn, stat.value) in self.moments:
            return row[f"m{self.moments.index((stat.fn, stat.value))}"]
        own = sorted([-1, *[i for (slot, _), i in self.rolls.items() if slot == stat.slot]])
        val = F.get(row["vals"], F.lit(own.index(self.rolls[stat.slot, stat.value])))
        return val["u"] if stat.fn == "nunique" else val["v"].cast(self.source.schema[stat.value].dataType)


def attach_weighted(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int, hot_rows: int,
                    out: str) -> DataFrame:
    """Left join of a written table on non-null ``keys``, its other columns as the struct ``out``.

    ``weight`` is the number of rows that hold a key: keys with at least ``hot_rows`` and more than one part in ``HOT_PARTS`` of
    all are broadcast. Rows served that way get a salt that matches nothing and are spread over the second join.
    """
    value = F.struct(*[c for c in table.columns if c not in keys])
    hot = (F.col(weight) >= hot_rows) & (F.col(weight) * HOT_PARTS > total)

    def side(part: DataFrame, tag: str) -> DataFrame:
        return part.select(*[F.col(k).alias(f"{tag}{i}") for i, k in enumerate(keys)], value.alias(f"{tag}v"))

    def on(tag: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{tag}{i}") for i, k in enumerate(keys)])

    served = rows.join(F.broadcast(side(table.where(hot), "_h")), on("_h"), "left")
    salt = F.when(F.col("_hv").isNotNull(), 1 + F.floor(F.rand(5) * _SALTS)).otherwise(F.lit(0)).cast("long")
    rest = side(table.where(~hot), "_c").withColumn("_cs", F.lit(0).cast("long"))
    done = served.withColumn("_salt", salt).join(rest, on("_c") & (F.col("_salt") == F.col("_cs")), "left")
    return done.select(*rows.columns, F.coalesce("_hv", "_cv").alias(out))


@dataclass(frozen=True)
class FittedStatistics:
    """Statistics as a written table: what the rows of a fit say, to be put on any rows, in any number of batches."""

    lattice: Lattice
    table: DataFrame

    @classmethod
    def fit(cls, rows: DataFrame, stats: Sequence[Statistic], aggregates: dict) -> FittedStatistics:
        lattice = Lattice(rows, stats, aggregates)
        return cls(lattice, materialize(lattice.table(), "statistics"))

    def save(self, path: str) -> None:
        """Write the table, the statistics and the columns' types below a folder."""
        used = [c for c in self.lattice.source.columns if c in self.lattice.columns or c in {
            v for _, v in self.lattice.moments}]
        spec = json.dumps({"stats": [[s.name, list(s.keys), s.fn, s.value] for s in self.lattice.stats],
                           "schema": json.loads(self.lattice.source.select(*used).schema.json())})
        self.table.write.parquet(f"{path}/table")
        self.table.sparkSession.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{path}/spec")

    @classmethod
    def load(cls, spark: SparkSession, path: str, aggregates: dict) -> FittedStatistics:
        spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
        stats = [Statistic(n, tuple(k), fn, v) for n, k, fn, v in spec["stats"]]
        source = spark.createDataFrame([], T.StructType.fromJson(spec["schema"]))
        return cls(Lattice(source, stats, aggregates), spark.read.parquet(f"{path}/table"))

    def put_on(self, rows: DataFrame, *, broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
        """``rows`` with every statistic as a column; null keys meet null keys, and keys of no row have nulls."""
        return _put_on(rows, self.lattice, self.table, broadcast_keys, hot_rows)


def add_statistics(rows: DataFrame, stats: Sequence[Statistic], aggregates: dict, *, over: DataFrame | None = None,
                   broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with every statistic as a column, taken over ``over`` or the rows themselves; null keys meet null keys."""
    fitted = FittedStatistics.fit(rows if over is None else over, stats, aggregates)
    return fitted.put_on(rows, broadcast_keys=broadcast_keys, hot_rows=hot_rows)


def _put_on(rows: DataFrame, lattice: Lattice, table: DataFrame, broadcast_keys: int, hot_rows: int) -> DataFrame:
    chars = ROW_CHARS + F.length("key") + F.coalesce(F.aggregate("vals", F.lit(0), lambda a, v: a + 24 + F.coalesce(
        F.length(v["v"]), F.lit(0))), F.lit(0))
    sizes = sorted((r["count"], r["slot"], r["chars"], r["rows"]) for r in table.groupBy("slot").agg(
        F.count(F.lit(1)).alias("count"), F.sum(chars).alias("chars"), F.sum("n").alias("rows")).collect())
    small, room = [], BROADCAST_CHARS
    for count, slot, size, _ in sizes:  # the smallest key sets share one broadcast
        if count > broadcast_keys or size > room:
            break
        small, room = [*small, slot], room - size
    present = {slot for _, slot, _, _ in sizes}
    large = [slot for slot in range(len(lattice.slots)) if slot not in small and slot in present]
    keys = {i: _key(F.lit(i), [_as_fitted(rows, lattice, c) for c in lattice.slots[i]]) for i in (*small, *large)}
    found: dict[int, Column] = {}

    out = rows
    if small:
        shared = table.where(F.col("slot").isin(small)) if large else table
        shared = shared.select("key", F.struct(*[c for c in table.columns if c not in ("slot", "key")]).alias("row"))
        # the same table every time: it is broadcast once
        out = out.select("*", *[keys[i].alias(f"_q{i}") for i in small])
        for i in small:
            side = shared.select(F.col("key").alias(f"_k{i}"), F.col("row").alias(f"_s{i}"))
            out = out.join(F.broadcast(side), F.col(f"_q{i}") == F.col(f"_k{i}"), "left").drop(f"_q{i}", f"_k{i}")
            found[i] = F.col(f"_s{i}")
    if large:
        used = sorted({c for i in large for c in lattice.slots[i]})
        texts = [_as_fitted(rows, lattice, c) for c in used]
        ids = [F.xxhash64(F.lit(seed), *texts, *[t.isNull() for t in texts]).alias(f"_id{seed}")
               for seed in (1, 2)]
        out = out.select("*", *ids)
        # each distinct combination of values asks once; 128 bits tell combinations apart
        asked = rows.select(*ids, *[keys[i].alias(f"_q{i}") for i in large]).groupBy("_id1", "_id2").agg(
            F.count(F.lit(1)).alias("_n"), *[F.first(f"_q{i}").alias(f"_q{i}") for i in large])
        asked = materialize(asked, "asked")
        each = asked.select("_id1", "_id2", "_n", F.posexplode(F.array(*[f"_q{i}" for i in large])).alias("_at", "_q"))
        total = max(r for *_, r in sizes)
        statistics = table.where(F.col("slot").isin(large)).withColumnRenamed("key", "_q").drop("slot")
        got = attach_weighted(each, statistics, ["_q"], "n", total, hot_rows, "_row")
        back = got.groupBy("_id1", "_id2").agg(F.max("_n").alias("_n"), F.array_sort(
            F.collect_list(F.struct("_at", "_row"))).alias("_rows"))
        out = attach_weighted(out, materialize(back, "answers"), ["_id1", "_id2"], "_n", total, hot_rows, "_back")
        found |= {i: F.get(F.col("_back")["_rows"], F.lit(at))["_row"] for at, i in enumerate(large)}
    return out.select(*rows.columns, *[
        (lattice.read(s, found[lattice.slot_id[s.slot]]) if lattice.slot_id[s.slot] in found
         else F.lit(None).cast(_type(lattice, s))).alias(s.name) for s in lattice.stats])


def _as_fitted(rows: DataFrame, lattice: Lattice, column: str) -> Column:
    """The text of a column of the rows in the type it had in the fit."""
    kind = lattice.source.schema[column].dataType
    if rows.schema[column].dataType == kind:
        return text_of(rows, column)
    return _text(F.col(column).try_cast(kind.simpleString()), kind)


def _type(lattice: Lattice, stat: Statistic) -> T.DataType:
    """The type of a statistic of no rows."""
    if stat.fn in ("count", "nunique"):
        return T.LongType()
    if stat.fn == "mode":
        return lattice.source.schema[stat.value].dataType
    return lattice.source.agg(lattice.aggregates[stat.fn](stat.value)).schema[0].dataType
