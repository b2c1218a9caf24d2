"""Per-key aggregation of a to-many side table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.ordered import OrderedRows
from weft.operators.skew import deal
from weft.sources.tables import CAT, MULTI_CAT, NUM, columns_of

# The result for a group without a usable value, and the list delimiter.
EMPTY = "0"
DELIMITER = ","

# Rows of one piece of a union text; longer groups go on in further pieces.
PIECE_ROWS = 10_000


def order_struct(order: Sequence[str], value: str) -> Column:
    """A total order: the given columns, then the value itself."""
    return F.struct(*order, F.col(value).alias("_value"))


def is_list(column: Column) -> Column:
    """Whether a multi-category value counts: present and not of length 1."""
    return column.isNotNull() & (F.length(column) != 1)


def cat_last(value: str, order: Sequence[str]) -> Column:
    """Last non-null category in row order, else the empty value."""
    latest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order_struct(order, value)))
    return F.coalesce(latest.cast("string"), F.lit(EMPTY))


def list_last(value: str, order: Sequence[str]) -> Column:
    """Last multi-category text that counts, else the empty value."""
    latest = F.max_by(F.col(value), F.when(is_list(F.col(value)), order_struct(order, value)))
    return F.coalesce(latest, F.lit(EMPTY))


def list_union_length(value: str) -> Column:
    """Characters of the joined text of all lists that count, without building it."""
    used = is_list(F.col(value))
    chars = F.sum(F.when(used, F.length(value).cast("long") + 1)) - 1
    return F.coalesce(chars, F.lit(len(EMPTY)).cast("long"))


def cat_union_length(column: str) -> Column:
    """Characters of the joined distinct values of one category, to be used over distinct rows of
    (key, column name ``c``, value ``v``)."""
    used = (F.col("c") == column) & F.col("v").isNotNull()
    chars = F.sum(F.when(used, F.length("v").cast("long") + 1)) - 1
    return F.coalesce(chars, F.lit(len(EMPTY)).cast("long"))


def fresh_length(column: str, fresh: str) -> Column:
    """``cat_union_length`` over the rows themselves, where ``fresh`` marks one row of each (key, value)."""
    chars = F.sum(F.when(F.col(fresh) & F.col(column).isNotNull(), F.length(F.col(column).cast("string")).cast("long") + 1)) - 1
    return F.coalesce(chars, F.lit(len(EMPTY)).cast("long"))


def _pieces(counted: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
            piece_rows: int, buckets: int | None) -> DataFrame:
    """Texts of ``piece_rows`` elements from rows (keys, order, value, ``_n`` copies)."""
    run = OrderedRows(counted, keys, order, buckets).running_sum(["_n"], "_end")
    return _cut(run, keys, F.col(value).cast("string"), piece_rows)


def _cut(run: DataFrame, keys: Sequence[str], text: Column, piece_rows: int) -> DataFrame:
    """Texts of ``piece_rows`` elements from rows (keys, text, ``_n`` copies, ``_end`` copies up to here)."""
    start = F.col("_end") - F.col("_n")
    first, last = F.floor(start / F.lit(piece_rows)), F.floor((F.col("_end") - 1) / F.lit(piece_rows))
    split = run.select(*keys, "_end", start.alias("_start"), text.alias("_t"),
                       F.explode(F.sequence(first, last)).alias("_piece"))
    here = F.least(F.col("_end"), (F.col("_piece") + 1) * piece_rows) - F.greatest(
        F.col("_start"), F.col("_piece") * piece_rows)
    texts = split.select(*keys, F.col("_piece").cast("int").alias("piece"), "_end",
                         F.array_join(F.array_repeat("_t", here.cast("int")), DELIMITER).alias("_t"))
    parts = texts.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct("_end", "_t"))).alias("_l"))
    return parts.select(*keys, "piece",
                        F.array_join(F.transform("_l", lambda x: x["_t"]), DELIMITER).alias("text"))


def cat_union_pieces(df: DataFrame, keys: Sequence[str], value: str, piece_rows: int = PIECE_ROWS,
                     buckets: int | None = None) -> DataFrame:
    """Sorted distinct values per key as text, in numbered pieces of bounded size.

    The union of a key is its pieces joined in order; a key with up to ``piece_rows`` distinct values
    has one. No task holds more than one piece, however large the key.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    found = _pieces(distinct.withColumn("_n", F.lit(1).cast("long")), keys, [value], value, piece_rows, buckets)
    return _fill_empty(df, keys, found)


def list_union_pieces(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                      piece_rows: int = PIECE_ROWS, buckets: int | None = None) -> DataFrame:
    """All lists that count per key, joined in row order, in numbered pieces of bounded size.

    Rows that agree on everything are interchangeable; they are counted before they are ordered, so any
    number of copies is one row in the sort.
    """
    by = list(dict.fromkeys((*keys, *order, value)))
    used = df.where(is_list(F.col(value))).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    found = _pieces(used, keys, [*order, value], value, piece_rows, buckets)
    return _fill_empty(df, keys, found)


def pieces_by_key(df: DataFrame, keys: Sequence[str], cats: Sequence[str], lists: Sequence[str], order: Sequence[str],
                  piece_rows: int = PIECE_ROWS, n_rows: int = 0) -> DataFrame:
    """``cat_union_pieces`` and ``list_union_pieces`` of many columns from one shuffle: (keys, column, piece, text).

    All rows of a key meet in one task, sorted on disk if need be; it is for keys that are not hot. ``n_rows`` is about how
    many rows ``df`` has and decides the number of tasks (see ``deal``).
    """
    kinds = list(dict.fromkeys(df.schema[c].dataType for c in (*cats, *lists)))
    places, values = [f"_o{i}" for i in range(len(order))], [f"_v{i}" for i in range(len(kinds))]

    def entry(column: str) -> Column:
        used = is_list(F.col(column)) if column in lists else F.col(column).isNotNull()
        by = [F.when(used & F.lit(column in lists), F.col(o)).alias(n) for o, n in zip(order, places, strict=True)]
        own = [(F.when(used, F.col(column)) if df.schema[column].dataType == k else F.lit(None).cast(k)).alias(n)
               for k, n in zip(kinds, values, strict=True)]
        return F.struct(F.lit(column).alias("column"), F.lit(column in lists).alias("_list"), *by, *own)

    # a row becomes one for each column, and that has a place for each kind
    dealt = deal(df, keys, n_rows * (len(cats) + len(lists)) * (1 + len(values)))
    every = dealt.select(*keys, F.explode(F.array(*map(entry, (*cats, *lists)))).alias("_e"))
    found = every.select(*keys, "_e.*").groupBy(*keys, "column", "_list", *places, *values).agg(F.count(F.lit(1)).alias("_n"))
    used = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    found = found.withColumn("_unused", ~used)
    copies = F.when(F.col("_unused"), 0).when(F.col("_list"), F.col("_n")).otherwise(1).cast("long")
    # what does not count comes last: there alone it stands for a key without a usable value
    by = Window.partitionBy(*keys, "column").orderBy("_unused", *places, *values)
    run = found.withColumn("_n", copies).withColumn("_end", F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.where(~F.col("_unused") | (F.col("_end") == 0))
    run = run.withColumns({c: F.when(F.col("_unused"), F.lit(1).cast("long")).otherwise(F.col(c)) for c in ("_n", "_end")})
    text = F.coalesce(*[F.col(v).cast("string") for v in values], F.lit(EMPTY))
    return _cut(run, [*keys, "column"], text, piece_rows)


def joined_pieces(df: DataFrame, texts: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  piece_rows: int = PIECE_ROWS, buckets: int | None = None) -> DataFrame:
    """All texts per key joined in the order given, in numbered pieces of ``piece_rows`` texts; ``df`` has all the keys."""
    by = list(dict.fromkeys((*keys, *order, value)))
    counted = texts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return _fill_empty(df, keys, _pieces(counted, keys, [*order, value], value, piece_rows, buckets))


def _fill_empty(df: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """Add the keys that have no usable value."""
    lone = df.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")
    return found.unionByName(lone.select(*keys, F.lit(0).alias("piece"), F.lit(EMPTY).alias("text")))


def whole_text(pieces: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One text cell per key from its pieces.

    A cell is one Spark string. A key with more than one piece does not belong in a cell and raises an
    error rather than being cut; keep such data as pieces, or as the union's length.
    """
    checked = F.when(F.col("piece") == 0, F.col("text")).otherwise(
        F.raise_error(F.lit("a union text has more than one piece; use the pieces or the length")))
    return pieces.select(*keys, checked.alias(name))


def num_aggs(columns: Sequence[str], stats: Sequence[str] = ("mean", "sum"),
             name: str = "{s}__{c}") -> list[Column]:
    fns = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "nunique": F.count_distinct,
           "var": F.var_samp, "max": F.max, "min": F.min}
    return [fns[s](F.col(c)).alias(name.format(s=s, c=c)) for s in stats for c in columns]


def approx_nunique_aggs(columns: Sequence[str], rsd: float = 0.05) -> list[Column]:
    return [F.approx_count_distinct(c, rsd).alias(f"nunique__{c}") for c in columns]


def side_columns(df: DataFrame, keys: Sequence[str]) -> dict[str, list[str]]:
    """The columns a to-many aggregation uses: all typed ones but the join key and the times."""
    return {k: [c for c in columns_of(df, k) if c not in keys] for k in (NUM, CAT, MULTI_CAT)}
