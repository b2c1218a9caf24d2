"""The data model: typed tables, the relations between them, and their readers and writers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.sources.workspace import materialize

# The semantic column types.
NUM = "num"
CAT = "cat"
TIME = "time"
MULTI_CAT = "multi-cat"
KINDS = (NUM, CAT, TIME, MULTI_CAT)

# The relation kinds, read from the left table to the right one.
RELATION_KINDS = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")

_KIND = "weft.kind"
_TABLE = "weft.table"
_KEY = "weft.key"
_ORIGIN = "weft.origin"
_PATH = "weft.path"


@dataclass(frozen=True)
class TableSpec:
    """Semantic types of one table's columns.

    ``order`` names the columns that make row order explicit where an aggregate takes the last row;
    ``keys`` are the category columns that identify things rather than describe them.
    """

    kinds: Mapping[str, str]
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relation:
    left: str
    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    kind: str
    #: Tells apart several relations between the same two tables; their keys do, without it.
    name: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in RELATION_KINDS:
            raise ValueError(f"unknown relation kind {self.kind!r}")
        if len(self.left_keys) != len(self.right_keys) or not self.left_keys:
            raise ValueError("a relation needs the same, non-zero number of keys on both sides")

    def flipped(self) -> Relation:
        a, _, b = self.kind.split("_")
        return Relation(self.right, self.left, self.right_keys, self.left_keys, f"{b}_to_{a}", self.name)

    @property
    def to_many(self) -> bool:
        return self.kind.endswith("many")


@dataclass(frozen=True)
class TableSet:
    """Related tables: one main table with a label, a time column and a row id, and its side tables."""

    tables: Mapping[str, DataFrame]
    specs: Mapping[str, TableSpec]
    relations: tuple[Relation, ...]
    main: str
    row_id: str
    time_col: str | None = None
    label: str | None = None

    def __post_init__(self) -> None:
        if self.main not in self.tables:
            raise ValueError(f"main table {self.main!r} is missing")
        for name, spec in self.specs.items():
            columns = set(self.tables[name].columns)
            unknown = [c for c in (*spec.kinds, *spec.keys, *spec.order) if c not in columns]
            if unknown:
                raise ValueError(f"table {name!r} has no column {unknown}")
            wrong = {k for k in spec.kinds.values() if k not in KINDS}
            if wrong:
                raise ValueError(f"unknown column kinds {sorted(wrong)}")
        for rel in self.relations:
            for name, keys in ((rel.left, rel.left_keys), (rel.right, rel.right_keys)):
                missing = [k for k in keys if k not in self.tables[name].columns]
                if missing:
                    raise ValueError(f"relation key {missing} is not in table {name!r}")

    def typed(self, name: str) -> DataFrame:
        """The table with its semantic types in the column metadata, columns of no use left out."""
        df, spec = self.tables[name], self.specs[name]
        if name != self.main:
            joined = [k for r in self.relations for t, ks in ((r.left, r.left_keys), (r.right, r.right_keys))
                      if t == name for k in ks]
            used = {*spec.kinds, *spec.keys, *spec.order, *joined}
            df = df.select(*[c for c in df.columns if c in used])
        return tag_table(df, name, spec)

    def with_table(self, name: str, df: DataFrame) -> TableSet:
        return replace(self, tables={**self.tables, name: df})


def tagged(column: Column, name: str, kind: str | None, table: str, key: bool = False,
           origin: str = "raw", path: str = "") -> Column:
    """``column`` under ``name``, carrying its semantic type and lineage: the table it is from, and the relations
    that lead there from the rows it is on."""
    meta: dict[str, object] = {_TABLE: table, _KEY: key, _ORIGIN: origin}
    if path:
        meta[_PATH] = path
    if kind is not None:
        meta[_KIND] = kind
    return column.alias(name, metadata=meta)


def tag_table(df: DataFrame, table: str, spec: TableSpec) -> DataFrame:
    return df.select(*[tagged(F.col(c), c, spec.kinds.get(c), table, c in spec.keys) for c in df.columns])


def retag(df: DataFrame, like: DataFrame) -> DataFrame:
    """Put the metadata of ``like``'s columns back on the columns of ``df`` that share their names."""
    meta = {f.name: f.metadata for f in like.schema.fields}
    return df.select(*[F.col(c).alias(c, metadata=meta[c]) if meta.get(c) else F.col(c) for c in df.columns])


def columns_of(df: DataFrame, kind: str | None = None, *, table: str | None = None,
               key: bool | None = None, origin: str | None = None) -> list[str]:
    """Column names chosen by semantic type and lineage, never by parsing names."""
    out = []
    for f in df.schema.fields:
        meta = f.metadata or {}
        if kind is not None and meta.get(_KIND) != kind:
            continue
        if kind is None and _KIND not in meta:
            continue
        if table is not None and meta.get(_TABLE) != table:
            continue
        if key is not None and bool(meta.get(_KEY)) != key:
            continue
        if origin is not None and meta.get(_ORIGIN) != origin:
            continue
        out.append(f.name)
    return out


def kind_of(df: DataFrame, column: str) -> str | None:
    return (df.schema[column].metadata or {}).get(_KIND)


def table_of(df: DataFrame, column: str) -> str | None:
    return (df.schema[column].metadata or {}).get(_TABLE)


def path_of(df: DataFrame, column: str) -> str:
    """The relations from the rows to the column's table, ``/`` between them; empty for the rows' own columns."""
    return (df.schema[column].metadata or {}).get(_PATH, "")


def origin_of(df: DataFrame, column: str) -> str:
    return (df.schema[column].metadata or {}).get(_ORIGIN, "raw")


def is_key(df: DataFrame, column: str) -> bool:
    return bool((df.schema[column].metadata or {}).get(_KEY))


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """One Parquet table per name; schemas come from the files."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a declared schema, so nothing is inferred and no extra pass is made."""
    return spark.read.csv(path, header=True, schema=schema)


def read_labels(spark: SparkSession, path: str, row_id: str = "row_id") -> DataFrame:
    """Labels for scoring: a CSV of (row id, label)."""
    return read_csv_table(spark, path, f"{row_id} bigint, label int")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): the lines of text files, numbered from 0 in the order of file names and lines.

    Files are read in splits by any number of tasks. A line's place within its split comes from the order in which it is
    read, the split's first place from the lengths of the splits before it: no line moves, and only a row per split is sorted.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_m"))
    lines = materialize(lines, "lines")
    splits = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.count(F.lit(1)).over(before).alias("_seen"))
    placed = lines.join(F.broadcast(starts.drop("_seen")), ["_file", "_block"])  # a row per split
    return placed.select((F.col("_start") + F.col("_m") - F.col("_first")).alias("position"), "value")


def read_label_column(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(position, label) from text files of one label a line; with ``header`` the very first line is a name."""
    lines = numbered_lines(spark, path)
    skipped = 1 if header else 0
    return lines.where(F.col("position") >= skipped).select(
        (F.col("position") - skipped).alias("position"), F.col("value").try_cast("int").alias("label"))


def write_scores(scores: DataFrame, path: str, row_id: str) -> None:
    """Scores as Parquet, range-partitioned and sorted by row id so that part files follow its order."""
    out = scores.select(row_id, "score").repartitionByRange(row_id).sortWithinPartitions(row_id)
    out.write.mode("errorifexists").parquet(path)
