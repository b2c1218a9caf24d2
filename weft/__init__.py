"""weft: relational feature engineering as Spark plans."""

from weft.sources.tables import Relation, TableSet, TableSpec

__all__ = ["Relation", "TableSet", "TableSpec"]
