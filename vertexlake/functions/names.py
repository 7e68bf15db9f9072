"""Names: cleaning, telling apart repeated ones, lists in one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sanitize(c: Column) -> Column:
    """Every blank, hyphen, comma, slash, apostrophe and bracket becomes an underscore. Null stays null."""
    return F.regexp_replace(c, r"[ \-,/'\[\]()]", "_")


def tell_apart(df: DataFrame, name: str, id_: str, out: str = "unique_name") -> DataFrame:
    """`out`: the name, with `_id` after it from its second occurrence (in the order of ids) on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(id_))
    return df.withColumn(out, F.when(n > 1, F.concat_ws("_", name, F.col(id_).cast("string"))).otherwise(F.col(name)))


def split_cell(c: Column, sep: str) -> Column:
    """The non-empty parts of a cell; null and empty cells have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), sep), lambda x: x != "")
