"""Inner equi-joins of two key/value states on keys or JSON paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.json_values import comparable


def operand(frame_alias: str, path: str | None) -> Column:
    """The join value of one side: its key for None, else the comparable text at the path of its value."""
    return F.col(f"{frame_alias}.row_key") if path is None else comparable(F.col(f"{frame_alias}.row_value"), path)


def join_states(left: DataFrame, right: DataFrame, left_path: str | None, right_path: str | None) -> DataFrame:
    """left_key, left_value, right_key, right_value of every matching pair.

    Rows without the path fall out; JSON null joins as the text ``null``. The join value is projected
    first, so Spark picks broadcast or sort-merge by size and splits skewed keys at run time.
    """
    a = left.alias("a").select(F.col("a.row_key").alias("left_key"), F.col("a.row_value").alias("left_value"), operand("a", left_path).alias("on_left"))
    b = right.alias("b").select(F.col("b.row_key").alias("right_key"), F.col("b.row_value").alias("right_value"), operand("b", right_path).alias("on_right"))
    return a.join(b, F.col("on_left") == F.col("on_right")).drop("on_left", "on_right")
