"""Conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent_turns(turns: DataFrame, n: int = 3, key: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """The last ``n`` turns of each conversation, then those of them that have text; ``back`` counts from the end."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("back", back.cast("long")).where((F.col("back") <= n) & (F.trim(F.coalesce(text_col, F.lit(""))) != ""))
