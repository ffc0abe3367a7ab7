"""Token-budgeted context from ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import smart_truncate

# What stands between hits and what it costs, the least room for a cut one, hits looked at.
SEPARATOR, SEPARATOR_TOKENS, LEAST_TAIL = "\n\n---\n\n", 2, 50
HITS = 50


def budgeted(hits: DataFrame, budget: int) -> DataFrame:
    """Hits (rank, content, token_count) with total, before, and part: full, cut, or dropped (null).

    Token counts are not negative, so the running total tells where the walk stops; it is over at most HITS rows.
    """
    w = Window.orderBy("rank")
    total = F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0)) + SEPARATOR_TOKENS * (F.row_number().over(w) - 1)
    seen = hits.withColumn("total", total).withColumn("n", F.row_number().over(w))
    seen = seen.withColumn("before", F.coalesce(F.lag("total").over(w), F.lit(0)))
    room = F.lit(budget) - F.when(F.col("n") > 1, F.col("before") + SEPARATOR_TOKENS).otherwise(F.lit(0))
    first_over = (F.col("total") > budget) & ((F.col("n") == 1) | (F.col("before") <= budget))
    part = F.when(F.col("total") <= budget, F.lit("full")).when(first_over & ((F.col("n") == 1) | (room > LEAST_TAIL)), F.lit("cut"))
    return seen.withColumn("room", room).withColumn("part", part)


def context(hits: DataFrame, budget: int) -> DataFrame:
    """One row: context, token_count, token_budget, truncated."""
    seen = budgeted(hits.orderBy("rank").limit(HITS), budget)
    piece = F.when(F.col("part") == "full", F.col("content")).otherwise(smart_truncate(F.col("content"), F.col("room")))
    tokens = F.when(F.col("part") == "full", F.col("token_count") + F.when(F.col("n") > 1, SEPARATOR_TOKENS).otherwise(0)).otherwise(F.col("room"))
    kept = seen.withColumn("piece", F.when(F.col("part").isNotNull(), piece)).withColumn("tokens", F.when(F.col("part").isNotNull(), tokens))
    return kept.agg(
        F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("rank", "piece")))), lambda x: x["piece"]), SEPARATOR), F.lit("")).alias("context"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("token_count"),
        F.lit(budget).cast("long").alias("token_budget"),
        F.coalesce(F.bool_or(F.col("total") > budget), F.lit(False)).alias("truncated"),
    )
