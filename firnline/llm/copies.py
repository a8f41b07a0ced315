"""Rows repeated a given number of times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def numbered_copies(df: DataFrame, copies: str, out: str) -> DataFrame:
    """Each row ``copies`` times (a long; at least once), numbered from 0 in ``out``, by blocks so that no array is long."""
    n, block = F.col(copies), F.col("_block_of_copies")
    blocks = df.withColumn("_block_of_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / F.lit(BLOCK)))))
    return blocks.withColumn(out, F.explode(F.sequence(block * BLOCK, F.least((block + 1) * BLOCK, n) - 1))).drop("_block_of_copies")
