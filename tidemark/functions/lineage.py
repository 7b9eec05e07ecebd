"""Tables that several steps read, or many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once: written to the shared folder in `spark.checkpoint.dir`, or kept in memory where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by its keys over as many tasks as shuffles have: a small file is read by one, however much its rows take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
