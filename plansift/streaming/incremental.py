"""Work that is done once: by an anti-join with what is done, or by a checkpointed stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those that are done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def run_new_files(
    spark: SparkSession, source: str, schema, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], kind: str = "parquet"
) -> StreamingQuery:
    """Run ``step`` over the files that have come since the last call and append what it gives.

    The checkpoint remembers the files, so a run that breaks off goes on where
    it was. Stateless steps only.
    """
    stream = spark.readStream.schema(schema).format(kind).load(source)
    query = step(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def quarantine(df: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a test and rows that do not; a test that is null counts as not passed."""
    ok = F.coalesce(good, F.lit(False))
    return df.filter(ok), df.filter(~ok)
