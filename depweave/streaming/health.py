"""Health snapshots that arrive one per scan, kept as a bounded series with its trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from depweave.operators.health import KEPT_SNAPSHOTS, retained
from depweave.schema import HEALTH_SNAPSHOT
from depweave.session import cut

STORED = T.StructType([*HEALTH_SNAPSHOT.fields, T.StructField("generation", T.LongType())])


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """The newest generation of the series; empty before the first batch."""
    try:
        kept = spark.read.schema(STORED).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], HEALTH_SNAPSHOT)
    newest = kept.agg(F.max("generation")).scalar()
    return kept.where(F.col("generation") == newest).select(*HEALTH_SNAPSHOT.fieldNames())


def health_stream(
    spark: SparkSession, incoming: str, series: str, checkpoint: str, keep: int = KEPT_SNAPSHOTS, once: bool = True
) -> StreamingQuery:
    """Append arriving snapshots to the series and keep the newest ones.

    Each batch writes a generation of its own, named by the batch, so a batch that is run again
    overwrites only itself and readers never see a half-written series.
    """
    arriving = spark.readStream.schema(HEALTH_SNAPSHOT).json(incoming)

    def absorb(batch: DataFrame, number: int) -> None:
        before = read_series(batch.sparkSession, series)
        merged = cut(retained(before.unionByName(batch).dropDuplicates(["timestamp"]), keep))
        merged.coalesce(1).write.mode("overwrite").parquet(f"{series}/generation={number}")

    writer = arriving.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
