from pyspark.sql import functions as F

from depweave.schema import HEALTH_SNAPSHOT
from depweave.sources.cache import load_facts, prune
from depweave.streaming.health import health_stream, read_series
from depweave.streaming.rescan import SOURCE_ROW, rescan_stream


def source(spark, *items):
    rows = [("head", f"{key}.py", "python", len(text), text, f"python:{key}") for key, text in items]
    return spark.createDataFrame(rows, SOURCE_ROW)


def test_each_content_is_parsed_once_over_batches(spark, tmp_path):
    incoming, facts, marks = (str(tmp_path / n) for n in ("in", "facts", "marks"))
    source(spark, ("a", "def f(): pass"), ("b", "import os")).write.mode("append").parquet(incoming)
    rescan_stream(spark, incoming, facts, marks).awaitTermination()
    source(spark, ("b", "import os"), ("c", "x = 1")).write.mode("append").parquet(incoming)
    rescan_stream(spark, incoming, facts, marks).awaitTermination()
    keys = [r["key"] for r in load_facts(spark, facts).orderBy("key").collect()]
    assert keys == ["python:a", "python:b", "python:c"]
    prune(spark, facts, spark.createDataFrame([("python:c",), ("python:z",)], "key string"))
    assert [r["key"] for r in load_facts(spark, facts).collect()] == ["python:c"]


def snapshot(spark, *stamps):
    df = spark.createDataFrame([(s,) for s in stamps], "timestamp string")
    columns = [F.lit(1).cast(f.dataType).alias(f.name) for f in HEALTH_SNAPSHOT.fields[1:]]
    return df.select("timestamp", *columns)


def test_health_series_is_bounded_and_survives_batches(spark, tmp_path):
    incoming, series, marks = (str(tmp_path / n) for n in ("in", "series", "marks"))
    snapshot(spark, "2024-01", "2024-02").write.mode("append").json(incoming)
    health_stream(spark, incoming, series, marks, keep=3).awaitTermination()
    snapshot(spark, "2024-03", "2024-04").write.mode("append").json(incoming)
    health_stream(spark, incoming, series, marks, keep=3).awaitTermination()
    assert [r["timestamp"] for r in read_series(spark, series).orderBy("timestamp").collect()] == [
        "2024-02", "2024-03", "2024-04",
    ]
