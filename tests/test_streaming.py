"""Streaming ingest: stored once, late cells rank by version."""

from wideframe.plans import compiler
from wideframe.plans.request import DataRequest
from wideframe.streaming import ingest

SCHEMA = "key bigint, family string, qualifier string, version bigint, value string"


def test_append_and_running_latest(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "f", "q", 5, "new")], SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    for batch in ([(1, "f", "q", 3, "late"), (2, "f", "q", 1, "x")], []):
        ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        if batch:
            spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(source)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 3
    assert {(r["key"], r["value"]) for r in compiler.read(stored.select(*compiler.CELL), DataRequest.of("f")).collect()} == {(1, "new"), (2, "x")}
    query = ingest.latest(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["key"], r["value"]) for r in spark.table("running").collect()} == {(1, "new"), (2, "x")}
