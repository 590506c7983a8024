"""File inspection: type by magic bytes, and readers for each type that Spark has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of file types, fixed by the formats.
MAGIC = {"sequence": b"SEQ", "avro": b"Obj\x01", "parquet": b"PAR1", "orc": b"ORC", "gzip": b"\x1f\x8b", "zstd": b"\x28\xb5\x2f\xfd"}


def file_types(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, type) of each file under a path; the content stays on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lit("text")
    for name, magic in MAGIC.items():
        kind = F.when(F.substring("content", 1, len(magic)) == F.lit(magic), name).otherwise(kind)
    return files.select("path", "length", kind.alias("type"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Contents of files of one type: rows of their own columns, or (value) lines."""
    types = [r["type"] for r in file_types(spark, path).select("type").distinct().limit(3).collect()]
    if len(types) != 1:
        raise ValueError(f"files of {len(types)} types under {path}: {sorted(types)}")
    if types[0] in ("parquet", "orc"):
        return spark.read.format(types[0]).load(path)
    if types[0] == "avro":
        return spark.read.format("avro").load(path)  # needs the connector on the class path
    if types[0] == "sequence":
        rows = spark.sparkContext.sequenceFile(path)  # Spark reads these as key-value pairs only
        return rows.map(lambda kv: (str(kv[0]), str(kv[1]))).toDF("key string, value string")
    return spark.read.text(path)
