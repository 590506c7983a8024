"""Synthetic words, n-grams and mail addresses as seeded column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.operators.order import hash60


def pick(values: list[str], seed: int, *key: Column) -> Column:
    """A value drawn by the hash of a key; the same for the same key and seed."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (hash60(F.lit(seed), *key) % len(values) + 1).cast("int"))


def ngram(values: list[str], n: int, seed: int, *key: Column) -> Column:
    """n drawn words, parted by blanks."""
    return F.concat_ws(" ", *[pick(values, seed + i, *key) for i in range(n)])


def email(names: list[str], hosts: list[str], seed: int, *key: Column) -> Column:
    """name.name@host."""
    return F.concat(F.lower(pick(names, seed, *key)), F.lit("."), F.lower(pick(names, seed + 1, *key)), F.lit("@"), pick(hosts, seed + 2, *key))


def users(spark: SparkSession, n: int, names: list[str], hosts: list[str], seed: int = 0, version: int = 0) -> DataFrame:
    """Cells of n users: info:name and info:email."""
    key = F.col("id")
    rows = spark.range(n).select(key.alias("key"), ngram(names, 2, seed, key).alias("name"), email(names, hosts, seed, key).alias("email"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("qualifier"), F.col(c).alias("value")) for c in ("name", "email")])).alias("c")
    return rows.select("key", F.lit("info").alias("family"), F.lit(version).cast("bigint").alias("version"), each).select("key", "family", "c.qualifier", "version", "c.value")
