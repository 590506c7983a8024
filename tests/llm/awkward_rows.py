"""Rows with every awkward case, and columns whose names clash."""

LONG = "the quick brown fox and the lazy dog meet again near the old river " * 4000

TEXTS = [
    (1, "The city of the river and the hills is old and it is the home of many people who work there every day.", "en"),
    (2, "Die Stadt an dem Fluss und die Berge sind alt und sie ist das Zuhause von vielen Menschen, die dort arbeiten.", "de"),
    (3, None, "en"),
    (4, "", "de"),
    (5, "!!! 123 ...", None),
    (6, "one two", "en"),
    (7, "one two", "en"),
    (7, "one two", "en"),
    (None, "La ciudad del río y las montañas es muy antigua y es el hogar de mucha gente que trabaja allí.", "es"),
    (None, None, None),
    (8, LONG, "en"),
    (9, "x" * 70_000, None),
    (10, "a\n\nb\r\n  c \U0001f642 世界 é \0 <|endoftext|>", "en"),
    (11, "The city of the river and the hills is old and it is the home of many people who work there every day.", "en"),
]
#: Extra columns whose names the operators use inside.
EXTRA = "c0 string, c1 int, tkey string, band bigint, bands string, number string, shard int, n_words string, spans string, items string, score string, value string, label string, copy string, t string, h string, u string, key string, seq int, run string, row string, stay_id string, cleaned string"


def frame(spark, rows, schema):
    """A table with the extra columns, all null."""
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    names = [c.split() for c in EXTRA.split(", ")]
    return df.select(*df.columns, *[F.lit(None).cast(kind).alias(n) for n, kind in names if n not in df.columns])
