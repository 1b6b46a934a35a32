"""Tables that operators must bear."""

#: Names that operators might use inside; extra columns with them must do no harm.
CLASH = ["id", "text2", "n", "key", "h", "w", "part", "chunk", "block", "node", "crc", "size", "y", "p", "kind", "__k", "__b", "label2", "shard", "slot", "count", "host", "rule"]


def messy(spark, rows, schema):
    """A DataFrame of `rows` with extra columns of clashing names, null or not."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(f"x{i}" if i % 2 else None).cast("string").alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def document_rows():
    """Nulls in every column, empty, blank and long texts, repeated rows and texts."""
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:60])
    rows = [
        (1, base, "en", "a", 10), (2, base, None, "b", 10), (3, base.replace("w30", "zz"), "en", None, None), (4, None, "en", "a", 0), (5, "", "fr", "a", 0), (6, " \n\t ", None, None, 3),
        (7, "one two", "en", "a", 7), (8, "ONE two", "en", "a", 7), (9, " ".join(words), "de", "c", 9), (9, " ".join(words), "de", "c", 9), (10, "x" * 50_000, "en", "a", 1), (11, "the end. " * 20_000, "en", "a", 1),
        (12, "día niño 日本語 😀 'tis it's 12345", "es", "a", 1), (13, " ".join(reversed(words[:80])), "en", "d", 5), (14, "...!!! 123", "en", "a", 5), (15, None, None, None, None),
    ]
    return rows
