"""Documents with nulls, empty and long texts, ties, repeats and columns of clashing names."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("_hash", T.StringType()),
        T.StructField("shard", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("component_id", T.LongType()),
    ]
)

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions under old bridges".split()


def prose(seed: int, count: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed + 3) + i * i // 5) % len(WORDS)] + str((seed * 31 + i) % 17) for i in range(count))


def documents(spark):
    long_text = prose(5, 30_000)
    rows = [
        (1, "", "en", "a"),
        (2, None, None, None),
        (3, prose(1, 120), "en", "a"),
        (4, prose(1, 120), "en", "a"),
        (4, prose(1, 120), "en", "a"),
        (5, prose(1, 119) + " changed", "en", "b"),
        (6, long_text, None, "a"),
        (7, long_text + " tail", "en", "a"),
        (None, prose(9, 80), "en", None),
        (None, prose(9, 80), None, "c"),
        (8, "  \n\t ", "en", "a"),
        (9, "One Word", "en", "a"),
        (10, "123 456", "de", "a"),
        (11, prose(11, 90), "de", "a"),
        (11, prose(12, 90), "de", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, "x", 99, "y", -1) for i, t, lang, s in rows], DOCUMENTS)


def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
