import pytest

#: Null and empty texts, null ids, repeated rows, equal texts, long texts, odd white space, clashing columns.
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
PASSAGE = " ".join(f"pass{i}" for i in range(60))


def odd_rows():
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from it all\nsecond line with quite a few words in it here"),
        (2, "the quick brown fox jumps over the lazy cat and runs away from it all\nsecond line with quite a few words in it here"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "a"),
        (7, "a"),
        (7, "a"),
        (8, "same id, one text"),
        (8, "same id, another text"),
        (None, "no id\nno id\nno id"),
        (None, "no id\nno id\nno id"),
        (None, "another without id"),
        (9, LONG),
        (10, f"before {PASSAGE} after"),
        (11, f"{PASSAGE} alone in the end"),
        (12, "ÄÖ ß 日本語\r\n#*$%&|<> 1.5 été\x0b\x0cx y z"),
        (13, "<|endoftext|> it's <|STARTOFTEXT|> x"),
        (14, "the " * 60),
        (15, LONG.replace("w5x3 ", "changed ")),
    ]
    sources = ["b", None, "a", "b", ""]
    return [(i, t, [None, "en", "de"][k % 3], sources[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "th", "fp", "kept", "_doc", "_id", "_text", "n_words", "size", "position", "shard", "part", "rank", "seq", "bucket", "_copies", "h", "slot", "piece", "n", "text_hash", "fingerprint")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with columns that clash with names that operators use."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
