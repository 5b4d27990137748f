import pytest

#: A null id and text, empty and blank texts, short ones, repeated rows, ties, control strings, wide characters, long text.
TEXTS = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "ONE two three four five six seven eight nine ten", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \n\t ", "en", "b"),
    (6, "don't can't   won't\n\n<|endoftext|> ok", "en", "c"),
    (7, "Straße İstanbul ΟΔΥΣΣΕΥΣ 漢字 ﬁ Ḧ H̱ \u00a0x\x1cy", "de", None),
    (8, "short text", "en", "c"),
    (8, "short text", "en", "c"),
    (None, "no id here at all, no id", "en", "c"),
    (9, "word " * 30_000, "en", "a"),
    (10, "a" * 70_000, "en", "a"),
    (11, "Alpha beta\n" * 300 + "end", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    names = ("score", "size", "ord", "key", "bands", "n", "node", "root", "length", "sequence_id", "_rank", "target", "label", "range", "u", "v")
    df = spark.createDataFrame(TEXTS, SCHEMA)
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
