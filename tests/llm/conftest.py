import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(15_000))
LINE = "A line that very many documents share, word by word."
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src0", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "one", "de", "src1", 3),
    (5, f"  {LINE} \nsome other words here\n{LINE.upper()}", "en", "src0", 90),
    (6, f"{LINE}\nnot the same at all", "en", "src0", 70),
    (7, f"{LINE}\r\nmore to read", None, "src2", 60),
    (8, LONG, "en", "src0", len(LONG)),
    (9, LONG + " end", "en", "src3", len(LONG) + 4),
    (10, "same words in both of these two rows", "fr", "src4", 36),
    (10, "same words in both of these two rows", "fr", "src4", 36),
    (11, "same words in both of these two rows", "fr", "src5", 36),
    (None, "an id is missing here, the text is not", "en", "src0", 38),
    (12, "Ünïcödé wörter ünd 日本語 und mehr davon", "de", "src6", 40),
    (13, "a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "src0", 49),
]
CLASHES = ["_gone", "_text", "words", "gone", "epoch", "_doc", "shard", "bands", "score", "_Score", "_count", "tokens", "rep", "_key", "_times", "_epoch", "_leaf_lang", "_leaf_0", "_leaf_8"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity there is."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns that bear the names of intermediate ones."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def none(spark):
    """No documents."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest given table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def shape(df, of):
    """Whether a frame has the columns of another."""
    return df.columns == of.columns
