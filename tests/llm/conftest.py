import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 700} the of {i}" for i in range(9000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and copies."""
    texts = [
        (1, "One two three four five."), (2, "One two three four five."), (2, "One two three four five."), (3, ""), (4, None), (None, "One two three four five."), (None, None), (5, " \t\n "), (6, LONG), (7, LONG + " tail"),
        (8, "start " + PASSAGE + " end"), (9, PASSAGE), (10, "other " + PASSAGE + " " + PASSAGE), (11, "line a\nline b\nline c"), (12, "line a\nline b\nnew"), (13, "x\nline b\nline c\n"), (14, "É à ñ 日本 \U0001f600 ok"), (15, "a a a a a a a a a a a a"),
        (16, "it is don't and 'tis"), (17, "a" * 5000), (18, "no\x85break\x1cinside\x0bvertical"),
    ]
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", len(t) if t else None) for k, (i, t) in enumerate(texts)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def extra(docs):
    """The same with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = "tag h row local content leaf fp size s shard start stop w window_id key ids part n spans score predicted count at doc".split()
    return docs.select("*", *(F.lit("clash").alias(n) for n in names))


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture
def rows():
    def collect(df, *columns):
        return sorted(map(repr, (tuple(r) for r in df.select(*(columns or df.columns)).collect())))

    return collect
