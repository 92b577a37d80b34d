import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, lang, source]) as a table of documents."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls in every column, empty, blank and long texts, equal rows."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    return make_docs([
        (1, None, None, None), (2, ""), (3, " \n\t "), (None, "a null id has words", None, "t"), (4, long_text, "en", "t"),
        (5, "same row twice"), (5, "same row twice"), (6, "Same ROW twice", "en", None), (7, "ÄÖ ß 漢字 😀 x", "de"), (8, "..."),
    ])


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with extra columns named like outputs and helpers."""
    from pyspark.sql import functions as F

    for name in ("size", "shard", "slot", "score", "predicted", "position", "_row", "_id", "licenses", "kept", "n"):
        awkward = awkward.withColumn(name, F.lit("mine"))
    return awkward


def plain(rows):
    return sorted([tuple(r) for r in rows], key=repr)
