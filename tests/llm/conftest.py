import os

import pytest
from pyspark.sql import functions as F

from tapewatch.llm.runtime import prepare

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Once upon a time the word went on. " * 4000


@pytest.fixture(scope="session")
def spark(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    line = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, line + "\n" + line.upper() + "\nanother line", "en", "a", 10),
        (1, line, "en", "a", 10),
        (2, line, None, None, None),
        (2, line, None, None, None),
        (3, None, "en", None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b\x0c\r \n", "en", "a", 7),
        (6, LONG, "en", "b", len(LONG)),
        (7, "Naïve 漢字 😀 café\n" * 30 + "x", "fr", "b", 1),
        (None, "no key: mail me at a.b@c.de or +1 (974) 555-3436, token = \"908038b7daaf91e730aa11\"", "en", "c", 5),
        (None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with further columns named like outputs of the operators."""
    docs = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    for name in ("key", "row", "words", "tokens", "ledger", "personal", "fingerprint", "licenses", "probability", "kept", "shard", "hits", "id", "line"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}
