import pytest
from brute import rows

from stipendia.llm.tables import ship

@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def awkward(spark):
    schema = "doc_id long, text string, lang string, source string"
    found = spark.createDataFrame(rows(), schema)
    return found.selectExpr("*", "1 AS _id", "'z' AS _text", "2 AS kept", "3 AS n_words", "4 AS c0")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
