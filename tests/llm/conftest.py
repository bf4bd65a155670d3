import random

import pytest
from llm_checks import AWKWARD

@pytest.fixture(scope="session")
def awkward(spark):
    """documents with nulls in every column, repeated rows and columns of clashing names."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i, "t", "r", "k") for i, t in enumerate(AWKWARD)]
    rows += [rows[6], (None, "no id at all here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, t string, row string, key string")


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return spark.createDataFrame([], awkward.schema)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture
def words():
    r = random.Random(5)
    return lambda n, of=400: " ".join(f"w{r.randrange(of)}" for _ in range(n))
