import pytest

from leadline.llm import queries
from leadline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    queries.importable(session)
    return session


ROWS = [
    (1, "Write to ann@mail.org or +44 20 7946 0958 from 10.0.0.7 please.", "en", "a", 3),
    (1, "Write to ann@mail.org or +44 20 7946 0958 from 10.0.0.7 please.", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "a row without an id", "en", None, 1),
    (4, " ".join(f"w{k % 977}x{k % 13}" for k in range(30000)), "en", "a", 9),
    (5, "!!! ??? \n\t", "fr", "b", 2),
    (6, "übung macht den meister <|endoftext|> 4111 1111 1111 1111", "de", "b", 2),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "node", "y", "shard", "_part", "item_id", "words", "_first", "_node",
                 "_row", "root"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
