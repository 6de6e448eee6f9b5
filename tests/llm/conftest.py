import hashlib

import pytest


@pytest.fixture(autouse=True)
def checkpoint_dir(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


class Text:
    """Reproducible invented texts."""

    def __init__(self, seed):
        self.state = hashlib.sha256(str(seed).encode()).digest()

    def number(self, n):
        self.state = hashlib.sha256(self.state).digest()
        return int.from_bytes(self.state[:8], "big") % n

    def words(self, n, of=60):
        return [f"w{self.number(of)}" for _ in range(n)]


@pytest.fixture
def text():
    return Text(1)


@pytest.fixture
def odd_docs(spark):
    """Null ids and texts, empty texts, repeated rows, a long text, clashing columns."""
    long = " ".join(f"long{i % 977}" for i in range(30_000))
    rows = [
        (1, "one two three four five", "x", 1),
        (1, "one two three four five", "x", 1),
        (2, None, None, None),
        (3, "", "x", 3),
        (None, "one two three four five", None, 4),
        (None, None, None, None),
        (4, " \n\t ", "y", 5),
        (5, long, "y", 6),
        (6, long, None, 7),
        (7, "Ünï çödé 漢字 🙂 text with no ascii only", "z", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key long").selectExpr(
        "*", "'a' AS lang", "1L AS n_chars", "2 AS value", "3 AS n", "4 AS h", "5 AS uid", "6 AS size2"
    )


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
