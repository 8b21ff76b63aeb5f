import pytest

LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the old barn", "a"),
    (2, "", "b"),
    (3, None, None),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from the old barn", "c"),
    (4, " \n\t ", "d"),
    (5, LONG, "e"),
    (6, "The Quick  brown\nfox jumps over the lazy dog and runs far away from the old barn", "f"),
    (6, "The Quick  brown\nfox jumps over the lazy dog and runs far away from the old barn", "f"),
    (7, "one", "g"),
    (7, "two words", "g"),
    (8, LONG + " tail", "h"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, repeated ids, and columns that could clash."""
    rows = [(*r, r[0], "k", "b", 1) for r in ODD_ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long, key string, block string, node int").repartition(2)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def rows_of(spark, small, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select("doc_id", "text").collect()]
