import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that the operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, 1), (2, "", 2), (3, "a", 3), (4, "a", 3), (5, long, 5), (5, long, 5), (6, long + " end", 6),
            (None, "no id here at all", 7), (7, " \t\n\x0b\x0c\r ", 8), (8, "É ÀB don't <|endoftext|> x y  z\n", 9), (9, None, 1)]
    extra = [f"{v} {n}" for n, v in {"score": "0.5D", "predicted": "'p'", "spans": "array(1)", "hits": "7", "items": "'i'", "longest": "1", "gone": "'x'", "gone_id": "doc_id", "c0": "'c'",
                                     "k1": "2", "site": "1", "digest": "'d'", "n": "1", "b": "2", "size": "3", "bytes": "4", "uid": "5", "component": "6", "class_id": "7"}.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long").selectExpr("*", *extra)
