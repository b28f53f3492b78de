import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("needs the test tables")
    return FOLDER


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns named like the operators' own."""
    line = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, "a"),
        (2, "", "b"),
        (3, " \t\n ", "c"),
        (None, "one two three", "d"),
        (5, "one two three", "e"),
        (6, line, "f"),
        (6, line, "f"),
        (7, line + " tail of its own", "g"),
        (8, "x " * 40000, "h"),
        (9, "The MIT License, and general, public  license! ÄÖÜ 東京 😀", "i"),
        (10, None, None),
    ]
    df = spark.createDataFrame([(a, b, c, 1, c, 2.5) for a, b, c in rows], "doc_id long, text string, k1 string, copies int, _k1 string, score double")
    return df.coalesce(2)


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)
