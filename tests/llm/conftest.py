import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with internal names."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (1, "Alpha beta", "en", "a"), (2, "alpha BETA", None, None), (3, None, "en", "a"), (4, "", "en", "b"),
        (5, long, "en", "b"), (6, long + " end", "en", None), (None, "alpha beta", "en", "a"),
        (None, None, None, None), (7, "x" * 3000, "en", "c"), (8, " \n\t ", "en", "c"),
        (9, "Ünïcode ÄB text", "de", "c"), (9, "Ünïcode ÄB text", "de", "c"), (10, "ÜNÏCODE äb text", "de", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({
        "n_chars": F.length("text").cast("long"), "digest": F.lit("own"), "row": F.lit(1), "id": F.lit(2),
        "size": F.lit("s"), "count": F.lit(0)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
