import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty, blank, very long and repeated texts, a repeated row, extra columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (0, base, "x", "src", 1), (1, base, "x", None, 2), (2, None, None, None, None), (3, "", "y", "src", 0), (4, " \n\t", "y", "src", 3),
        (5, base + " tail", "x", "src", 4), (6, "Ünï 日本 " * 40, "y", "src", 5), (7, "zz " * 30000, "y", "src", 6), (8, "one two", None, "src", 7),
        (8, "one two", None, "src", 7), (None, "no id " + base, "x", "src", 8), (-9, "head " + base[::-1] + " ▁ <s>", "x", "src", 9),
    ]
    return spark.createDataFrame([(*r, -1, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, bin string")


@pytest.fixture(scope="session")
def distinct_docs(edge_docs):
    """(sort key, doc_id, text or "") of each document once, in order; a null id comes first."""
    rows = {r["doc_id"]: r["text"] or "" for r in edge_docs.collect()}
    return sorted(rows.items(), key=lambda r: (r[0] is not None, r[0] or 0))
