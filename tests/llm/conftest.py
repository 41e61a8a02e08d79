import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes ``documents`` from (doc_id, text) or (doc_id, text, source)."""

    def made(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df if not extra else df.selectExpr("*", *extra)

    return made


#: Columns that operators might use themselves.
CLASHING = ["1 AS size", "2 AS ids", "3 AS fp", "4 AS word", "'x' AS label", "5 AS node", "6 AS part", "7 AS score", "8 AS _text", "9 AS component", "'y' AS record_id", "10 AS passage", "11 AS n", "12 AS `a.b`", "13 AS c0", "14 AS `x y`"]


@pytest.fixture
def clashing():
    return CLASHING
