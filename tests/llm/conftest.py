import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the quick brown fox number {0} jumps over lazy dogs while seven wizards of box {0} quietly mix strong liquor "
         "and nobody in town {0} knows why any of them would ever want to leave that warm kitchen before winter ends or "
         "spring of year {0} comes back with rain and the river rises over its old stone bank near mill {0}")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table, with a column whose name clashes with results."""
    def make(rows):
        full = [(i, t, *(more + ["en", "s"][len(more):]), None if t is None else len(t)) for i, t, *more in rows]
        return spark.createDataFrame(full, DOCS).selectExpr(
            "*", "'x' AS n_tokens", "1 AS id", "2 AS key", "'y' AS h", "3 AS fp", "'z' AS `row`", "4 AS line")
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated, tied and very long texts, and a null id."""
    return [(1, None), (2, ""), (3, " \n\t\r\x0b "), (4, PROSE.format(4)), (4, PROSE.format(4)), (None, "Zürich ₿ 数据 é"),
            (5, "A  b\n\nA  b\nlast ▁ line <|endoftext|> <s>"), (6, ("word%d " * 3 % (1, 2, 3)) * 20_000), (7, "x" * 5_000)]
