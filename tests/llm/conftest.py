import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def text_rows(spark, rows):
    """documents with null columns and extra columns whose names clash with those the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, t string, fp string, length string, kept boolean, passes int, covers string, label int"
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", "y", "z", "w", True, 1, "c", 5) for i, t in rows], schema)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (5, "word " * 30_000), (6, "  \n\t "), (7, "é \x85 ü x")]
