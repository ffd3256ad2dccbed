import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i % 97} of{i % 31} the line{i % 13}" for i in range(60))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids, extra columns named like results."""
    rows = [
        (1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (2, None, None, None, None), (3, "", "de", "b", 0),
        (None, PROSE, "en", "a", 5), (4, "   \n\t ", None, "a", 3), (5, "x " * 200_000, "fr", None, 7), (6, PROSE.upper(), "en", "a", 1),
        (7, "12 34 !! ##", "de", "b", 2), (7, "another text under id seven", "de", "b", 2), (8, "É日本 ﬁ\u0085 ok\x00z", "es", "c", 4),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    extra = {n: docs.doc_id for n in ("score", "kept", "component", "key", "node", "n_words", "line_gone", "positions", "size", "doc",
                                      "rule_stats", "gone_id")}
    return docs.withColumns(extra)


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (5, 0, 1), (99, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
