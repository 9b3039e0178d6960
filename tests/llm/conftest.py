import pytest

#: Edge rows of every operator: nulls, empty and white texts, ties, repeats, a very long text, other scripts.
EDGE = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (2, "the quick brown  fox jumps over the lazy dog\nand runs away", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \t\n", "fr"),
    (6, "word", None),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund", "de"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund", "de"),
    (8, "日本語 テキスト   \x1c 🦊 ' don't 12,5%", "ja"),
    (9, "lorem ipsum dolor " * 9000, "la"),
    (10, "THE QUICK brown fox jumps over the lazy dog and runs away", "en"),
    (11, "a\x01b \x01 c", "en"),
    (12, "word word", "en"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows, with extra columns whose names clash with those the operators make."""
    rows = [(i, t, lang, "s", 1, 2, "x", "y") for i, t, lang in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp int, length int, digest string, component_id string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
