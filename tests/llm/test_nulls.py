"""Rows without an id, rows of nulls only, a table without rows: every operator gives a defined result and does not fail."""

import pytest

import corpus_pipeline as C
from tideglass.llm import chunks, exact_dedup, katz, language, licences, packing, pieces, quality, simhash, toxicity
from tideglass.llm.common import crc_mod


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(None, None, None, None, None), (None, "text without an id", "en", None, 18), (1, None, None, "s", None), (2, "some words of a text", "en", "s", 20), (2, "other words of a text", "de", "s", 21), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(2, 1, 0), (2, None, 1), (None, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "language": lambda d, m: language.predict(d, language.fit(d)),
    "quality": lambda d, m: quality.score(d, quality.fit(d, m)),
    "toxicity": lambda d, m: toxicity.score(d, toxicity.fit(d, m)),
    "encode": lambda d, m: pieces.encode(d, pieces.default_model()),
    "decode": lambda d, m: pieces.decode(pieces.encode(d, pieces.default_model()), pieces.default_model()),
    "exact": lambda d, m: exact_dedup.mark(d),
    "licences": lambda d, m: licences.scan(d),
    "fingerprints": lambda d, m: chunks.fingerprints(d),
    "neighbours": lambda d, m: chunks.with_neighbours(d),
    "simhash": lambda d, m: simhash.near_duplicates(d),
    "packing": lambda d, m: packing.pack(d, packing.default_tokenizer()),
    "katz": lambda d, m: katz.katz_scores(d, crc_mod("doc_id", 5) == 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_holes(name, holes, marks):
    assert len(OPERATORS[name](holes, marks).collect()) == 6


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, holes, marks):
    assert OPERATORS[name](holes.where("false"), marks.where("false")).collect() == []


def test_exact_groups_of_holes(holes):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark(holes).collect()}
    assert (None, 1, 3, False) in got and (1, 1, 3, True) in got and (None, None, 1, True) in got


def test_stages_on_holes_and_nothing(spark, sf_dir, holes):
    for rows in (holes, holes.where("false")):
        for name, stage in C.STAGES:
            rows = stage(spark, rows, sf_dir)
            assert name == "packing" or rows.columns == holes.columns
            rows.collect()
