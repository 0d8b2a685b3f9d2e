"""Every stage of the pipeline on odd tables: the caller's columns come through, whatever their names."""

import random

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, n_lines string, n_removed string, id string, h string, found string, n string"
OWN = ("score", "lang_pred", "n_lines", "n_removed", "id", "h", "found", "n")


@pytest.fixture(scope="module")
def rows(spark):
    out = [
        (r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    ]
    out += [(1001, None, None, None, None), (1002, "", "en", "a", 0), (None, out[0][1], "en", None, 5), (None, None, None, None, None), (1003, " \n\t", None, "b", 2), out[3], out[3]]
    out += [(1004, " ".join(random.Random(1).choices((out[0][1] or "").split(), k=20_000)), "en", "a", 9)]
    return [(*r, *[f"{c} of {k}" for c in OWN]) for k, r in enumerate(out)]


def test_stages_keep_the_columns_of_the_caller(spark, rows):
    given = {r[5]: r for r in rows}
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, step in P.STAGES[:-1]:
        kept = step(spark, docs, SF)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert got, name
        for r in got:
            want = given[r.score]
            assert tuple(r)[5:] == want[5:] and (r.doc_id, r.lang, r.source) == (want[0], want[2], want[3]), name
            assert name == "line dedup" or r.text == want[1]
    mixed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in mixed)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, step in P.STAGES:
        assert step(spark, docs, SF).collect() == []
