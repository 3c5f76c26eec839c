"""Stage functions on nulls, empty and long texts, repeats, empty tables and clashing extra columns."""

import pytest

import corpus_pipeline

LONG = " ".join(f"w{i}" for i in range(30_000)) + "."
RUN = " ".join(f"p{i}" for i in range(60)) + "."
ROWS = [(1, "", "en", "s", 0), (2, None, None, None, None), (None, RUN + " one", "en", "s", 5), (3, RUN + " two", "en", "s", 5), (3, RUN + " two", "en", "s", 5), (4, LONG, "en", "s", 9), (5, "word3 word4", "en", "s", 2)]
EXTRA = "key string, print int, block int, run int, first int, deleted_bytes string, score string, class_id int, n_hit int, __print int, __gone int, __parts int, __cut_id int, __number string, row int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(100, 130))), (8, None), (9, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, "gone", "s", 5, 6, 7, 8, 9, 10, "n", 11) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


STAGES = dict(corpus_pipeline.STAGES)
KEPT = {
    "quality_classifier": None,
    "line_dedup": [1, 2, 3, 3, 4, 5, None],
    "ngram_jaccard_join": [1, 3, 4, 5],
    "benchmark_decontamination": [1, 2, 3, 3, 4, 5, None],
}


@pytest.mark.parametrize("name", list(KEPT))
def test_stage_keeps_columns_and_rows(spark, docs, folder, name):
    out = STAGES[name](spark, docs, folder)
    rows = out.collect()
    assert [c for c in out.columns if c != "deleted_bytes"] == [c for c in docs.columns if c != "deleted_bytes"] and all(r["key"] == "k" and r["__print"] == 7 for r in rows)
    assert KEPT[name] is None or sorted((r.doc_id for r in rows), key=lambda d: (d is None, d)) == KEPT[name]
    empty = STAGES[name](spark, docs.limit(0), folder)
    assert empty.columns == out.columns and empty.collect() == []


def test_packing_takes_what_is_left(spark, docs, folder):
    rows = STAGES["best_fit_packing"](spark, docs, folder).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS) and STAGES["best_fit_packing"](spark, docs.limit(0), folder).collect() == []
