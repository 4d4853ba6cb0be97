import pytest

queries = pytest.importorskip("framelake.llm.queries")

COLUMNS = {
    "p2_found": [("context_key", "string"), ("media_a", "string"), ("media_b", "string")],
    "p3_found": [("sample_a", "bigint"), ("sample_b", "bigint")],
    "p5_found": [("pair_id", "bigint"), ("group_id", "bigint")],
    "p7_found": [("doc_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("doc_id", "bigint"), ("lang", "string")],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_with_the_given_columns(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    assert df.count() == df.distinct().count() > 0


def test_planted_terms_come_out(spark, data):
    got = queries.QUERIES["p2_planted"](spark, data.replace("sf0.001", "sf0.01")).toPandas()
    assert abs(got["first_term"].iloc[0] - queries.PLANTED_FIRST) < 0.15 and abs(got["draw_term"].iloc[0] - queries.PLANTED_DRAW) < 0.15
    assert got[["strength", "planted"]].corr().iloc[0, 1] > 0.6
