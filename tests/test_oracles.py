"""Every query with an SQL form agrees with it on the smallest tables."""

import pytest
from conftest import SF, values

from lexilake.plans.oracles import ORACLES
from lexilake.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(QUERIES)))
def test_agrees(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_every_query_has_one():
    assert set(QUERIES) == set(ORACLES)


def test_every_document_is_scored_through_the_api(spark):
    rows, docs = QUERIES["api_score_all"](spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.request_id for r in rows) == sorted(r.doc_id for r in docs.collect()) and {r.status for r in rows} == {200}
    assert {tuple(r) for r in QUERIES["api_score"](spark, SF).collect()} <= {(r.request_id, r.score, r.band, r.words) for r in rows}
