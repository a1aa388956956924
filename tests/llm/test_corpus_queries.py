"""Queries that SQL can express against DuckDB; the table shapes of the others."""

import pytest
from compare import same

from pulseforge.llm.oracles import ORACLES
from pulseforge.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_document(spark, sf, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(ids) and {r.doc_id for r in rows} == ids
