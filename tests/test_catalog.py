"""Every registered query against its SQL over the same whole tables, at two sizes."""

from __future__ import annotations

import pytest

from quernel import catalog
from tests.conftest import SF

FOLDERS = dict.fromkeys([SF, "/root/testdata/sf0.01"])
#: Queries beyond SQL; tests/test_segmenters.py compares what they run with brute force.
NO_SQL = {"segment_arbitrated", "segment_discovered", "stems"}


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(name, folder, spark, same_rows):
    same_rows(catalog.QUERIES[name](spark, folder), catalog.SQL[name], folder)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_other_queries_give_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == NO_SQL


def test_entry_counts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lookups_read_the_folders_of_their_terms(spark, sf):
    """The plan of a text request scans postings only, with partition filters and pushed terms."""
    from quernel.plans import engine

    found = engine.search(catalog.docs(spark, sf), {"query": {"bool": {"must": [{"match": {"text": "license"}}, {"match": {"text": "with"}}]}}})
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert len(scans) == 1 and "field#" in scans[0].split("PartitionFilters:")[1] and "bucket#" in scans[0].split("PartitionFilters:")[1]
    assert "In(term, [license,with])" in scans[0]
    page = engine.search(catalog.docs(spark, sf), {"query": {"match": {"text": "license"}}, "fields": "lang"}).rows
    assert sum("FileScan" in x for x in page._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 0 and page.columns == ["doc_id", "score", "lang"]
