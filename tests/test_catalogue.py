import pytest
from oracle import same

from keystrata.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.CATALOGUE))
def test_matches_sql(spark, name):
    query, sql = catalogue.CATALOGUE[name]
    same(query(spark, SF), SF, sql)


@pytest.mark.parametrize("name", ["stream_ingest", "store_scan", "store_inspect", "flush_segments_in_batches", "bulk_append_numbers"])
def test_matches_sql_at_ten_times_the_size(spark, name):
    query, sql = catalogue.CATALOGUE[name]
    same(query(spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", sql)
