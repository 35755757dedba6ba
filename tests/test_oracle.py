"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as contract
from checks import oracle
from checks.compare import difference, frames

SF_DIR = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert contract.trip_queries().keys() == oracle.statements().keys()


@pytest.mark.parametrize("name", contract.trip_queries())
def test_query_equals_sql(spark, name):
    ours, theirs = frames(spark, name, SF_DIR)
    assert len(ours) > 0
    assert difference(ours, theirs) is None


@pytest.mark.parametrize(
    "name, rows",
    [("trip_summary", 4006), ("good_trips", 1052), ("stranded_trips", 2954),
     ("stitched_trips", 743), ("repaired_trips", 1795), ("visits", 492)],
)
def test_known_counts(spark, name, rows):
    assert contract.queries()[name](spark, SF_DIR).count() == rows


def test_flagship(spark):
    result = contract.entry(spark)
    assert "destination_string" in result.columns
    assert result.count() > 0
