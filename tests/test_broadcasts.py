"""No side that grows with the tables goes through the driver to every task, however small Spark takes it for."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcasts(spark):
    """Every table that is broadcast for a join has more than 1 kB."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("name", ["batch_pairs", "unpaired_cases", "warning_reports", "compare_checks", "compare_cases", "field_match_rates", "what_to_look_at", "real_record_metrics"])
def test_no_table_is_broadcast(spark, no_broadcasts, name):
    assert __spark_entry__.queries()[name](spark, SF).collect()
