"""Plans: what reaches the scan, what is shuffled."""

import __spark_entry__ as entry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicators_shuffle_once(spark, sf):
    text = plan(entry.queries()["loop_indicators"](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scans_read_named_columns(spark, sf):
    text = plan(entry.queries()["two_periods"](spark, sf))
    assert "o_orderdate" in text and "ReadSchema: struct<o_orderkey" not in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(entry.queries()["as_of_join"](spark, sf))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type," in text
