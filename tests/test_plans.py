"""Plans are what they should be: pruned scans, one exchange a window, no nested loops."""

from __future__ import annotations

import re

from panelmill import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def run(spark, sf, name):
    return plan(catalog.queries()[name](spark, sf))


def test_many_leads_share_one_window(spark, sf):
    text = run(spark, sf, "panel_lags")
    assert len(re.findall(r"\bWindow \[", text)) == 1


def test_first_observation_limits_groups_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in run(spark, sf, "first_obs")


def test_age_windows_are_no_band_join(spark, sf):
    text = run(spark, sf, "age_window_profile")
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = run(spark, sf, "scan_filter")
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_orderpriority" not in text


def test_funnel_reads_once(spark, sf):
    assert run(spark, sf, "filter_funnel").count("lineitem.parquet") == 1


def test_quantiles_read_twice_and_shuffle_only_brackets(spark, sf):
    from panelmill.operators import weighted

    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = weighted.quantile_linear(rows, "l_extendedprice", (0.1, 0.5), "l_returnflag")
    text = plan(out)
    # the first scan is over when the plan is made; in the second the brackets meet the rows before any exchange of them
    assert text.count("lineitem.parquet") == 1 and "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    below = text[text.index("BroadcastHashJoin") :]
    assert "Exchange hashpartitioning" not in below


def test_bootstraps_make_a_row_a_replication_not_a_draw(spark, sf):
    text = run(spark, sf, "cluster_bootstrap")
    assert "Range (0, 300" in text and "CoGroup" in text and not re.search(r"Range \(0, (?!300)\d", text)


def test_labels_of_four_columns_are_one_join(spark, sf):
    text = run(spark, sf, "decode_lagged")
    assert text.count("Join") == 1 and "BroadcastExchange" in text
