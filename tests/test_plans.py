"""Plan shape: the scale properties the design relies on."""

from ragchew import fixtures as fx
from ragchew.operators.lookup import lookup_call, small_dimension
from ragchew.operators.scoring import score_logs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_log_scoring_has_one_shuffle_by_station(spark, small_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        raw = fx.raw_logs(spark, small_dir)
        scored = score_logs(raw, "cqww", fx.prefix_dimension(spark, small_dir), strategy="per_log")
        plan = _plan(scored)
        # one exchange spreads the stand-in input, one hashes by (station, year)
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin") <= 2
        assert "hashpartitioning(mycall" in plan
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_prefix_lookup_does_not_shuffle_contacts(spark, small_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        raw = fx.raw_logs(spark, small_dir)
        dim = small_dimension(fx.prefix_dimension(spark, small_dir))
        out = lookup_call(raw, "call", dim)
        plan = _plan(out)
        assert "BroadcastHashJoin" in plan
        assert "SortMergeJoin" not in plan
        assert plan.count("Exchange hashpartitioning") == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_parquet_scan_prunes_columns(spark, small_dir):
    from ragchew import registry
    df = registry.q_catalog_calls(spark, small_dir)
    plan = _plan(df)
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
