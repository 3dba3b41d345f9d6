"""Plan shape: the physical plans the reports must (not) have."""

from helpers import SF_SMALL
from trendlens.plans import brand, catalog, trending
from trendlens.sources import fixtures as fx


def plan(df) -> str:
    """The final adaptive plan (the initial plan is cut off)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_map_join_is_never_a_nested_loop(spark):
    kw = brand.prepare_keywords(fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL))
    p = plan(kw)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BroadcastHashJoin" in p and "LeftOuter" in p


def test_top_n_is_take_ordered(spark):
    p = plan(catalog.top_topics_all(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    p = plan(catalog.brand_search_keywords(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_filters_reach_the_scan(spark):
    path = f"{SF_SMALL}/lineitem.parquet"
    df = spark.read.parquet(path)
    from trendlens.operators import filters as flt

    out = flt.by_dates(df, "l_shipdate", ("1996-01-01", "1996-12-31")).select("l_orderkey")
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in p
    cat = flt.in_values(spark.read.parquet(f"{SF_SMALL}/part.parquet"), "p_type", ["PROMO", "SMALL"])
    assert "In(p_type" in cat._jdf.queryExecution().executedPlan().toString()


def test_loose_lists_have_no_python(spark):
    kw = brand.with_lists(fx.keywords(spark, SF_SMALL), exact=False)
    assert "ArrowEvalPython" not in plan(kw)
    exact = brand.with_lists(fx.keywords(spark, SF_SMALL), exact=True)
    assert "ArrowEvalPython" in plan(exact)


def test_list_parser_runs_once_per_row(spark):
    kw, m = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    lazy = brand.topic_search(kw, m, "red", materialize=False)
    assert plan(lazy.brands).count("ArrowEvalPython") == 1
    # materialized: the summary was parsed and written once; outputs read it
    written = brand.topic_search(kw, m, "red", materialize=True)
    assert plan(written.brands).count("ArrowEvalPython") == 0
    assert plan(written.kpis).count("ArrowEvalPython") == 0


def test_report_outputs_read_only_their_written_frames(spark):
    """Materialized reports: every output reads the small written summaries,
    never the keyword or fact tables again, and nothing is a cross join."""
    rep = brand.overview(fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL), materialize=True)
    for df in (rep.topics, rep.brands, rep.kpis):
        p = plan(df)
        assert "part.parquet" not in p and "lineitem.parquet" not in p
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    tr = trending.trending_report(fx.topic_facts(spark, SF_SMALL), level1=catalog.LEVEL1)
    for df in (tr.kpis, tr.chart_top, tr.table_top, tr.trend):
        assert "lineitem.parquet" not in plan(df)
    assert "lineitem.parquet" in plan(tr.rows)


def test_lazy_overview_joins_no_keyword_rows(spark):
    """Unmaterialized: the lists are parsed once, and only distinct pairs meet
    the map, never keyword rows."""
    rep = brand.overview(fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL), materialize=False)
    p = plan(rep.brands)
    assert p.count("ArrowEvalPython") == 1 and "LeftOuter" not in p
    logical = rep.brands._jdf.queryExecution().optimizedPlan().toString()
    anti = logical[logical.index("LeftAnti") :]
    assert "Aggregate [level1" in anti


def test_trend_semi_join_is_broadcast(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    p = plan(trending.daily_trend(facts))  # both passes read the written aggregate
    assert "LeftSemi" in p and "BroadcastHashJoin" in p and "lineitem.parquet" not in p
    p = plan(trending.daily_trend(facts, materialize=False))
    assert "LeftSemi" in p and "BroadcastHashJoin" in p
    assert "ReusedExchange" in p or p.count("Exchange hashpartitioning(date_only") >= 1
