"""Cross-checks between independent formulations on the test tables."""

from pyspark.sql import functions as F

from helpers import SF_SMALL, rows
from trendlens.operators import aggregate as agg
from trendlens.operators import filters as flt
from trendlens.operators.brands import keyword_kpis
from trendlens.plans import brand, catalog, trending
from trendlens.sources import fixtures as fx


def test_trend_sums_to_topic_totals(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    trend = trending.daily_trend(facts, 10)
    by_topic = trend.groupBy("topic").agg(F.sum("raw_conversations").alias("s"))
    dated = facts.filter(F.col("date").isNotNull())
    totals = agg.topic_totals(dated).select("topic", F.col("raw_conversations").alias("s"))
    assert rows(by_topic) == rows(totals.join(by_topic.select("topic"), "topic", "left_semi"))


def test_chart_top_has_no_totals(spark):
    top = trending.top_topics(fx.topic_facts(spark, SF_SMALL), 10, exclude_totals=True)
    assert not {r.topic.lower() for r in top.collect()} & set(flt.TOTAL_TOPICS)
    table = trending.top_topics(fx.topic_facts(spark, SF_SMALL), 10)
    assert {"all", "Total"} <= {r.topic for r in table.collect()}


def test_eager_equals_mapped(spark):
    kw, m = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    mapped = brand.prepare_keywords(kw, m)
    eager = brand.overview(kw, m)
    plain = brand.overview_mapped(mapped)
    assert rows(agg.topic_volume(mapped)) == rows(brand.eager_topic_volume(brand.with_lists(kw), brand.pair_topics(kw, m)))
    assert rows(eager.brands) == rows(plain.brands)
    assert rows(eager.kpis) == rows(plain.kpis)
    lazy = brand.overview(kw, m, materialize=False)
    assert rows(lazy.kpis) == rows(plain.kpis) and rows(lazy.brands) == rows(plain.brands)
    assert rows(lazy.topics) == rows(plain.topics)
    for term in ("Brand#1", "Brand#2"):
        e, p = brand.brand_search(kw, m, term), brand.brand_search_mapped(mapped, term)
        assert rows(e.kpis) == rows(p.kpis) and rows(e.topics) == rows(p.topics)
        assert rows(e.keywords) == rows(p.keywords)
    for term in ("red", "gizmo", "> "):
        e, p = brand.topic_search(kw, m, term), brand.topic_search_mapped(mapped, term)
        assert rows(e.kpis) == rows(p.kpis) and rows(e.brands) == rows(p.brands)
        assert rows(e.keywords) == rows(p.keywords)


def test_kpis_without_brands(spark):
    kw = brand.with_lists(fx.keywords(spark, SF_SMALL)).filter("brands IS NULL")
    k = keyword_kpis(attach := brand.prepare_keywords(kw, None)).first()
    assert k.unique_brands == 0 and k.total_keywords == attach.count()


def test_export_re_read_equals_rows(spark):
    out = catalog.export_filtered_csv(spark, SF_SMALL)
    facts = flt.by_value(fx.topic_facts(spark, SF_SMALL), "level1", catalog.LEVEL1)
    assert rows(out) == rows(facts)


def test_partitioned_re_read_equals_input(spark):
    assert rows(catalog.partitioned_roundtrip(spark, SF_SMALL)) == rows(fx.topic_facts(spark, SF_SMALL))


def test_rollup_totals_equal_detail(spark):
    roll = catalog.daily_rollup(spark, SF_SMALL)
    facts = fx.topic_facts(spark, SF_SMALL)
    a = roll.agg(F.sum("raw_conversations")).first()[0]
    b = facts.agg(F.sum("raw_conversations")).first()[0]
    assert a == b


def test_composite_reports_run(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    rep = trending.trending_report(facts, level1=catalog.LEVEL1, date_range=catalog.DATE_RANGE)
    assert rep.caption == " (category: STANDARD, dates: 1996-01-01 to 1998-12-31)"
    assert rep.kpis.first().total_rows == rep.rows.count()
    assert rep.chart_top.count() <= 10 and rep.table_top.count() <= 10 and rep.trend.count() > 0
    kw, m = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    for st, val in (("Brand", "Brand#1"), ("Topic", "red"), ("Brand", None)):
        b = brand.brand_report(kw, m, st, val, date_range=("1995-01-01", "1995-02-28"), country="US")
        assert b.kpis.first().total_keywords == b.rows.count()


def test_salted_join_equals_plain(spark):
    from trendlens.operators.joins import attach_topics, attach_topics_salted

    kw, m = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    plain = attach_topics(kw, m)
    for salts in (1, 7):
        assert rows(attach_topics_salted(kw, m, salts)) == rows(plain)
    forced = brand.prepare_keywords(kw, m, max_broadcast_bytes=0, salts=5).drop("brands_list")
    assert rows(forced) == rows(plain)
    p = forced._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_report_without_metrics_or_dates(spark):
    df = spark.createDataFrame(
        [("a", "X"), ("a", "X"), ("b", "Y"), (None, "X"), ("All", "X")], "prompt string, category string"
    )
    rep = trending.trending_report(df, materialize=False)
    assert rep.sort_col == "count" and rep.trend is None
    assert [(r.prompt, r["count"]) for r in rep.chart_top.collect()] == [("a", 2), ("b", 1)]
    assert [(r.rank, r.prompt) for r in rep.table_top.collect()] == [(1, "a"), (2, "All"), (3, "b")]
    k = rep.kpis.first()
    assert (k.total_rows, k.unique_topics, k.total_conversations, k.total_users) == (5, 3, None, None)
    only_x = trending.trending_report(df, level1="X")
    assert only_x.kpis.first().total_rows == 4


def test_dedupe_counts_each_keyword_once(spark):
    kw, m = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    k = brand.overview(kw, m, dedupe=True).kpis.first()
    plain = brand.with_lists(kw).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v")).first()
    assert (k.total_keywords, k.total_volume) == (plain.n, plain.v)
    full = brand.overview(kw, m).kpis.first()
    assert full.total_keywords > k.total_keywords
    assert (full.unique_topics, full.unique_brands) == (k.unique_topics, k.unique_brands)


def test_report_rows_equal_joined_rows(spark):
    kw, m = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    mapped = brand.prepare_keywords(kw, m).drop("brands_list")
    cols = mapped.columns
    rep = brand.overview(kw, m)
    assert rows(rep.rows.select(*cols)) == rows(mapped)
    t = brand.topic_search(kw, m, "red")
    assert rows(t.rows.select(*cols)) == rows(brand.topic_rows(mapped, "red"))
    b = brand.brand_search(kw, m, "Brand#1")
    assert rows(b.rows.select(*cols)) == rows(brand.brand_rows(mapped, "Brand#1"))
    from trendlens.plans.brand import rows_from_topics

    topics = brand.pair_topics(kw, m)
    assert rows(rows_from_topics(brand.with_lists(kw), topics, 10**9, max_broadcast_bytes=0, salts=4).select(*cols)) == rows(mapped)


def test_reports_on_empty_selections(spark):
    kw, m = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    for rep in (brand.brand_search(kw, m, "no such brand"), brand.topic_search(kw, m, "no such topic")):
        k = rep.kpis.first()
        assert (k.total_keywords, k.unique_topics, k.total_volume, k.unique_brands) == (0, 0, 0, 0)
        assert rep.keywords.count() == 0 and rep.rows.count() == 0
    tr = trending.trending_report(fx.topic_facts(spark, SF_SMALL), level1="no such category")
    k = tr.kpis.first()
    assert (k.total_rows, k.unique_topics, k.total_conversations, k.total_users) == (0, 0, 0, 0)
    assert tr.chart_top.count() == 0 and tr.table_top.count() == 0 and tr.trend.count() == 0
