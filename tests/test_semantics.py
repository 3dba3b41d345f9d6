"""Hand-made rows, one case per semantic rule (nulls, labels, lists, search,
dates, ties, CSV text)."""

import datetime as dt

import pytest

from helpers import rows
from trendlens.functions import brands as fb
from trendlens.functions.labels import fallback_label, mapped_label
from trendlens.operators import aggregate as agg
from trendlens.operators import filters as flt
from trendlens.operators import topn
from trendlens.operators.joins import attach_topics, topic_map
from trendlens.plans.roles import Roles, detect_roles, override_roles

FACTS = "topic string, level1 string, level2 string, raw_conversations bigint, raw_messages bigint, raw_users bigint, date date"


def test_null_key_is_not_a_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "topic string, raw_conversations bigint")
    out = agg.sums_by(df, "topic", ["raw_conversations"])
    assert rows(out) == [("a", 3)]


def test_all_null_sum_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "topic string, raw_conversations bigint")
    assert rows(agg.sums_by(df, "topic", ["raw_conversations"])) == [("a", 0)]
    kp = agg.trend_kpis(df, "topic", "raw_conversations", None).first()
    assert kp["total_conversations"] == 0 and kp["total_users"] is None


def test_null_null_join_matches(spark):
    kw = spark.createDataFrame([("k", 1, "x", None)], "keyword string, volume bigint, level1 string, level2 string")
    m = spark.createDataFrame([("T", "x", None)], "topic string, category string, sub_category string")
    assert [r.topic for r in attach_topics(kw, m).collect()] == ["T"]


def test_label_rules(spark):
    df = spark.createDataFrame(
        [(None, None, "q"), (None, None, None), (None, "A", None), ("", None, None), (None, "A", "b")],
        "topic string, level1 string, level2 string",
    )
    out = df.select(
        mapped_label("topic", "level1", "level2").alias("m"), fallback_label("level1", "level2").alias("f")
    ).collect()
    assert [(r.m, r.f) for r in out] == [
        (None, " > q"),
        (None, "Uncategorized"),
        ("A > ", "A > "),
        ("Uncategorized", "Uncategorized"),
        ("A > b", "A > b"),
    ]


def test_map_join_fans_out_and_keeps_misses(spark):
    kw = spark.createDataFrame(
        [("k1", 10, "A", "b"), ("k2", 5, None, "q"), ("k3", 1, "Z", None)],
        "keyword string, volume bigint, level1 string, level2 string",
    )
    m = spark.createDataFrame(
        [("T1", "A", "b"), ("T2", "A", "b"), (None, "Z", None)], "topic string, category string, sub_category string"
    )
    out = rows(attach_topics(kw, m), "keyword", "topic")
    assert out == [("k1", "T1"), ("k1", "T2"), ("k2", None), ("k3", "Z > ")]


def test_keyword_topic_column_is_replaced(spark):
    kw = spark.createDataFrame([("k", "old", "A", "b")], "keyword string, topic string, level1 string, level2 string")
    m = spark.createDataFrame([("T", "A", "b")], "topic string, category string, sub_category string")
    out = attach_topics(kw, m)
    assert out.columns.count("topic") == 1 and out.first().topic == "T"


def test_map_excludes_all_exact_case_keeps_null(spark):
    src = spark.createDataFrame(
        [("all", "A", "b"), ("All", "A", "b"), (None, "A", "b"), ("t", "A", "b"), ("t", "A", "b")],
        "topic string, category string, sub_category string",
    )
    assert rows(topic_map(src), "topic") == [("All",), ("t",), (None,)]


def test_chart_exclusion_any_case_three_words(spark):
    df = spark.createDataFrame([("ALL",), ("Total",), ("overall",), ("allx",), (None,)], "topic string")
    assert rows(flt.drop_totals(df)) == [("allx",), (None,)]


LIST_CASES = [
    ("['A', \"m's\"]", ["A", "m's"], ["A", "m's"]),
    ("[]", [], []),
    (None, [], []),
    ("", [], []),
    ("A, B", [], []),
    ("['it\\'s']", ["it's"], []),
    ("['a',]", ["a"], []),
    ("('A',)", ["A"], []),
    ("['a\\xa0b']", ["a\u00a0b"], []),
    ("['a'] junk", [], []),
    ("[null,'x']", [], []),
    ("not a list", [], []),
    ("'a', 'b'", ["a", "b"], []),
    ("[1, 2.5, None, True]", ["1", "2.5", "True"], []),
    ("[['nested']]", [], []),
]


def test_brand_lists_exact_and_loose(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in LIST_CASES], "s string")
    out = df.select(fb.parse_brands("s").alias("e"), fb.parse_brands("s", exact=False).alias("l")).collect()
    for (text, exact, loose), r in zip(LIST_CASES, out):
        assert list(r.e) == exact, text
        assert list(r.l) == loose, text


def test_literal_list_helper_matches_python():
    for text, exact, _ in LIST_CASES:
        got = fb.literal_list(text)
        assert (got or []) == exact


def test_duplicate_brand_counts_twice_in_volume(spark):
    df = spark.createDataFrame([("k", 5, "['a','a']")], "keyword string, volume bigint, brands string")
    df = df.withColumn("brands_list", fb.parse_brands("brands"))
    assert rows(agg.brand_volume(df)) == [("a", 10)]
    from trendlens.operators.brands import distinct_brands

    assert distinct_brands(df).count() == 1


def test_metacharacters_contains_vs_regex(spark):
    df = spark.createDataFrame([("a (b)",)], "topic string")
    assert flt.search(df, "topic", "a (b)", "contains").count() == 1
    assert flt.search(df, "topic", "a (b)", "regex").count() == 0
    with pytest.raises(ValueError):
        flt.search(df, "topic", "x", "glob")


def test_null_never_matches_search(spark):
    df = spark.createDataFrame([(None,), ("nan",)], "topic string")
    assert rows(flt.search(df, "topic", "na")) == [("nan",)]


def test_null_date_dropped_by_any_range(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2),), (None,)], "date date")
    assert flt.by_dates(df, "date", ("2000-01-01", "2100-01-01")).count() == 1
    assert flt.by_dates(df, "date", "2024-01-02").count() == 1
    assert flt.by_dates(df, "date", None).count() == 2
    with pytest.raises(ValueError):
        flt.by_dates(df, "date", ("2024-01-02",))


def test_date_range_inclusive_on_timestamps(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 23, 59),), (dt.datetime(2024, 1, 3, 0, 0),)], "ts timestamp_ntz"
    )
    assert flt.by_dates(df, "ts", ("2024-01-01", "2024-01-02")).count() == 1


def test_tie_breaks_on_key(spark):
    df = spark.createDataFrame([("x", 5), ("b", 5), ("c", 1)], "topic string, v bigint")
    out = topn.ranked_top(df, 2, "v", "topic").collect()
    assert [(r.rank, r.topic) for r in out] == [(1, "b"), (2, "x")]


def test_roles_case_insensitive_last_wins():
    r = detect_roles(["Category", "cat", "Topic", "Conversations", "users", "Date"])
    assert r == Roles(level1="cat", topic="Topic", conversations="Conversations", users="users", date="Date")
    r2 = override_roles(r, ["Category", "cat", "Topic", "Conversations", "users", "Date"], level1="Category", metric="None")
    assert r2.level1 == "Category" and r2.conversations is None
    with pytest.raises(ValueError):
        override_roles(r, ["a"], users="a")


def test_text_metric_raises(spark):
    df = spark.createDataFrame([("a", "1")], "topic string, raw_conversations string")
    with pytest.raises(ValueError):
        agg.sums_by(df, "topic", ["raw_conversations"])


def test_count_fallback_without_metrics(spark):
    from trendlens.plans.trending import top_topics

    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "topic string")
    out = top_topics(df, 10)
    assert [(r.rank, r.topic, r["count"]) for r in out.collect()] == [(1, "a", 2), (2, "b", 1)]


def test_bad_dates(spark):
    from trendlens.sources.readers import parse_dates

    df = spark.createDataFrame([("2024-01-02",), ("nope",), (None,)], "date string")
    got = [r.date for r in parse_dates(df, on_bad="null").collect()]
    assert got == [dt.datetime(2024, 1, 2), None, None]
    with pytest.raises(Exception):
        parse_dates(df, on_bad="fail").collect()


def test_numeric_categories_filter_as_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "level1 int, topic string")
    assert flt.by_value(df, "level1", "1").count() == 1
    assert flt.by_value(df, "level1", "All").count() == 2


def test_after_first_is_exact(spark):
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(120)], "v string")
    got = [r.v for r in topn.after_first(df, "v", 50).collect()]
    assert got == [f"v{i:03d}" for i in range(50, 120)]
    assert topn.after_first(df, "v", 500).count() == 0
    assert [r.v for r in topn.page(df, ["v"], 10, 2).collect()] == [f"v{i:03d}" for i in range(20, 30)]


def test_metric_override_to_users_sums_once(spark):
    from trendlens.plans.trending import aggregated

    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 20)], "topic string, raw_conversations bigint, raw_users bigint"
    )
    roles = override_roles(detect_roles(df.columns), df.columns, metric="raw_users")
    sums, sort_col = aggregated(df, roles)
    assert sort_col == "raw_users" and sums.columns == ["topic", "raw_users"]
    assert rows(sums) == [("a", 30)]


def test_null_label_rows_leave_topic_sums_but_stay_in_brand_sums(spark):
    from trendlens.plans import brand

    kw = spark.createDataFrame(
        [("k1", 10, "['A']", None, "q"), ("k2", 5, "['A', 'B']", "X", "y")],
        "keyword string, volume bigint, brands string, level1 string, level2 string",
    )
    m = spark.createDataFrame([("T", "X", "y")], "topic string, category string, sub_category string")
    for rep in (brand.overview(kw, m), brand.overview(kw, m, materialize=False)):
        assert rows(rep.topics) == [("T", 5, 1)]
        assert rows(rep.brands) == [("A", 15), ("B", 5)]
        k = rep.kpis.first()
        assert (k.total_keywords, k.unique_topics, k.total_volume, k.unique_brands) == (2, 1, 15, 2)
    mapped = brand.prepare_keywords(kw, m)
    assert rows(brand.overview_mapped(mapped).brands) == [("A", 15), ("B", 5)]
    assert rows(mapped, "keyword", "topic") == [("k1", None), ("k2", "T")]


def test_reports_without_a_map_use_fallback_labels(spark):
    from trendlens.plans import brand

    kw = spark.createDataFrame(
        [("k1", 10, "['A']", None, None), ("k2", 5, "['A', 'B']", "X", None), ("k3", 1, "[]", "X", "y")],
        "keyword string, volume bigint, brands string, level1 string, level2 string",
    )
    for materialize in (True, False):
        rep = brand.brand_report(kw, None, "Brand", None, materialize=materialize)
        assert rows(rep.rows, "keyword", "topic") == [("k1", "Uncategorized"), ("k2", "X > "), ("k3", "X > y")]
        assert rows(rep.topics) == [("Uncategorized", 10, 1), ("X > ", 5, 1), ("X > y", 1, 1)]
        assert rep.kpis.first().total_keywords == 3
        t = brand.topic_search(kw, None, "x >", materialize=materialize)
        assert rows(t.keywords, "keyword", "topic") == [("k2", "X > "), ("k3", "X > y")]


def test_text_volume_raises_in_brand_reports(spark):
    from trendlens.plans import brand

    kw = spark.createDataFrame([("k", "10", "['A']", "X", "y")], "keyword string, volume string, brands string, level1 string, level2 string")
    with pytest.raises(ValueError):
        brand.overview(kw, None)
