"""Topic-trend reports (M1-M7): filters, per-topic sums, top-N, daily trend.

Every function returns lazy DataFrames; the caller runs the actions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.functions.text import matches
from trendlens.operators import aggregate as agg
from trendlens.operators import filters as flt
from trendlens.operators import topn
from trendlens.operators.joins import rows_of_top
from trendlens.plans.roles import Roles, detect_roles, present

# Fixed value: topics in the chart and the table.
TOP_N = 10


def filtered(df: DataFrame, roles: Roles, level1=None, level2=None, date_range=None) -> DataFrame:
    """Category, sub-category and day-range filters."""
    out = flt.by_levels(df, level1, level2, roles.level1, roles.level2)
    return flt.by_dates(out, roles.date, date_range)


def aggregated(df: DataFrame, roles: Roles) -> tuple[DataFrame, str]:
    """Per-topic sums of the metrics present, or row counts.

    Returns the frame and the column it is ranked by.
    """
    if roles.topic is None:
        raise ValueError("a topic column is needed to aggregate")
    metrics = [m for m in (roles.conversations, roles.messages, roles.users) if m]
    if metrics:
        return agg.sums_by(df, roles.topic, metrics), roles.conversations or metrics[0]
    return agg.counts_by(df, roles.topic, "count"), "count"


def top_topics(
    df: DataFrame,
    n: int = TOP_N,
    level1=None,
    level2=None,
    date_range=None,
    exclude_totals: bool = False,
    roles: Roles | None = None,
    rank: bool = True,
) -> DataFrame:
    """Top-N topics by the metric (M1-M4): filters, sums, order, limit, rank.

    ``exclude_totals`` drops the pre-rolled ``all``/``total``/``overall`` rows
    first, as the chart list does; the table list keeps them.
    """
    roles = present(roles or detect_roles(df.columns), df.columns)
    sums, sort_col = aggregated(filtered(df, roles, level1, level2, date_range), roles)
    if exclude_totals:
        sums = flt.drop_totals(sums, roles.topic)
    if rank:
        return topn.ranked_top(sums, n, sort_col, roles.topic)
    return topn.top_n(sums, n, sort_col, roles.topic)


def daily_trend(
    df: DataFrame,
    n: int = TOP_N,
    roles: Roles | None = None,
    day_name: str = "date_only",
    materialize: bool = True,
) -> DataFrame:
    """Daily metric of the chart's top-N topics.

    Topics are ranked on a (day, topic) aggregate; the top-N set (at most ``n``
    keys) is broadcast into a semi-join.  The aggregate is written once under
    ``spark.checkpoint.dir`` and both passes read it; lazily
    (``materialize=False``) Catalyst pushes the semi-join below the aggregate
    and reads the input a second time.  Missing days are not
    filled.
    """
    roles = present(roles or detect_roles(df.columns), df.columns)
    if roles.topic is None or roles.date is None or roles.conversations is None:
        raise ValueError("the trend needs topic, date and metric columns")
    topic, metric = roles.topic, roles.conversations
    base = agg.daily_sums(df, roles.date, topic, metric, day_name)
    if materialize:
        from trendlens.sources.writers import materialize as write_once

        base = write_once(base, "daily_sums")
    totals = base.groupBy(topic).agg(agg.total(metric, metric))
    top = topn.top_n(flt.drop_totals(totals, topic), n, metric, topic)
    trend = rows_of_top(base.filter(F.col(day_name).isNotNull()), top, topic, n)
    return trend.select(day_name, topic, F.coalesce(F.col(metric), F.lit(0)).alias(metric)).orderBy(
        day_name, topic
    )


def single_day(df: DataFrame, day, roles: Roles | None = None) -> DataFrame:
    """Per-topic sums for one day."""
    roles = present(roles or detect_roles(df.columns), df.columns)
    sums, _ = aggregated(flt.by_dates(df, roles.date, day), roles)
    return sums


def kpis(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Trend KPIs."""
    roles = present(roles or detect_roles(df.columns), df.columns)
    return agg.trend_kpis(df, roles.topic, roles.conversations, roles.users)


def level_search(df: DataFrame, column: str, term: str) -> DataFrame:
    """Distinct values of ``column`` containing ``term``, any case."""
    values = agg.distinct_values(df, column)
    return values.filter(matches(column, term, "contains"))


def level2_within(df: DataFrame, level1, level1_col: str = "level1", level2_col: str = "level2") -> DataFrame:
    """Sub-categories present under one category."""
    return agg.distinct_values(flt.by_value(df, level1_col, level1), level2_col)


def caption(level1=None, level2=None, date_range=None) -> str:
    """Chart caption from the active filters (K14); needs no data."""
    parts = []
    if flt._given(level1):
        parts.append(f"category: {level1}")
    if flt._given(level2):
        parts.append(f"subcategory: {level2}")
    bounds = flt.normalise_range(date_range)
    if bounds is not None:
        a, b = bounds
        if a is None or b is None:
            parts.append(f"dates: from {a}" if b is None else f"dates: to {b}")
        else:
            parts.append(f"dates: {a} to {b}" if a != b else f"date: {a}")
    return f" ({', '.join(parts)})" if parts else ""


def trend_base(df: DataFrame, roles: Roles, day_name: str = "date_only") -> DataFrame:
    """One aggregate by (day, topic) over all rows: row count and metric sums.

    Null days and null topics stay groups here, so every trending output can be
    derived from this frame: KPIs count all rows, per-topic sums drop the null
    topic, the trend drops the null day.
    """
    metrics = [m for m in dict.fromkeys((roles.conversations, roles.messages, roles.users)) if m]
    if metrics:
        agg.check_numeric(df, *metrics)
    day = F.to_date(F.col(roles.date)) if roles.date else F.lit(None).cast("date")
    return df.groupBy(day.alias(day_name), F.col(roles.topic)).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(m).alias(m) for m in metrics]
    )


def _base_sums(base: DataFrame, roles: Roles) -> tuple[DataFrame, str]:
    metrics = [m for m in dict.fromkeys((roles.conversations, roles.messages, roles.users)) if m]
    topic = roles.topic
    keyed = base.filter(F.col(topic).isNotNull()).groupBy(topic)
    if metrics:
        return keyed.agg(*[agg.total(m, m) for m in metrics]), roles.conversations or metrics[0]
    return keyed.agg(F.sum("_rows").alias("count")), "count"


def _base_kpis(base: DataFrame, roles: Roles) -> DataFrame:
    return base.agg(
        agg.total("_rows", "total_rows"),
        F.count_distinct(roles.topic).alias("unique_topics"),
        agg.total(roles.conversations, "total_conversations")
        if roles.conversations
        else agg.typed_null().alias("total_conversations"),
        agg.total(roles.users, "total_users") if roles.users else agg.typed_null().alias("total_users"),
    )


@dataclass
class TrendingReport:
    rows: DataFrame
    kpis: DataFrame
    chart_top: DataFrame
    table_top: DataFrame
    trend: DataFrame | None
    sort_col: str
    caption: str


def trending_report(
    df: DataFrame,
    roles: Roles | None = None,
    level1=None,
    level2=None,
    date_range=None,
    n: int = TOP_N,
    materialize: bool = True,
    day_name: str = "date_only",
) -> TrendingReport:
    """The trending tab (M7) as lazy frames: filtered rows (for export), KPIs,
    chart top-N (totals left out), table top-N (totals kept), daily trend.

    All outputs but ``rows`` come from one (day, topic) aggregate of the
    filtered rows; ``materialize=True`` writes it once under
    ``spark.checkpoint.dir`` (one job now), so the facts are scanned once for
    the whole report instead of once per output.
    """
    roles = present(roles or detect_roles(df.columns), df.columns)
    if roles.topic is None:
        raise ValueError("a topic column is needed to aggregate")
    rows = filtered(df, roles, level1, level2, date_range)
    base = trend_base(rows, roles, day_name)
    if materialize:
        from trendlens.sources.writers import materialize as write_once

        base = write_once(base, "trend_base")
    sums, sort_col = _base_sums(base, roles)
    chart = topn.top_n(flt.drop_totals(sums, roles.topic), n, sort_col, roles.topic)
    table = topn.ranked_top(sums, n, sort_col, roles.topic)
    trend = None
    if roles.date and roles.conversations:
        metric = roles.conversations
        dated = base.filter(F.col(day_name).isNotNull() & F.col(roles.topic).isNotNull())
        picked = rows_of_top(dated, chart, roles.topic, n)
        trend = picked.select(
            day_name, roles.topic, F.coalesce(F.col(metric), F.lit(0)).alias(metric)
        ).orderBy(day_name, roles.topic)
    return TrendingReport(
        rows=rows,
        kpis=_base_kpis(base, roles),
        chart_top=chart,
        table_top=table,
        trend=trend,
        sort_col=sort_col,
        caption=caption(level1, level2, date_range),
    )
