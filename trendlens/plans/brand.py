"""Brand-volume reports (M8-M12): keywords joined to topics, searched by brand
or topic, summed per topic and per brand.

The dashboard joins every keyword to every topic of its (level1, level2) pair
and then counts the copies ("volume attributed in full to each topic").  A
keyword's topics depend on its pair alone, so the reports here never build
those copies:

* ``pair_topics``: one row per (pair, topic label) for the pairs the keywords
  use - a small frame (pairs x topics per pair), with the fallback label for
  pairs the map does not know.
* Sums, counts and brand volumes come from one ``posexplode_outer`` pass over
  the keywords grouped by (pair, brand) (``pair_brand_summary``) and are then
  weighted by the pair's number of topic rows.  Reports write that summary
  and the pair labels once when several outputs are asked for.
* The top-50 keyword table takes its candidates from the keyword side: every
  keyword gives at least one row, so the best rows come from keywords whose
  (volume, keyword) key is among the best keys; a bounded top-k finds them
  and only they (ties included, so the result is exact) meet their topics.

The same reports on the joined rows (``*_mapped``) stay available and serve
as the reference in tests; exports always write the joined rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.functions.brands import parse_brands
from trendlens.functions.text import matches
from trendlens.operators import aggregate as agg
from trendlens.operators import filters as flt
from trendlens.operators import topn
from trendlens.operators.brands import has_brand, keyword_kpis
from trendlens.operators.joins import (
    DEFAULT_BROADCAST_MAX_BYTES,
    DEFAULT_SALTS,
    MAX_BROADCAST_KEYS,
    attach_topics,
    attach_topics_salted,
    attach_topics_to_pairs,
    salted_join,
    spread,
    topic_map,
    write_and_measure,
)
from trendlens.sources.readers import parse_dates

# List sizes of the brand reports, the keyword table's columns
# and the two search types.
TOP_TOPICS = 15
TOP_BRANDS = 15
TOP_KEYWORDS = 50
KEYWORD_COLUMNS = ("keyword", "topic", "volume", "brands")
SEARCH_TYPES = ("Brand", "Topic")
L1, L2 = "level1", "level2"


def map_from_facts(facts: DataFrame) -> DataFrame:
    """Category map from a topic file with ``topic, category, sub_category`` (M8)."""
    return topic_map(facts, "topic", "category", "sub_category")


def with_lists(keywords: DataFrame, exact: bool | str = True) -> DataFrame:
    """Parsed ``brands_list`` and coerced ``date`` on the keyword rows."""
    if "brands_list" not in keywords.columns:
        keywords = keywords.withColumn("brands_list", parse_brands("brands", exact=exact))
    return parse_dates(keywords, "date")


def prepare_keywords(
    keywords: DataFrame,
    tmap: DataFrame | None,
    exact: bool | str = True,
    broadcast: str | None = "auto",
    max_broadcast_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """The joined keyword rows (M8: D1, B5/B6, R1, A7): keyword columns, then
    ``topic``, ``category``, ``sub_category``, ``brands_list``.

    Lists are parsed before the join, once per keyword rather than once per
    copy.  ``broadcast='auto'`` writes the map once and broadcasts it when it
    is estimated at ``max_broadcast_bytes`` or less, to keywords spread over all
    tasks; a larger map is joined with the heavy pairs split into ``salts``
    buckets, so no hot pair lands in one task.
    ``None`` leaves the choice to Spark's size statistics and AQE.
    """
    if broadcast not in ("auto", None):
        raise ValueError("broadcast must be 'auto' or None")
    kw = with_lists(keywords, exact)
    if tmap is not None and broadcast == "auto":
        written, size = write_and_measure(tmap)
        if size > max_broadcast_bytes:
            mapped = attach_topics_salted(kw, written, salts, L1, L2)
            rest = [c for c in mapped.columns if c != "brands_list"]
            return mapped.select(*rest, "brands_list")
        kw, tmap = with_lists(spread(keywords), exact), F.broadcast(written)
    mapped = attach_topics(kw, tmap, L1, L2)
    rest = [c for c in mapped.columns if c != "brands_list"]
    return mapped.select(*rest, "brands_list")


def keyword_filters(kw: DataFrame, date_range=None, country=None) -> DataFrame:
    """Day range and country filters (M9: C4, C6); they touch keyword columns
    only, so they run before any join.  A filter on a column that the table
    lacks is an error."""
    out = flt.by_dates(kw, "date" if "date" in kw.columns else None, date_range)
    return flt.by_value(out, "country" if "country" in kw.columns else None, country)


def brand_rows(kw: DataFrame, brand: str | None, mode: str = "contains", exact: bool = False) -> DataFrame:
    """Rows whose raw brand text contains ``brand`` (C8, S17); ``exact=True``
    tests list membership instead."""
    if not brand:
        return kw
    if exact:
        return has_brand(kw, brand)
    return flt.search(kw, "brands", brand, mode)


def topic_rows(kw: DataFrame, topic: str | None, mode: str = "contains") -> DataFrame:
    """Joined rows whose topic label contains ``topic``."""
    return flt.search(kw, "topic", topic, mode)


# --- pair-level building blocks ----------------------------------------------


def pair_brand_summary(keywords: DataFrame) -> DataFrame:
    """One pass over the keyword rows, grouped by (level1, level2, brand).

    ``posexplode_outer`` yields at least one row per keyword; the row-level
    measures (``n``, ``keyword_count``, ``row_volume``) are taken from each
    keyword's first row only (list position 0, or no brand at all), the brand
    measure ``brand_volume`` from every listed brand (duplicates count twice).
    Summing the row-level measures over brands gives the per-pair totals.
    The result has one row per (pair, brand): small, and every brand-tab
    aggregate below is derived from it.
    """
    agg.check_numeric(keywords, "volume")
    ex = keywords.select(
        L1, L2, "keyword", "volume", F.posexplode_outer("brands_list").alias("_pos", "brand")
    )
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    return ex.groupBy(L1, L2, "brand").agg(
        F.count_if(first).alias("n"),
        F.count_if(first & F.col("keyword").isNotNull()).alias("keyword_count"),
        F.sum(F.when(first, F.col("volume"))).alias("row_volume"),
        F.sum(F.when(F.col("brand").isNotNull(), F.col("volume"))).alias("brand_volume"),
    )


def pair_totals(summary: DataFrame) -> DataFrame:
    """Per pair: keyword rows, non-null keywords, volume."""
    return summary.groupBy(L1, L2).agg(
        F.sum("n").alias("n"), F.sum("keyword_count").alias("keyword_count"), F.sum("row_volume").alias("volume")
    )


def pair_topics(keywords: DataFrame, tmap: DataFrame | None) -> DataFrame:
    """(level1, level2, topic, category, sub_category): the topic rows each
    keyword pair receives (map columns null where the map has no such pair).
    A pair that holds much of the map is split over tasks."""
    pairs = keywords.select(L1, L2).distinct()
    return attach_topics(pairs, None, L1, L2) if tmap is None else attach_topics_to_pairs(pairs, tmap, level1=L1, level2=L2)


def _on_pair(left: str, right: str) -> Column:
    return F.col(f"{left}.{L1}").eqNullSafe(F.col(f"{right}.{L1}")) & F.col(f"{left}.{L2}").eqNullSafe(
        F.col(f"{right}.{L2}")
    )


def pair_copies(topics: DataFrame) -> DataFrame:
    """Rows each keyword of a pair turns into: the pair's topic rows."""
    return topics.groupBy(L1, L2).agg(F.count(F.lit(1)).alias("copies"))


def _weighted(per_pair: DataFrame, copies: DataFrame, cols: list[str]) -> DataFrame:
    """Join per-pair aggregates to their copy counts (pairs without copies drop)."""
    j = per_pair.alias("p").join(copies.alias("c"), _on_pair("p", "c"), "inner")
    return j.select(*[F.col(f"p.{c}").alias(c) for c in cols], F.col("c.copies").alias("copies"))


def summary_topic_volume(totals: DataFrame, topics: DataFrame) -> DataFrame:
    """E4 from per-pair totals: volume and keyword count per topic label."""
    j = totals.alias("p").join(topics.alias("t"), _on_pair("p", "t"), "inner")
    return (
        j.filter(F.col("t.topic").isNotNull())
        .groupBy(F.col("t.topic").alias("topic"))
        .agg(agg.total("p.volume", "volume"), agg.total("p.keyword_count", "keyword_count"))
    )


def _weight(dedupe: bool) -> Column:
    """Copies a keyword row counts for: all of them (as the joined rows do), or
    one when ``dedupe`` (each keyword once, if any of its topic rows is kept)."""
    return F.lit(1) if dedupe else F.col("copies")


def summary_brand_volume(summary: DataFrame, copies: DataFrame, dedupe: bool = False) -> DataFrame:
    """E5 from per-(pair, brand) sums weighted by the pair's copies."""
    w = _weighted(summary.filter(F.col("brand").isNotNull()), copies, ["brand", "brand_volume"])
    return w.groupBy("brand").agg(agg.total(F.col("brand_volume") * _weight(dedupe), "volume"))


def summary_kpis(
    summary: DataFrame, totals: DataFrame, topics: DataFrame, copies: DataFrame, dedupe: bool = False
) -> DataFrame:
    """E8 without the copies: total_keywords, unique_topics, total_volume,
    unique_brands.  Three one-row aggregates are stacked and folded with
    ``max`` (no cross join).  ``dedupe=True`` counts each keyword once in
    total_keywords and total_volume."""
    w = _weighted(totals, copies, ["n", "volume"])
    sums = w.agg(
        agg.total(F.col("n") * _weight(dedupe), "total_keywords"),
        agg.total(F.col("volume") * _weight(dedupe), "total_volume"),
    )
    n_topics = topics.agg(F.count_distinct("topic").alias("unique_topics"))
    listed = summary.filter(F.col("brand").isNotNull())
    kept = listed.alias("b").join(copies.alias("c"), _on_pair("b", "c"), "left_semi")
    n_brands = kept.agg(F.count_distinct("brand").alias("unique_brands"))
    stacked = sums.unionByName(n_topics, allowMissingColumns=True).unionByName(n_brands, allowMissingColumns=True)
    return stacked.agg(
        F.max("total_keywords").alias("total_keywords"),
        F.max("unique_topics").alias("unique_topics"),
        F.max("total_volume").alias("total_volume"),
        F.max("unique_brands").alias("unique_brands"),
    )


def rows_from_topics(
    keywords: DataFrame,
    topics: DataFrame,
    size: int,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """The joined keyword rows from the (pair, topic) rows: keyword columns,
    then ``topic``, ``category``, ``sub_category``.  Only the topic rows given
    are joined (a filtered label set never builds the other copies); topic rows
    of ``size`` bytes are broadcast under the bound, to keywords spread over all
    tasks, else every pair is split into salted buckets."""
    kw = keywords.drop("topic") if "topic" in keywords.columns else keywords
    # without a map the topic rows carry labels only, as attach_topics(kw, None) does
    extra = [c for c in ("topic", "category", "sub_category") if c in topics.columns]
    if size <= max_broadcast_bytes:
        j = spread(kw).alias("l").join(F.broadcast(topics).alias("r"), _on_pair("l", "r"), "inner")
    else:
        j = salted_join(kw, topics, [(L1, L1), (L2, L2)], "inner", salts)
    return j.select(*[F.col(f"l.{c}").alias(c) for c in kw.columns], *[F.col(f"r.{c}").alias(c) for c in extra])


@dataclass
class PairFrames:
    """The small frames a brand report is computed from."""

    summary: DataFrame
    topics: DataFrame

    @property
    def totals(self) -> DataFrame:
        return pair_totals(self.summary)

    @property
    def copies(self) -> DataFrame:
        return pair_copies(self.topics)

    def topic_volume(self) -> DataFrame:
        return summary_topic_volume(self.totals, self.topics)

    def brand_volume(self, dedupe: bool = False) -> DataFrame:
        return summary_brand_volume(self.summary, self.copies, dedupe)

    def kpis(self, dedupe: bool = False) -> DataFrame:
        return summary_kpis(self.summary, self.totals, self.topics, self.copies, dedupe)


MATERIALIZE = (True, False, "auto")


class PairSource:
    """Where a report's outputs get their small frames from.

    ``materialize=True`` writes the per-(pair, brand) summary and the (pair,
    topic) labels once under ``spark.checkpoint.dir`` when an output first needs
    them; ``False`` never writes; ``"auto"`` writes when a second output is
    asked for, since a single one is cheaper straight from the keywords.
    """

    def __init__(self, keywords: DataFrame, tmap: DataFrame | None, label_term: str | None = None, mode: str = "contains", materialize="auto"):
        if materialize not in MATERIALIZE:
            raise ValueError(f"materialize must be one of {MATERIALIZE}")
        agg.check_numeric(keywords, "volume")
        self.keywords, self.tmap, self.label_term, self.mode, self.materialize = keywords, tmap, label_term, mode, materialize
        self._asked = 0

    def _labels(self, pairs_of: DataFrame) -> DataFrame:
        return _label_filter(pair_topics(pairs_of, self.tmap), self.label_term, self.mode)

    @cached_property
    def _written(self) -> PairFrames:
        from trendlens.sources.writers import materialize as write_once

        summary = write_once(pair_brand_summary(self.keywords), "pair_brand_summary")
        return PairFrames(summary, write_once(self._labels(summary), "pair_topics"))

    def frames(self) -> PairFrames:
        self._asked += 1
        if self.materialize is True or (self.materialize == "auto" and self._asked > 1):
            return self._written
        return PairFrames(pair_brand_summary(self.keywords), self.topics())

    def topics(self) -> DataFrame:
        """The (pair, topic) rows alone, which need no summary."""
        if "_written" in self.__dict__:
            return self._written.topics
        return self._labels(self.keywords)

    def rows(self) -> DataFrame:
        """Joined keyword rows (for export), from the written topic rows unless
        nothing may be written."""
        if self.materialize is False:
            return topic_rows(attach_topics(self.keywords, self.tmap, L1, L2), self.label_term, self.mode)
        topics, size = write_and_measure(self.topics())
        return rows_from_topics(self.keywords, topics, size)


def eager_topic_volume(keywords: DataFrame, topics: DataFrame) -> DataFrame:
    """E4 from per-pair sums of the keyword rows and their topic labels."""
    return summary_topic_volume(pair_totals(pair_brand_summary(keywords)), topics)


def first_labels(topics: DataFrame, n: int) -> DataFrame:
    """The ``n`` first topic rows of each pair, which are all that a top-``n`` of
    keyword rows can show.  Spark keeps ``n`` per pair and task before the
    shuffle (a limit below the window), so a pair of very many topics sends
    few rows to one task."""
    order = W.partitionBy(L1, L2).orderBy(F.col("topic").asc_nulls_last())
    return topics.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_place")


def eager_top_keywords(
    keywords: DataFrame,
    topics: DataFrame,
    n: int = TOP_KEYWORDS,
    semi: bool = False,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
) -> DataFrame:
    """G4 + F1: the ``n`` best joined rows, built from candidate keywords only.

    ``semi=True`` first keeps keywords whose pair has any topic row (needed
    when ``topics`` was filtered); the pair list is written once and broadcast
    under a bound of bytes, else joined with every pair split into salted
    buckets.
    """
    cands = keywords
    if semi:
        pairs, size = write_and_measure(topics.select(L1, L2).distinct())
        if size <= max_broadcast_bytes:
            cands = keywords.alias("k").join(F.broadcast(pairs).alias("q"), _on_pair("k", "q"), "left_semi")
        else:
            hit = salted_join(keywords, pairs, [(L1, L1), (L2, L2)], "left_semi", DEFAULT_SALTS)
            cands = hit.select(*[F.col(f"l.{c}").alias(c) for c in keywords.columns])
    keys = topn.top_n(cands.select("volume", "keyword"), n, "volume", "keyword").alias("t")
    on_key = F.col("c.volume").eqNullSafe(F.col("t.volume")) & F.col("c.keyword").eqNullSafe(F.col("t.keyword"))
    picked = cands.alias("c").join(F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys, on_key, "left_semi")
    rows = picked.alias("k").join(first_labels(topics, n).alias("p"), _on_pair("k", "p"), "inner")
    table = rows.select(
        F.col("k.keyword").alias("keyword"),
        F.col("p.topic").alias("topic"),
        F.col("k.volume").alias("volume"),
        F.col("k.brands").alias("brands"),
    )
    return topn.ranked_top(table, n, "volume", "keyword", "topic", "brands")


# --- reports -------------------------------------------------------------------


class BrandReport:
    """The frames of a brand view, each built when it is first asked for; a
    frame that the view does not have is ``None``."""

    def __init__(self, **builders: Callable[[], DataFrame]):
        self._builders = builders

    def _frame(self, name: str) -> DataFrame | None:
        build = self._builders.get(name)
        return None if build is None else build()

    @cached_property
    def rows(self) -> DataFrame:
        return self._frame("rows")

    @cached_property
    def kpis(self) -> DataFrame:
        return self._frame("kpis")

    @cached_property
    def topics(self) -> DataFrame | None:
        return self._frame("topics")

    @cached_property
    def brands(self) -> DataFrame | None:
        return self._frame("brands")

    @cached_property
    def keywords(self) -> DataFrame | None:
        return self._frame("keywords")


def _label_filter(topics: DataFrame, term: str | None, mode: str) -> DataFrame:
    return topics if not term else topics.filter(matches("topic", term, mode))


def _top_topics(src: PairSource) -> DataFrame:
    return topn.top_n(src.frames().topic_volume(), TOP_TOPICS, "volume", "topic")


def _top_brands(src: PairSource, dedupe: bool) -> DataFrame:
    return topn.top_n(src.frames().brand_volume(dedupe), TOP_BRANDS, "volume", "brand")


def brand_search(
    keywords: DataFrame,
    tmap: DataFrame | None,
    brand: str,
    mode: str = "contains",
    exact: bool = False,
    lists_exact: bool | str = True,
    materialize="auto",
    dedupe: bool = False,
) -> BrandReport:
    """Search by brand (M10): KPIs, top-15 topics, top-50 keyword rows.
    ``dedupe=True``: KPIs count each keyword once, not once per topic."""
    kw = brand_rows(with_lists(keywords, lists_exact), brand, mode, exact)
    src = PairSource(kw, tmap, None, mode, materialize)
    return BrandReport(
        rows=src.rows,
        kpis=lambda: src.frames().kpis(dedupe),
        topics=lambda: _top_topics(src),
        keywords=lambda: eager_top_keywords(kw, src.topics()),
    )


def topic_search(
    keywords: DataFrame,
    tmap: DataFrame | None,
    topic: str,
    mode: str = "contains",
    lists_exact: bool | str = True,
    materialize="auto",
    dedupe: bool = False,
) -> BrandReport:
    """Search by topic label (M11): KPIs, top-15 brands, top-50 keyword rows.
    ``dedupe=True``: KPIs and brand volumes count each matching keyword once."""
    kw = with_lists(keywords, lists_exact)
    src = PairSource(kw, tmap, topic, mode, materialize)
    return BrandReport(
        rows=src.rows,
        kpis=lambda: src.frames().kpis(dedupe),
        brands=lambda: _top_brands(src, dedupe),
        keywords=lambda: eager_top_keywords(kw, src.topics(), semi=True),
    )


def overview(
    keywords: DataFrame,
    tmap: DataFrame | None,
    lists_exact: bool | str = True,
    materialize="auto",
    dedupe: bool = False,
) -> BrandReport:
    """No search value (M12): KPIs, top-15 topics, top-15 brands.
    ``dedupe=True``: KPIs and brand volumes count each keyword once."""
    kw = with_lists(keywords, lists_exact)
    src = PairSource(kw, tmap, None, "contains", materialize)
    return BrandReport(
        rows=src.rows,
        kpis=lambda: src.frames().kpis(dedupe),
        topics=lambda: _top_topics(src),
        brands=lambda: _top_brands(src, dedupe),
    )


def brand_report(
    keywords: DataFrame,
    tmap: DataFrame | None,
    search_type: str = "Brand",
    search_value: str | None = None,
    date_range=None,
    country=None,
    mode: str = "contains",
    materialize="auto",
    dedupe: bool = False,
) -> BrandReport:
    """The brand tab (M9-M12): keyword filters, then the view for the search.

    Outputs are built when asked for.  From the second one that needs it, the
    per-(pair, brand) summary is written once, so the KPIs, topic and brand
    tables come from one pass over the keywords; the keyword table makes one
    more (bounded top-k) pass.
    """
    if search_type not in SEARCH_TYPES:
        raise ValueError(f"search_type must be one of {SEARCH_TYPES}")
    kw = keyword_filters(with_lists(keywords), date_range, country)
    if not search_value:
        return overview(kw, tmap, materialize=materialize, dedupe=dedupe)
    if search_type == "Brand":
        return brand_search(kw, tmap, search_value, mode, materialize=materialize, dedupe=dedupe)
    return topic_search(kw, tmap, search_value, mode, materialize=materialize, dedupe=dedupe)


def joined_row_counts(keywords: DataFrame, tmap: DataFrame | None, predicate: Column | None) -> DataFrame:
    """Joined rows before and after a filter on keyword columns (E11), without
    joining the rows: keywords per pair, times the pair's topic rows."""
    after = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    per_pair = keywords.groupBy(L1, L2).agg(F.count(F.lit(1)).alias("n"), F.count_if(after).alias("n_after"))
    weighted = _weighted(per_pair, pair_copies(pair_topics(keywords, tmap)), ["n", "n_after"])
    return weighted.agg(
        agg.total(F.col("n") * F.col("copies"), "rows_before"), agg.total(F.col("n_after") * F.col("copies"), "rows_after")
    )


# --- the same reports over the joined rows ------------------------------------


def top_topics_by_volume(rows: DataFrame, n: int = TOP_TOPICS) -> DataFrame:
    """Volume and keyword count per topic, best ``n``."""
    return topn.top_n(agg.topic_volume(rows), n, "volume", "topic")


def top_brands_by_volume(rows: DataFrame, n: int = TOP_BRANDS) -> DataFrame:
    """Volume per brand, best ``n``."""
    return topn.top_n(agg.brand_volume(rows), n, "volume", "brand")


def top_keywords(rows: DataFrame, n: int = TOP_KEYWORDS) -> DataFrame:
    """The ``n`` largest joined rows with a rank."""
    return topn.ranked_top(rows.select(*KEYWORD_COLUMNS), n, "volume", "keyword", "topic", "brands")


def brand_search_mapped(mapped: DataFrame, brand: str, mode: str = "contains", exact: bool = False) -> BrandReport:
    rows = brand_rows(mapped, brand, mode, exact)
    return BrandReport(
        rows=lambda: rows, kpis=lambda: keyword_kpis(rows), topics=lambda: top_topics_by_volume(rows), keywords=lambda: top_keywords(rows)
    )


def topic_search_mapped(mapped: DataFrame, topic: str, mode: str = "contains") -> BrandReport:
    rows = topic_rows(mapped, topic, mode)
    return BrandReport(
        rows=lambda: rows, kpis=lambda: keyword_kpis(rows), brands=lambda: top_brands_by_volume(rows), keywords=lambda: top_keywords(rows)
    )


def overview_mapped(mapped: DataFrame) -> BrandReport:
    return BrandReport(
        rows=lambda: mapped,
        kpis=lambda: keyword_kpis(mapped),
        topics=lambda: top_topics_by_volume(mapped),
        brands=lambda: top_brands_by_volume(mapped),
    )
