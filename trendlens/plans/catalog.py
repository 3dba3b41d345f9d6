"""The registered queries: each report of the library run over the fixture
tables derived from a test-data folder.  Every callable takes
``(spark, sf_dir)`` and returns a DataFrame; sink queries write below the
session's shared folder and return the re-read output.

Column names here equal those of the SQL oracle in ``__spark_entry__.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendlens.functions.nulls import PANDAS_NA_TOKENS, parse_timestamp
from trendlens.functions.text import day_text, matches, thousands
from trendlens.operators import aggregate as agg
from trendlens.operators import filters as flt
from trendlens.operators import topn
from trendlens.operators.brands import distinct_brands, explode_brands, keyword_kpis, with_brands_list
from trendlens.operators.bucketed import attach_topics_bucketed, write_bucketed
from trendlens.operators.joins import attach_topics
from trendlens.operators.sampling import sample_per_category
from trendlens.operators.search import build_text_index
from trendlens.plans import brand, trending
from trendlens.plans.export import export_categories, export_filtered
from trendlens.plans.roles import detect_roles, override_roles
from trendlens.session import scratch_path
from trendlens.streaming import read_rollup, start_rollup_stream, vacuum
from trendlens.sources import files
from trendlens.sources import fixtures as fx
from trendlens.sources.cache import kept
from trendlens.sources.layout import write_clustered
from trendlens.sources.quarantine import load_csv
from trendlens.sources.readers import normalise_nulls, read_csv, read_parquet, read_table, union
from trendlens.sources.remote import FileFetcher, read_remote_csv, read_remote_parquet
from trendlens.sources.schemas import EXPORTED_FACTS, KEYWORD_SCHEMA, MAP_SCHEMA, TOPIC_FACTS
from trendlens.sources.writers import hash_sample, rollup, tee, write_csv, write_parquet, write_partitioned

# Fixed parameters of the registered queries (values present in every test scale).
LEVEL1 = "STANDARD"
LEVEL2 = "Brand#13"
DATE_RANGE = ("1996-01-01", "1998-12-31")
SINGLE_DAY = "1996-03-15"
LEVEL2_TERM = "#1"
BRAND_TERM = "Brand#1"
TOPIC_TERM = "red"
TOPIC_PATTERN = "^(red|blue) "
KEYWORD_DATES = ("1995-01-10", "1995-02-10")
COUNTRY = "US"
EXPORT_CATEGORIES = ("STANDARD", "PROMO")

KEYWORD_ROW_COLUMNS = ("keyword", "volume", "brands", "level1", "level2", "country", "date", "topic", "category", "sub_category")
FACT_COLUMNS = ("device", "country", "topic", "level1", "level2", "raw_messages", "raw_users", "raw_conversations", "date")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return fx.topic_facts(spark, d)


def _map(spark: SparkSession, d: str) -> DataFrame:
    return brand.map_from_facts(fx.map_source(spark, d))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return brand.prepare_keywords(fx.keywords(spark, d), _map(spark, d))


# --- topic trends (M1-M7) -------------------------------------------------


def top_topics_filtered(spark, d):
    return trending.top_topics(_facts(spark, d), 10, level1=LEVEL1, date_range=DATE_RANGE)


def top_topics_all(spark, d):
    return trending.top_topics(_facts(spark, d), 10)


def top_topics_chart(spark, d):
    return trending.top_topics(_facts(spark, d), 10, exclude_totals=True, rank=False)


def top_topics_level2(spark, d):
    return trending.top_topics(_facts(spark, d), 10, level2=LEVEL2)


def top_topics_both(spark, d):
    return trending.top_topics(_facts(spark, d), 10, level1=LEVEL1, level2=LEVEL2)


def topic_totals_dynamic(spark, d):
    renamed = _facts(spark, d).select(
        F.col("level1").alias("category"),
        F.col("level2").alias("sub_category"),
        F.col("topic").alias("Topic"),
        F.col("raw_conversations").alias("Conversations"),
        F.col("raw_messages").alias("msg_count"),
        "date",
    )
    sums, _ = trending.aggregated(renamed, detect_roles(renamed.columns))
    return sums


def topic_counts(spark, d):
    return agg.counts_by(_facts(spark, d), "topic", "count")


def daily_trend_top10(spark, d):
    return trending.daily_trend(_facts(spark, d), 10)


def single_day_topics(spark, d):
    return trending.single_day(_facts(spark, d), SINGLE_DAY)


def trending_kpis(spark, d):
    facts = _facts(spark, d)
    return trending.kpis(flt.by_value(facts, "level1", LEVEL1))


def dataset_info(spark, d):
    return agg.dataset_info(_facts(spark, d))


def date_bounds(spark, d):
    return agg.date_bounds(_facts(spark, d))


def filter_counts(spark, d):
    pred = flt.all_of(flt.value_predicate("level1", LEVEL1), flt.dates_predicate("date", DATE_RANGE))
    return agg.filter_counts(_facts(spark, d), pred)


def level1_values(spark, d):
    return agg.distinct_values(_facts(spark, d), "level1")


def level2_values_in_level1(spark, d):
    return trending.level2_within(_facts(spark, d), LEVEL1)


def level2_search(spark, d):
    return trending.level_search(_facts(spark, d), "level2", LEVEL2_TERM)


def level2_page1(spark, d):
    return topn.page(agg.distinct_values(_facts(spark, d), "level2"), ["level2"], 10, 1)


def level2_page2(spark, d):
    return topn.after_first(agg.distinct_values(_facts(spark, d), "level2"), "level2", 10)


def topic_values_page2(spark, d):
    return topn.after_first(agg.distinct_values(_facts(spark, d), "topic"), "topic", 50)


def topic_group_count(spark, d):
    return agg.group_count(agg.topic_totals(_facts(spark, d)))


def _report(spark, d):
    return trending.trending_report(_facts(spark, d), level1=LEVEL1, date_range=DATE_RANGE)


def report_kpis(spark, d):
    return _report(spark, d).kpis


def report_table_top(spark, d):
    return _report(spark, d).table_top


def report_chart_top(spark, d):
    return _report(spark, d).chart_top


def report_trend(spark, d):
    return _report(spark, d).trend


def labelled_top(spark, d):
    top = trending.top_topics(_facts(spark, d), 10)
    return top.withColumn("conversations_label", thousands("raw_conversations"))


def labelled_trend(spark, d):
    trend = trending.daily_trend(_facts(spark, d), 10)
    return trend.withColumn("day_text", day_text("date_only"))


# --- brand volume (M8-M12) ------------------------------------------------


def topic_map(spark, d):
    return _map(spark, d)


def keywords_mapped(spark, d):
    return _prepared(spark, d).select(*KEYWORD_ROW_COLUMNS)


def keywords_fallback(spark, d):
    return attach_topics(fx.keywords(spark, d), None)


def brands_exploded(spark, d):
    return explode_brands(with_brands_list(fx.keywords(spark, d)), keep=("keyword", "volume"))


def brand_values(spark, d):
    return distinct_brands(with_brands_list(fx.keywords(spark, d)))


def _kw(spark, d):
    return fx.keywords(spark, d)


def brand_search_topics(spark, d):
    return brand.brand_search(_kw(spark, d), _map(spark, d), BRAND_TERM).topics


def brand_search_keywords(spark, d):
    return brand.brand_search(_kw(spark, d), _map(spark, d), BRAND_TERM).keywords


def brand_search_kpis(spark, d):
    return brand.brand_search(_kw(spark, d), _map(spark, d), BRAND_TERM).kpis


def brand_search_kpis_mapped(spark, d):
    return brand.brand_search_mapped(_prepared(spark, d), BRAND_TERM).kpis


def brand_exact_rows(spark, d):
    return brand.brand_rows(_prepared(spark, d), BRAND_TERM, exact=True).select(*KEYWORD_ROW_COLUMNS)


def topic_search_brands(spark, d):
    return brand.topic_search(_kw(spark, d), _map(spark, d), TOPIC_TERM).brands


def topic_search_keywords(spark, d):
    return brand.topic_search(_kw(spark, d), _map(spark, d), TOPIC_TERM).keywords


def topic_search_keywords_mapped(spark, d):
    return brand.topic_search_mapped(_prepared(spark, d), TOPIC_TERM).keywords


def topic_search_kpis(spark, d):
    return brand.topic_search(_kw(spark, d), _map(spark, d), TOPIC_TERM).kpis


def topic_search_regex(spark, d):
    kw = brand.with_lists(_kw(spark, d))
    topics = brand.pair_topics(kw, _map(spark, d))
    return brand.eager_topic_volume(kw, topics.filter(matches("topic", TOPIC_PATTERN, "regex")))


def overview_topics(spark, d):
    return brand.overview_mapped(_prepared(spark, d)).topics


def overview_topics_eager(spark, d):
    return brand.overview(_kw(spark, d), _map(spark, d)).topics


def overview_brands(spark, d):
    return brand.overview(_kw(spark, d), _map(spark, d)).brands


def overview_brands_plain(spark, d):
    return brand.overview_mapped(_prepared(spark, d)).brands


def overview_kpis(spark, d):
    return brand.overview(_kw(spark, d), _map(spark, d)).kpis


def overview_kpis_dedupe(spark, d):
    return brand.overview(_kw(spark, d), _map(spark, d), dedupe=True).kpis


def topic_search_brands_dedupe(spark, d):
    return brand.topic_search(_kw(spark, d), _map(spark, d), TOPIC_TERM, dedupe=True).brands


def overview_kpis_mapped(spark, d):
    return keyword_kpis(_prepared(spark, d))


def keywords_filtered(spark, d):
    return brand.keyword_filters(_prepared(spark, d), KEYWORD_DATES, COUNTRY).select(*KEYWORD_ROW_COLUMNS)


def keyword_filter_counts(spark, d):
    pred = flt.all_of(flt.dates_predicate("date", KEYWORD_DATES), flt.value_predicate("country", COUNTRY))
    return brand.joined_row_counts(_kw(spark, d), _map(spark, d), pred)


def topic_label_values(spark, d):
    return agg.distinct_values(brand.pair_topics(_kw(spark, d), _map(spark, d)), "topic")


def country_values(spark, d):
    return agg.distinct_values(_kw(spark, d), "country")


def keyword_date_bounds(spark, d):
    return agg.date_bounds(_kw(spark, d))


def skewed_map_topics(spark, d):
    """Topic volumes where one pair holds a third of the map and of the keywords."""
    hot = fx.hot_pair(_kw(spark, d))
    return brand.overview(hot, fx.hot_map(spark, d)).topics


def odd_brands_exploded(spark, d):
    return explode_brands(with_brands_list(fx.odd_brand_lists(spark, d)), keep=("keyword", "volume"))


def odd_brands_jvm(spark, d):
    """The same rows without a Python node."""
    return explode_brands(with_brands_list(fx.odd_brand_lists(spark, d), exact="jvm"), keep=("keyword", "volume"))


def top_topics_by_users(spark, d):
    facts = _facts(spark, d)
    roles = override_roles(detect_roles(facts.columns), facts.columns, metric="raw_users")
    return trending.top_topics(facts, 10, roles=roles)


# --- sources and sinks (A1-A22) -------------------------------------------

def _category_dataset(spark, d) -> str:
    """The export jobs' input: a Parquet dataset folder with ``category``."""
    path = scratch_path(spark, "trend_aggregation")
    facts = _facts(spark, d).withColumnRenamed("level1", "category").withColumnRenamed("level2", "sub_category")
    write_parquet(facts, path)
    return path


def export_categories_csv(spark, d):
    src = _category_dataset(spark, d)
    out = scratch_path(spark, "export_csv")
    export_categories(spark, src, EXPORT_CATEGORIES, out, fmt="csv")
    return read_csv(spark, out, schema=EXPORTED_FACTS)


def export_categories_parquet(spark, d):
    src = _category_dataset(spark, d)
    first, second = scratch_path(spark, "export_pq"), scratch_path(spark, "export_pq_named")
    export_categories(spark, src, EXPORT_CATEGORIES, first, fmt="parquet", second_out=second)
    return read_parquet(spark, second)


def export_filtered_csv(spark, d):
    report = trending.trending_report(_facts(spark, d), level1=LEVEL1)
    out = scratch_path(spark, "filtered_topics")
    write_csv(report.rows, out)
    return read_csv(spark, out, schema=report.rows.schema)


def download_filtered_csv(spark, d):
    """Rows of a category and a period, exported under the name that the filters
    give (A15, A16), with that name."""
    folder = scratch_path(spark, "downloads")
    path, _ = export_filtered(_facts(spark, d).select(*FACT_COLUMNS), folder, LEVEL1, LEVEL2, DATE_RANGE)
    return read_csv(spark, path, schema=TOPIC_FACTS).withColumn("file_name", F.lit(path.removeprefix(f"{folder}/")))


def chart_bars(spark, d):
    """The chart's top 10 in the order of its bars, with each bar's place from
    the bottom (G6)."""
    bars = topn.for_display(trending.top_topics(_facts(spark, d), 10, exclude_totals=True, rank=False), "raw_conversations", "topic")
    placed = bars.withColumn("_at", F.monotonically_increasing_id())
    return placed.select(F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("bar"), *bars.columns)  # ten rows


def export_brand_rows_csv(spark, d):
    """The brand tab's rows (M10) as CSV, lists as text."""
    rows = brand.brand_search(_kw(spark, d), _map(spark, d), BRAND_TERM).rows
    out = scratch_path(spark, "brand_rows")
    columns = [*KEYWORD_ROW_COLUMNS, "brands_list"]
    write_csv(rows.select(*columns), out)
    return read_csv(spark, out, schema=f"{KEYWORD_SCHEMA}, {MAP_SCHEMA}, brands_list string").select(*columns)


def export_awkward_text(spark, d):
    """Texts with blanks at the edges, quotes and line breaks, through CSV."""
    out = scratch_path(spark, "awkward")
    write_csv(fx.awkward_text(spark, d), out)
    return read_csv(spark, out, schema=fx.AWKWARD_SCHEMA, multiline=True)


def tee_csv(spark, d):
    first, second = scratch_path(spark, "tee_a"), scratch_path(spark, "tee_b")
    tee(fx.awkward_text(spark, d), first, second, fmt="csv")
    return read_table(spark, second, file_type="csv", schema=fx.AWKWARD_SCHEMA, multiline=True, date_column=None)


def typed_null_tokens(spark, d):
    """Null tokens in a number and a date column."""
    out = scratch_path(spark, "typed_tokens") + ".csv"
    write_csv(fx.typed_tokens(spark, d), out)
    return read_table(spark, out, schema="keyword string, volume bigint, date date", pandas_na=True)


def united_tables(spark, d):
    """One table from a Parquet folder and a CSV folder (H1)."""
    facts = _facts(spark, d)
    pq, csv = scratch_path(spark, "mobile") + ".parquet", scratch_path(spark, "desktop") + ".csv"
    write_parquet(facts.filter("device = 'mobile'"), pq)
    write_csv(facts.filter("device = 'desktop'"), csv)
    both = read_table(spark, [pq, csv], schema=TOPIC_FACTS)
    return union(both.filter("device = 'desktop'"), both.filter("device = 'mobile'")).select(*FACT_COLUMNS)


def rows_written(spark, d):
    """Observed row counts of two writes."""
    facts = _facts(spark, d)
    n = write_parquet(facts, scratch_path(spark, "counted"))
    m = write_csv(facts.filter(flt.value_predicate("level1", LEVEL1)), scratch_path(spark, "counted_csv"))
    return spark.createDataFrame([("parquet", n), ("csv", m)], "sink string, rows_written bigint")


def _with_tokens(spark, d) -> DataFrame:
    """Keywords whose country text holds null tokens, as a CSV export would."""
    kw = fx.keywords(spark, d).withColumn("_k", F.regexp_extract("keyword", r"(\d+)$", 1).cast("bigint"))
    token = (
        F.when(F.col("_k") % 31 == 0, F.lit("NA"))
        .when(F.col("_k") % 37 == 0, F.lit("null"))
        .when(F.col("_k") % 43 == 0, F.lit("n/a"))
        .otherwise(F.col("country"))
    )
    return kw.select("keyword", "volume", token.alias("country"))


def normalised_nulls(spark, d):
    out = scratch_path(spark, "tokens_csv")
    write_csv(_with_tokens(spark, d), out)
    schema = "keyword string, volume bigint, country string"
    return normalise_nulls(read_csv(spark, out, schema=schema), PANDAS_NA_TOKENS)


def parsed_dates(spark, d):
    facts = _facts(spark, d).select("topic", "raw_conversations", "date")
    text = F.when(F.col("date").isNull(), F.lit("not a date")).otherwise(F.col("date").cast("string"))
    with_text = facts.select("topic", "raw_conversations", text.alias("date_text"))
    parsed = parse_timestamp("date_text", on_bad="null")
    return with_text.select("topic", "raw_conversations", "date_text", parsed.alias("parsed"))


def partitioned_roundtrip(spark, d):
    facts = _facts(spark, d)
    out = scratch_path(spark, "by_level1")
    write_partitioned(facts, out, ["level1"])
    return spark.read.schema(facts.schema).parquet(out).select(*FACT_COLUMNS)


def daily_rollup(spark, d):
    out = scratch_path(spark, "daily_rollup")
    table = rollup(_facts(spark, d))
    write_parquet(table, out)
    return spark.read.parquet(out)


def streamed_rollup(spark, d):
    """A20 as a stream: the fact rows land as several files, written in parallel;
    micro-batches of two files each are pre-aggregated, the partial sums are
    added up."""
    facts = _facts(spark, d)
    src = scratch_path(spark, "landing")
    facts.repartition(F.col("topic"), F.col("date")).write.parquet(src)
    sink, ckpt = scratch_path(spark, "rollup_parts"), scratch_path(spark, "rollup_ckpt")
    q = start_rollup_stream(spark, src, facts.schema, sink, ckpt, files_per_batch=2)
    q.awaitTermination()
    return read_rollup(spark, sink, checkpoint=ckpt)


# Fixed value: micro-batches of the folded rollup.
FOLDED_BATCHES = 8


def compacted_rollup(spark, d):
    """A20 in small batches that are folded every third time, then vacuumed; the
    rest of the batches is read as it is.  A batch has a file for every core: of
    one file, one task writes it and few read it."""
    facts = _facts(spark, d)
    src = scratch_path(spark, "landing")
    per_batch = max(1, spark.sparkContext.defaultParallelism)
    facts.repartition(FOLDED_BATCHES * per_batch, F.col("topic"), F.col("date")).write.parquet(src)
    sink, ckpt = scratch_path(spark, "folded_parts"), scratch_path(spark, "folded_ckpt")
    start_rollup_stream(spark, src, facts.schema, sink, ckpt, files_per_batch=per_batch, compact_every=3).awaitTermination()
    vacuum(spark, sink, keep=1)
    return read_rollup(spark, sink)


def hash_sample_portable(spark, d):
    return hash_sample(_facts(spark, d), ["topic", "date"], buckets=4, keep=0, hash="md5")


def sample_per_level1(spark, d):
    """Exactly 20 rows of every category, or all it has."""
    return sample_per_category(_facts(spark, d), ["level1"], 20, keys=FACT_COLUMNS, hash="md5").select(*FACT_COLUMNS)


def topics_ranked(spark, d):
    """Every topic with its rank (F1), no top-N before it."""
    return topn.rank_all(agg.topic_totals(_facts(spark, d)), "raw_conversations", "topic")


def top_topics_per_level1(spark, d):
    """The top 10 (M1) of every category in one pass."""
    facts = _facts(spark, d).where("topic is not null")
    sums = facts.groupBy("level1", "topic").agg(*[agg.total(m, m) for m in agg.TOPIC_METRICS])
    return topn.top_n_by(sums, ["level1"], 10, "raw_conversations", "topic")


def topic_values_third_page(spark, d):
    """A page reached by continuation tokens."""
    values, token = agg.distinct_values(_facts(spark, d), "topic"), None
    for _ in range(2):
        token = [topn.page_after(values, ["topic"], 20, token).agg(F.max("topic")).first()[0]]
    return topn.page_after(values, ["topic"], 20, token)


def clustered_roundtrip(spark, d):
    """Facts laid out by date and category together (A19), read with a filter."""
    facts = _facts(spark, d)
    out = scratch_path(spark, "clustered")
    write_clustered(facts, out, ["date", "level1"], files=16)
    return flt.by_dates(spark.read.schema(facts.schema).parquet(out), "date", DATE_RANGE).select(*FACT_COLUMNS)


def brand_search_indexed(spark, d):
    """Keyword rows whose brand text holds the term (C8), through an index."""
    kw = _kw(spark, d)
    return build_text_index(kw, "brands", scratch_path(spark, "brand_index")).rows(kw, BRAND_TERM)


def topic_search_indexed(spark, d):
    """Topics that contain the term (C9), through an index."""
    values = agg.distinct_values(_facts(spark, d), "topic")
    return build_text_index(values, "topic", scratch_path(spark, "topic_index")).texts(TOPIC_TERM)


def keywords_bucketed(spark, d):
    """The keyword-to-topic join (D1) of tables that are dealt once."""
    out = scratch_path(spark, "bucketed")
    tables = tuple(f"{side}_{out.rsplit('-', 1)[1]}" for side in ("keywords", "map"))
    write_bucketed(_kw(spark, d), _map(spark, d), tables, out, buckets=8)
    return attach_topics_bucketed(spark, tables).select(*KEYWORD_ROW_COLUMNS)


def _loaded(spark, d):
    """Keywords from a CSV file in which some volumes and days are no such."""
    kw = fx.keywords(spark, d).withColumn("_k", F.regexp_extract("keyword", r"(\d+)$", 1).cast("bigint"))
    volume = F.when(F.col("_k") % 31 == 0, F.lit("many")).otherwise(F.col("volume").cast("string"))
    day = F.when(F.col("_k") % 37 == 0, F.lit("1995-13-45")).otherwise(F.col("date").cast("string"))
    out = scratch_path(spark, "spoilt_csv")
    write_csv(kw.select("keyword", volume.alias("volume"), day.alias("date")), out)
    return load_csv(spark, out, "keyword string, volume bigint, date date", scratch_path(spark, "loaded"), required=["keyword"])


def quarantine_good(spark, d):
    """The rows that fit."""
    return _loaded(spark, d).good


def quarantine_rejected(spark, d):
    """The rows that don't (A9), as they were read, with the reasons."""
    rejected = _loaded(spark, d).rejected
    return rejected.select("keyword", "volume", "date", F.array_join("reasons", "; ").alias("reasons"))


def _data_files(spark, folder: str) -> list[str]:
    return [f"{folder}/{name}" for name in files.names(spark, folder)]


def remote_csv_ranges(spark, d):
    """Topic rows of CSV files, read in 16 byte ranges or a few more (A4)."""
    out = scratch_path(spark, "ranged_csv")
    write_csv(_facts(spark, d).select(*FACT_COLUMNS), out)
    urls, ranges = _data_files(spark, out), FileFetcher()
    size = sum(ranges.stat(u)[0] for u in urls)
    return read_remote_csv(spark, urls, TOPIC_FACTS, ranges, split_bytes=-(-size // 16))


def remote_parquet_topics(spark, d):
    """Sums per topic from the row groups of Parquet files of which only the
    needed columns are fetched (A4)."""
    out = scratch_path(spark, "ranged_parquet")
    write_parquet(_facts(spark, d), out)
    columns = ["topic", "raw_messages", "raw_users", "raw_conversations"]
    return agg.topic_totals(read_remote_parquet(spark, _data_files(spark, out), columns, FileFetcher()))


def kept_topics(spark, d):
    """Sums per topic from a kept result (A11); the second call reads it."""
    root = scratch_path(spark, "results")
    kept(agg.topic_totals(_facts(spark, d)), root)
    return kept(agg.topic_totals(_facts(spark, d)), root)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        top_topics_filtered,
        top_topics_all,
        top_topics_chart,
        top_topics_level2,
        top_topics_both,
        topic_totals_dynamic,
        topic_counts,
        daily_trend_top10,
        single_day_topics,
        trending_kpis,
        dataset_info,
        date_bounds,
        filter_counts,
        level1_values,
        level2_values_in_level1,
        level2_search,
        level2_page1,
        level2_page2,
        topic_values_page2,
        topic_group_count,
        report_kpis,
        report_table_top,
        report_chart_top,
        report_trend,
        labelled_top,
        labelled_trend,
        topic_map,
        keywords_mapped,
        keywords_fallback,
        brands_exploded,
        brand_values,
        brand_search_topics,
        brand_search_keywords,
        brand_search_kpis,
        brand_search_kpis_mapped,
        brand_exact_rows,
        topic_search_brands,
        topic_search_keywords,
        topic_search_keywords_mapped,
        topic_search_kpis,
        topic_search_regex,
        overview_topics,
        overview_topics_eager,
        overview_brands,
        overview_brands_plain,
        overview_kpis,
        overview_kpis_mapped,
        overview_kpis_dedupe,
        topic_search_brands_dedupe,
        keywords_filtered,
        keyword_filter_counts,
        topic_label_values,
        country_values,
        keyword_date_bounds,
        skewed_map_topics,
        odd_brands_exploded,
        odd_brands_jvm,
        top_topics_by_users,
        export_brand_rows_csv,
        export_awkward_text,
        tee_csv,
        typed_null_tokens,
        united_tables,
        rows_written,
        export_categories_csv,
        export_categories_parquet,
        export_filtered_csv,
        download_filtered_csv,
        chart_bars,
        normalised_nulls,
        parsed_dates,
        partitioned_roundtrip,
        daily_rollup,
        streamed_rollup,
        compacted_rollup,
        hash_sample_portable,
        sample_per_level1,
        topics_ranked,
        top_topics_per_level1,
        topic_values_third_page,
        clustered_roundtrip,
        brand_search_indexed,
        topic_search_indexed,
        keywords_bucketed,
        quarantine_good,
        quarantine_rejected,
        remote_csv_ranges,
        remote_parquet_topics,
        kept_topics,
    )
}
