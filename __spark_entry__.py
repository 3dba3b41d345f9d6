"""

``entry(spark)`` runs the flagship query on sf0.001; ``queries()`` lists every
registered query (``trendlens.plans.catalog``); ``oracle_sql()`` gives, per
query, DuckDB SQL over the same parquet tables that must return the same rows.
The SQL builds the three logical tables with the fixture CTEs of FIXTURES.md;
the Spark side builds them with the DataFrame API in
``trendlens.sources.fixtures``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from trendlens.plans import catalog  # noqa: E402

try:  # the training-data operators and their pipeline; the rest works without them
    import corpus_pipeline
    from trendlens.llm import queries as llm
except ModuleNotFoundError as e:
    if not str(e.name).startswith(("corpus_pipeline", "trendlens.llm")):
        raise
    corpus_pipeline = llm = None
except ImportError as e:
    if e.name != "trendlens.llm":  # an emptied folder
        raise
    corpus_pipeline = llm = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Top 10 topics by conversations in one category and period."""
    return catalog.top_topics_filtered(spark, FLAGSHIP_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    extra = {} if llm is None else {**llm.QUERIES, "pipeline": corpus_pipeline.run}
    return {**catalog.QUERIES, **extra}


# --- oracle ------------------------------------------------------------------

FIXTURES = """
topic_facts AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device,
         CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE n_name END AS country,
         CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'all'
              WHEN p_partkey % 19 = 0 THEN 'Total' ELSE p_name END AS topic,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS level1,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS level2,
         CAST(l_linenumber AS BIGINT) AS raw_messages,
         CAST(l_linenumber + 1 AS BIGINT) AS raw_users,
         CAST(l_quantity AS BIGINT) AS raw_conversations,
         CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date
  FROM lineitem JOIN part ON l_partkey = p_partkey
                JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey),
topic_map AS (
  SELECT DISTINCT topic, level1 AS category, level2 AS sub_category FROM topic_facts
  WHERE (topic IS NULL OR topic <> 'all') AND (level1 IS NULL OR level1 <> 'PROMO')),
keywords AS (
  SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS keyword,
         CAST(p_size * 10 AS BIGINT) AS volume,
         CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '[]'
              WHEN p_partkey % 11 = 0 THEN 'not a list'
              ELSE concat('[''', p_brand, ''', ''Brand#', CAST(p_partkey % 25 + 1 AS VARCHAR(20)), ''']') END AS brands,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS level1,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS level2,
         CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'US' ELSE 'DE' END AS country,
         DATE '1995-01-01' + CAST(p_partkey % 60 AS INT) AS date
  FROM part),
mapped AS (
  SELECT k.keyword, k.volume, k.brands, k.level1, k.level2, k.country, k.date,
         CASE WHEN COALESCE(m.topic, k.level1 || ' > ' || COALESCE(k.level2, '')) = '' THEN 'Uncategorized'
              ELSE COALESCE(m.topic, k.level1 || ' > ' || COALESCE(k.level2, '')) END AS topic,
         m.category, m.sub_category,
         CASE WHEN k.brands LIKE '[%' THEN from_json(replace(k.brands, '''', '"'), '["VARCHAR"]')
              ELSE CAST([] AS VARCHAR[]) END AS brands_list
  FROM keywords k LEFT JOIN topic_map m
    ON k.level1 IS NOT DISTINCT FROM m.category AND k.level2 IS NOT DISTINCT FROM m.sub_category),
keyword_brands AS (
  SELECT keyword, volume,
         CASE WHEN brands LIKE '[%' THEN from_json(replace(brands, '''', '"'), '["VARCHAR"]')
              ELSE CAST([] AS VARCHAR[]) END AS brands_list
  FROM keywords)"""

LEVEL1 = catalog.LEVEL1
LEVEL2 = catalog.LEVEL2
D0, D1 = catalog.DATE_RANGE
K0, K1 = catalog.KEYWORD_DATES
TOTALS = "('all', 'total', 'overall')"
METRICS = ("raw_conversations", "raw_messages", "raw_users")
KW_ROWS = ", ".join(catalog.KEYWORD_ROW_COLUMNS)


def _with(*ctes: str, select: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {FIXTURES}{extra}\n{select}"


def _s(col: str, name: str | None = None) -> str:
    return f"CAST(COALESCE(SUM({col}), 0) AS BIGINT) AS {name or col}"


def _sums_cte(where: str = "TRUE", name: str = "sums") -> str:
    cols = ", ".join(_s(m) for m in METRICS)
    return f"{name} AS (SELECT topic, {cols} FROM topic_facts WHERE topic IS NOT NULL AND ({where}) GROUP BY topic)"


ORDER_CONV = "raw_conversations DESC NULLS LAST, topic ASC NULLS LAST"


def _ranked_top(where: str = "TRUE", n: int = 10, extra: str = "") -> str:
    return _with(
        _sums_cte(where),
        select=(
            f"SELECT CAST(row_number() OVER (ORDER BY {ORDER_CONV}) AS BIGINT) AS rank, "
            f"topic, {', '.join(METRICS)}{extra} FROM sums ORDER BY {ORDER_CONV} LIMIT {n}"
        ),
    )


def _trend(extra: str = "", where: str = "TRUE") -> str:
    return _with(
        _sums_cte(where),
        f"top AS (SELECT topic FROM sums WHERE lower(topic) NOT IN {TOTALS} ORDER BY {ORDER_CONV} LIMIT 10)",
        "trend AS (SELECT date AS date_only, topic, CAST(COALESCE(SUM(raw_conversations), 0) AS BIGINT) "
        "AS raw_conversations FROM topic_facts WHERE topic IN (SELECT topic FROM top) AND date IS NOT NULL "
        f"AND ({where}) GROUP BY date, topic)",
        select=f"SELECT date_only, topic, raw_conversations{extra} FROM trend",
    )


def _distinct(col: str, where: str = "TRUE") -> str:
    return f"SELECT DISTINCT CAST({col} AS VARCHAR) AS {col} FROM topic_facts WHERE {col} IS NOT NULL AND ({where})"


def _topic_volume(where: str, n: int | None = 15) -> str:
    limit = f" ORDER BY volume DESC NULLS LAST, topic ASC NULLS LAST LIMIT {n}" if n else ""
    return _with(
        select=(
            f"SELECT topic, {_s('volume', 'volume')}, COUNT(keyword) AS keyword_count FROM mapped "
            f"WHERE topic IS NOT NULL AND ({where}) GROUP BY topic{limit}"
        )
    )


def _brand_volume(where: str, n: int = 15) -> str:
    return _with(
        f"b AS (SELECT unnest(brands_list) AS brand, volume FROM mapped WHERE {where})",
        select=(
            f"SELECT brand, {_s('volume', 'volume')} FROM b WHERE brand IS NOT NULL GROUP BY brand "
            f"ORDER BY volume DESC NULLS LAST, brand ASC NULLS LAST LIMIT {n}"
        ),
    )


def _top_keywords(where: str, n: int = 50) -> str:
    order = "volume DESC NULLS LAST, keyword ASC NULLS LAST, topic ASC NULLS LAST, brands ASC NULLS LAST"
    return _with(
        select=(
            f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS rank, keyword, topic, volume, brands "
            f"FROM mapped WHERE {where} ORDER BY {order} LIMIT {n}"
        )
    )


def _keyword_kpis(where: str) -> str:
    return _with(
        f"r AS (SELECT * FROM mapped WHERE {where})",
        select=(
            "SELECT COUNT(*) AS total_keywords, COUNT(DISTINCT topic) AS unique_topics, "
            f"{_s('volume', 'total_volume')}, "
            "(SELECT COUNT(DISTINCT b) FROM (SELECT unnest(brands_list) AS b FROM r)) AS unique_brands FROM r"
        ),
    )


BRAND_HIT = f"contains(lower(brands), '{catalog.BRAND_TERM.lower()}')"
TOPIC_HIT = f"contains(lower(topic), '{catalog.TOPIC_TERM.lower()}')"
EXPORT_IN = ", ".join(f"'{v}'" for v in catalog.EXPORT_CATEGORIES)
FACTS_COLS = ", ".join(catalog.FACT_COLUMNS)


ORDER_USERS = "raw_users DESC NULLS LAST, topic ASC NULLS LAST"

_SKEWED_MAP = """
WITH k AS (
  SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS keyword, CAST(p_size * 10 AS BIGINT) AS volume,
         CASE WHEN p_partkey % 3 = 0 THEN 'HOT' WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END AS level1,
         CASE WHEN p_partkey % 3 = 0 OR p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS level2
  FROM part),
m AS (
  SELECT DISTINCT concat(p_name, ' #', CAST(p_partkey AS VARCHAR(20))) AS topic,
         CASE WHEN p_partkey % 3 = 0 THEN 'HOT' ELSE p_type END AS category,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS sub_category
  FROM part),
p AS (SELECT level1, level2, SUM(volume) AS volume, COUNT(keyword) AS n FROM k GROUP BY level1, level2),
j AS (
  SELECT COALESCE(m.topic, p.level1 || ' > ' || COALESCE(p.level2, '')) AS label, p.volume, p.n
  FROM p LEFT JOIN m ON p.level1 IS NOT DISTINCT FROM m.category AND p.level2 IS NOT DISTINCT FROM m.sub_category)
SELECT CASE WHEN label = '' THEN 'Uncategorized' ELSE label END AS topic, CAST(SUM(volume) AS BIGINT) AS volume,
       CAST(SUM(n) AS BIGINT) AS keyword_count
FROM j WHERE label IS NOT NULL GROUP BY 1 ORDER BY volume DESC, topic LIMIT 15
"""

_ODD_BRANDS = """
WITH k AS (
  SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS keyword, CAST(p_size * 10 AS BIGINT) AS volume,
         CASE p_partkey % 7 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['A', 'x'] WHEN 2 THEN ['it''s']
              WHEN 3 THEN ['1', '2.5', 'True', 'z'] WHEN 4 THEN [] WHEN 5 THEN []
              ELSE CASE WHEN p_partkey % 13 = 0 OR p_partkey % 11 = 0 THEN []
                        ELSE [p_brand, concat('Brand#', CAST(p_partkey % 25 + 1 AS VARCHAR(20)))] END
         END AS brands
  FROM part)
SELECT keyword, volume, unnest(brands) AS brand FROM k
"""

_AWKWARD = """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 5 = 0 THEN '  ' || p_name || ' '
            WHEN p_partkey % 4 = 0 THEN 'say "' || p_name || '", twice'
            WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || 'second line'
            WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS text,
       CAST(DATE '1995-01-01' + CAST(p_partkey % 60 AS INT) AS TIMESTAMP) AS day
FROM part
"""


def oracle_sql() -> dict[str, str]:
    if llm is None:
        return _catalog_sql()
    extra = dict(llm.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**_catalog_sql(), **extra}


def _catalog_sql() -> dict[str, str]:
    level_and_dates = f"level1 = '{LEVEL1}' AND date BETWEEN DATE '{D0}' AND DATE '{D1}'"
    return {
        "top_topics_filtered": _ranked_top(level_and_dates),
        "top_topics_all": _ranked_top(),
        "top_topics_chart": _with(
            _sums_cte(),
            select=(
                f"SELECT topic, {', '.join(METRICS)} FROM sums WHERE lower(topic) NOT IN {TOTALS} "
                f"ORDER BY {ORDER_CONV} LIMIT 10"
            ),
        ),
        "top_topics_level2": _ranked_top(f"level2 = '{LEVEL2}'"),
        "top_topics_both": _ranked_top(f"level1 = '{LEVEL1}' AND level2 = '{LEVEL2}'"),
        "topic_totals_dynamic": _with(
            select=(
                f'SELECT topic AS "Topic", {_s("raw_conversations", chr(34) + "Conversations" + chr(34))}, '
                f"{_s('raw_messages', 'msg_count')} FROM topic_facts WHERE topic IS NOT NULL GROUP BY topic"
            )
        ),
        "topic_counts": _with(
            select='SELECT topic, COUNT(*) AS "count" FROM topic_facts WHERE topic IS NOT NULL GROUP BY topic'
        ),
        "daily_trend_top10": _trend(),
        "single_day_topics": _with(
            _sums_cte(f"date = DATE '{catalog.SINGLE_DAY}'"), select=f"SELECT topic, {', '.join(METRICS)} FROM sums"
        ),
        "trending_kpis": _with(
            select=(
                "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT topic) AS unique_topics, "
                f"{_s('raw_conversations', 'total_conversations')}, {_s('raw_users', 'total_users')} "
                f"FROM topic_facts WHERE level1 = '{LEVEL1}'"
            )
        ),
        "dataset_info": _with(
            select=(
                "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT topic) AS unique_topics, "
                "COUNT(DISTINCT level1) AS unique_level1, COUNT(DISTINCT level2) AS unique_level2, "
                "MIN(date) AS min_date, MAX(date) AS max_date FROM topic_facts"
            )
        ),
        "date_bounds": _with(select="SELECT MIN(date) AS min_date, MAX(date) AS max_date FROM topic_facts"),
        "filter_counts": _with(
            select=(
                f"SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {level_and_dates}) AS rows_after "
                "FROM topic_facts"
            )
        ),
        "level1_values": _with(select=_distinct("level1")),
        "level2_values_in_level1": _with(select=_distinct("level2", f"level1 = '{LEVEL1}'")),
        "level2_search": _with(
            select=_distinct("level2", f"contains(lower(level2), '{catalog.LEVEL2_TERM.lower()}')")
        ),
        "level2_page1": _with(
            f"v AS ({_distinct('level2')})", select="SELECT level2 FROM v ORDER BY level2 LIMIT 10 OFFSET 10"
        ),
        "level2_page2": _with(f"v AS ({_distinct('level2')})", select="SELECT level2 FROM v ORDER BY level2 OFFSET 10"),
        "topic_values_page2": _with(
            f"v AS ({_distinct('topic')})", select="SELECT topic FROM v ORDER BY topic OFFSET 50"
        ),
        "topic_group_count": _with(
            select="SELECT COUNT(*) AS groups FROM (SELECT DISTINCT topic FROM topic_facts WHERE topic IS NOT NULL)"
        ),
        "report_kpis": _with(
            select=(
                "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT topic) AS unique_topics, "
                f"{_s('raw_conversations', 'total_conversations')}, {_s('raw_users', 'total_users')} "
                f"FROM topic_facts WHERE {level_and_dates}"
            )
        ),
        "report_table_top": _ranked_top(level_and_dates),
        "report_chart_top": _with(
            _sums_cte(level_and_dates),
            select=(
                f"SELECT topic, {', '.join(METRICS)} FROM sums WHERE lower(topic) NOT IN {TOTALS} "
                f"ORDER BY {ORDER_CONV} LIMIT 10"
            ),
        ),
        "report_trend": _trend(where=level_and_dates),
        "labelled_top": _ranked_top(extra=", format('{:,}', raw_conversations) AS conversations_label"),
        "labelled_trend": _trend(extra=", strftime(date_only, '%Y-%m-%d') AS day_text"),
        "topic_map": _with(select="SELECT topic, category, sub_category FROM topic_map"),
        "keywords_mapped": _with(select=f"SELECT {KW_ROWS} FROM mapped"),
        "keywords_fallback": _with(
            "f AS (SELECT *, COALESCE(level1, '') || ' > ' || COALESCE(level2, '') AS label FROM keywords)",
            select=(
                "SELECT keyword, volume, brands, level1, level2, country, date, "
                "CASE WHEN label = ' > ' THEN 'Uncategorized' ELSE label END AS topic FROM f"
            ),
        ),
        "brands_exploded": _with(select="SELECT keyword, volume, unnest(brands_list) AS brand FROM keyword_brands"),
        "brand_values": _with(
            "b AS (SELECT unnest(brands_list) AS brand FROM keyword_brands)",
            select="SELECT DISTINCT brand FROM b WHERE brand IS NOT NULL",
        ),
        "brand_search_topics": _topic_volume(BRAND_HIT),
        "brand_search_keywords": _top_keywords(BRAND_HIT),
        "brand_search_kpis": _keyword_kpis(BRAND_HIT),
        "brand_search_kpis_mapped": _keyword_kpis(BRAND_HIT),
        "brand_exact_rows": _with(
            select=f"SELECT {KW_ROWS} FROM mapped WHERE list_contains(brands_list, '{catalog.BRAND_TERM}')"
        ),
        "topic_search_brands": _brand_volume(TOPIC_HIT),
        "topic_search_keywords": _top_keywords(TOPIC_HIT),
        "topic_search_keywords_mapped": _top_keywords(TOPIC_HIT),
        "topic_search_kpis": _keyword_kpis(TOPIC_HIT),
        "topic_search_regex": _topic_volume(f"regexp_matches(lower(topic), '{catalog.TOPIC_PATTERN}')", n=None),
        "overview_topics": _topic_volume("TRUE"),
        "overview_topics_eager": _topic_volume("TRUE"),
        "overview_brands": _brand_volume("TRUE"),
        "overview_brands_plain": _brand_volume("TRUE"),
        "overview_kpis": _keyword_kpis("TRUE"),
        "overview_kpis_mapped": _keyword_kpis("TRUE"),
        "overview_kpis_dedupe": _with(
            select=(
                "SELECT (SELECT COUNT(*) FROM keywords) AS total_keywords, "
                "(SELECT COUNT(DISTINCT topic) FROM mapped) AS unique_topics, "
                f"(SELECT {_s('volume', 'v')} FROM keywords) AS total_volume, "
                "(SELECT COUNT(DISTINCT b) FROM (SELECT unnest(brands_list) AS b FROM keyword_brands)) AS unique_brands"
            )
        ),
        "topic_search_brands_dedupe": _with(
            f"hit AS (SELECT DISTINCT keyword FROM mapped WHERE {TOPIC_HIT})",
            "b AS (SELECT unnest(kb.brands_list) AS brand, kb.volume FROM keyword_brands kb "
            "WHERE kb.keyword IN (SELECT keyword FROM hit))",
            select=(
                f"SELECT brand, {_s('volume', 'volume')} FROM b WHERE brand IS NOT NULL GROUP BY brand "
                "ORDER BY volume DESC NULLS LAST, brand ASC NULLS LAST LIMIT 15"
            ),
        ),
        "keywords_filtered": _with(
            select=(
                f"SELECT {KW_ROWS} FROM mapped WHERE date BETWEEN DATE '{K0}' AND DATE '{K1}' "
                f"AND country = '{catalog.COUNTRY}'"
            )
        ),
        "keyword_filter_counts": _with(
            select=(
                "SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE date BETWEEN "
                f"DATE '{K0}' AND DATE '{K1}' AND country = '{catalog.COUNTRY}') AS rows_after FROM mapped"
            )
        ),
        "topic_label_values": _with(select="SELECT DISTINCT topic FROM mapped WHERE topic IS NOT NULL"),
        "country_values": _with(select="SELECT DISTINCT country FROM keywords WHERE country IS NOT NULL"),
        "keyword_date_bounds": _with(select="SELECT min(date) AS min_date, max(date) AS max_date FROM keywords"),
        "skewed_map_topics": _SKEWED_MAP,
        "odd_brands_exploded": _ODD_BRANDS,
        "odd_brands_jvm": _ODD_BRANDS,
        "download_filtered_csv": _with(
            select=(
                f"SELECT {FACTS_COLS}, 'filtered_topics_{LEVEL1}_{LEVEL2}.csv' AS file_name FROM topic_facts "
                f"WHERE level1 = '{LEVEL1}' AND level2 = '{LEVEL2}' "
                f"AND date BETWEEN DATE '{catalog.DATE_RANGE[0]}' AND DATE '{catalog.DATE_RANGE[1]}'"
            )
        ),
        "chart_bars": _with(
            _sums_cte(),
            f"top AS (SELECT topic, {', '.join(METRICS)} FROM sums WHERE lower(topic) NOT IN {TOTALS} ORDER BY {ORDER_CONV} LIMIT 10)",
            select=(
                f"SELECT 1 + count(*) OVER () - row_number() OVER (ORDER BY {ORDER_CONV}) AS bar, topic, {', '.join(METRICS)} FROM top"
            ),
        ),
        "top_topics_by_users": _with(
            _sums_cte(),
            select=(
                f"SELECT CAST(row_number() OVER (ORDER BY {ORDER_USERS}) AS BIGINT) AS rank, topic, "
                f"raw_users, raw_messages FROM sums ORDER BY {ORDER_USERS} LIMIT 10"
            ),
        ),
        "export_brand_rows_csv": _with(
            select=f"SELECT {KW_ROWS}, CAST(to_json(brands_list) AS VARCHAR) AS brands_list FROM mapped WHERE {BRAND_HIT}"
        ),
        "export_awkward_text": _AWKWARD,
        "tee_csv": _AWKWARD,
        "typed_null_tokens": (
            "SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS keyword, "
            "CASE WHEN p_partkey % 4 = 0 OR p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size * 10 AS BIGINT) END AS volume, "
            "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(p_partkey % 60 AS INT) END AS date FROM part"
        ),
        "united_tables": _with(select=f"SELECT {FACTS_COLS} FROM topic_facts"),
        "rows_written": _with(
            select=(
                "SELECT 'parquet' AS sink, COUNT(*) AS rows_written FROM topic_facts UNION ALL "
                f"SELECT 'csv', COUNT(*) FROM topic_facts WHERE level1 = '{LEVEL1}'"
            )
        ),
        "export_categories_csv": _with(
            select=(
                "SELECT device, country, topic, level1 AS category, level2 AS sub_category, raw_messages, "
                f"raw_users, raw_conversations, date FROM topic_facts WHERE level1 IN ({EXPORT_IN})"
            )
        ),
        "export_categories_parquet": _with(
            select=(
                "SELECT device, country, topic, level1 AS category, level2 AS sub_category, raw_messages, "
                f"raw_users, raw_conversations, date FROM topic_facts WHERE level1 IN ({EXPORT_IN})"
            )
        ),
        "export_filtered_csv": _with(select=f"SELECT {FACTS_COLS} FROM topic_facts WHERE level1 = '{LEVEL1}'"),
        "normalised_nulls": _with(
            select=(
                "SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS keyword, "
                "CAST(p_size * 10 AS BIGINT) AS volume, "
                "CASE WHEN p_partkey % 31 = 0 OR p_partkey % 37 = 0 OR p_partkey % 43 = 0 OR p_partkey % 29 = 0 "
                "THEN NULL WHEN p_partkey % 3 = 0 THEN 'US' ELSE 'DE' END AS country FROM part"
            )
        ),
        "parsed_dates": _with(
            "t AS (SELECT topic, raw_conversations, CASE WHEN date IS NULL THEN 'not a date' "
            "ELSE CAST(date AS VARCHAR) END AS date_text FROM topic_facts)",
            select="SELECT topic, raw_conversations, date_text, TRY_CAST(date_text AS TIMESTAMP) AS parsed FROM t",
        ),
        "partitioned_roundtrip": _with(select=f"SELECT {FACTS_COLS} FROM topic_facts"),
        "hash_sample_portable": _with(
            select=(
                f"SELECT {FACTS_COLS} FROM topic_facts WHERE CAST(('0x' || substr(md5(concat_ws('|', "
                "COALESCE(CAST(topic AS VARCHAR), '\\N'), COALESCE(CAST(date AS VARCHAR), '\\N'))), 1, 8)) AS BIGINT) % 4 = 0"
            )
        ),
        "kept_topics": _with(_sums_cte(), select=f"SELECT topic, {', '.join(METRICS)} FROM sums"),
        "remote_csv_ranges": _with(select=f"SELECT {FACTS_COLS} FROM topic_facts"),
        "remote_parquet_topics": _with(_sums_cte(), select=f"SELECT topic, {', '.join(METRICS)} FROM sums"),
        "quarantine_good": (
            "SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS keyword, CAST(p_size * 10 AS BIGINT) AS volume, "
            "CAST(DATE '1995-01-01' + CAST(p_partkey % 60 AS INT) AS DATE) AS date FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 37 <> 0"
        ),
        "quarantine_rejected": (
            "SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS keyword, "
            "CASE WHEN p_partkey % 31 = 0 THEN 'many' ELSE CAST(p_size * 10 AS VARCHAR) END AS volume, "
            "CASE WHEN p_partkey % 37 = 0 THEN '1995-13-45' ELSE CAST(CAST(DATE '1995-01-01' + CAST(p_partkey % 60 AS INT) AS DATE) AS VARCHAR) END AS date, "
            "concat_ws('; ', CASE WHEN p_partkey % 31 = 0 THEN 'not a bigint in volume: many' END, "
            "CASE WHEN p_partkey % 37 = 0 THEN 'not a date in date: 1995-13-45' END) AS reasons "
            "FROM part WHERE p_partkey % 31 = 0 OR p_partkey % 37 = 0"
        ),
        "sample_per_level1": _with(
            select=(
                f"SELECT {FACTS_COLS} FROM topic_facts QUALIFY row_number() OVER (PARTITION BY level1 ORDER BY "
                "CAST(('0x' || substr(md5(concat_ws('|', '42', "
                + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '\\N')" for c in catalog.FACT_COLUMNS)
                + ")), 1, 15)) AS BIGINT), "
                + ", ".join(f"{c} NULLS LAST" for c in catalog.FACT_COLUMNS)
                + ") <= 20"
            )
        ),
        "topics_ranked": _with(
            _sums_cte(),
            select=f"SELECT CAST(row_number() OVER (ORDER BY {ORDER_CONV}) AS BIGINT) AS rank, topic, {', '.join(METRICS)} FROM sums",
        ),
        "top_topics_per_level1": _with(
            f"s AS (SELECT level1, topic, {', '.join(_s(m) for m in METRICS)} FROM topic_facts WHERE topic IS NOT NULL GROUP BY level1, topic)",
            select=(
                f"SELECT CAST(row_number() OVER (PARTITION BY level1 ORDER BY {ORDER_CONV}) AS BIGINT) AS rank, "
                f"level1, topic, {', '.join(METRICS)} FROM s QUALIFY row_number() OVER (PARTITION BY level1 ORDER BY {ORDER_CONV}) <= 10"
            ),
        ),
        "topic_values_third_page": _with(
            f"v AS ({_distinct('topic')})", select="SELECT topic FROM v ORDER BY topic LIMIT 20 OFFSET 40"
        ),
        "clustered_roundtrip": _with(select=f"SELECT {FACTS_COLS} FROM topic_facts WHERE date BETWEEN DATE '{D0}' AND DATE '{D1}'"),
        "brand_search_indexed": _with(select=f"SELECT * FROM keywords WHERE {BRAND_HIT}"),
        "topic_search_indexed": _with(f"v AS ({_distinct('topic')})", select=f"SELECT topic FROM v WHERE {TOPIC_HIT}"),
        "keywords_bucketed": _with(select=f"SELECT {KW_ROWS} FROM mapped"),
        "streamed_rollup": _with(
            select=(
                f"SELECT date, level1, level2, topic, {', '.join(_s(m) for m in METRICS)} "
                "FROM topic_facts GROUP BY date, level1, level2, topic"
            )
        ),
        "compacted_rollup": _with(
            select=(
                f"SELECT date, level1, level2, topic, {', '.join(_s(m) for m in METRICS)} "
                "FROM topic_facts GROUP BY date, level1, level2, topic"
            )
        ),
        "daily_rollup": _with(
            select=(
                f"SELECT date, level1, level2, topic, {', '.join(_s(m) for m in METRICS)} "
                "FROM topic_facts GROUP BY date, level1, level2, topic"
            )
        ),
    }
