"""Samples of exact sizes, ranks, grouped top-N, continued pages, Z-order files,
trigram search and bucketed joins: results against plain forms, and the plans
that make them scale."""

import collections
import datetime as dt
import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, rows
from trendlens.functions.text import matches
from trendlens.operators import joins, topn
from trendlens.operators.bucketed import attach_topics_bucketed, pair_key, write_bucketed
from trendlens.operators.sampling import row_hash, sample_per_category
from trendlens.operators.search import build_text_index
from trendlens.plans import catalog
from trendlens.session import scratch_path
from trendlens.sources import fixtures as fx
from trendlens.sources import layout


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# --- bottom-k ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def uneven(spark):
    """A category with most rows, some small ones, a null one, repeated rows."""
    draw = random.Random(1)
    data = [("hot", k, draw.choice("abc")) for k in range(5000)] + [("few", k, None) for k in range(7)]
    data += [(None, k % 40, "x") for k in range(300)] + [("same", 1, "y")] * 50 + [("one", 1, "z")]
    return spark.createDataFrame(data, "category string, id int, text string")


@pytest.mark.parametrize("hash", ["xxhash64", "md5"])
@pytest.mark.parametrize("k", [0, 1, 10, 400])
def test_sample_has_min_of_k_and_n_rows_of_every_category(spark, uneven, k, hash):
    sizes = collections.Counter(r.category for r in uneven.collect())
    sample = sample_per_category(uneven, ["category"], k, hash=hash)
    assert sample.columns == uneven.columns
    got = rows(sample)
    assert collections.Counter(r[0] for r in got) == collections.Counter({c: min(k, n) for c, n in sizes.items() if k})
    assert got == rows(sample_per_category(uneven.repartition(7, "id"), ["category"], k, hash=hash))
    # the smallest hashes, and none besides
    hashed = [(r[0], r[-1], *r[1:-1]) for r in uneven.withColumn("h", row_hash(uneven.columns, 42, hash)).collect()]
    assert got == sorted(
        ((c, i, t) for c in sizes for _, _, i, t in sorted((r for r in hashed if r[0] == c), key=lambda r: (r[1], repr(r)))[:k]), key=repr
    )


def test_a_smaller_sample_is_part_of_a_larger_one_and_seeds_differ(uneven):
    small, large = (rows(sample_per_category(uneven, ["category"], k)) for k in (20, 200))
    assert not collections.Counter(small) - collections.Counter(large)
    assert small != rows(sample_per_category(uneven, ["category"], 20, seed=7))
    assert sample_per_category(uneven.limit(0), ["category"], 5).collect() == []


def test_sample_ranks_only_rows_below_the_bounds(spark, uneven):
    frame = sample_per_category(uneven, ["category"], 10)
    ranked = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in ranked and "row_number" in ranked
    below = sample_per_category(uneven.where("category = 'hot'"), ["category"], 10)
    assert below.count() == 10


# --- ranks, grouped top-N, pages --------------------------------------------------


def test_rank_of_all_rows(spark):
    draw = random.Random(2)
    data = [(f"k{k}", draw.choice([None, 1, 1, 1, 2, 5, 100 + k])) for k in range(3000)]
    frame = spark.createDataFrame(data, "key string, n int").repartition(6)
    ranked = topn.rank_all(frame, "n", "key")
    assert ranked.columns == ["rank", "key", "n"]
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.rank, r.key) for r in ranked.orderBy("rank").collect()] == [(i, k) for i, (k, _) in enumerate(order, 1)]
    assert "Window" not in plan(ranked) and "SinglePartition" not in plan(ranked)
    assert topn.rank_all(frame.limit(0), "n", "key").collect() == []


def test_top_n_of_every_category_is_limited_before_the_shuffle(spark):
    draw = random.Random(3)
    data = [(draw.choice(["hot", "hot", "hot", "b", None]), f"k{k}", draw.choice([1, 2, 3, None])) for k in range(2000)]
    frame = spark.createDataFrame(data, "category string, key string, n int").repartition(5)
    top = topn.top_n_by(frame, ["category"], 4, "n", "key")
    expected = []
    for c in {r[0] for r in data}:
        best = sorted((r for r in data if r[0] == c), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))[:4]
        expected += [(i, *r) for i, r in enumerate(best, 1)]
    assert rows(top) == sorted(expected, key=repr)
    text = plan(top)
    final, partial = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert "Partial" in text[partial : partial + 200] and final < text.index("Exchange hashpartitioning") < partial


def test_pages_by_token_are_the_pages_by_offset(spark):
    data = [(a, b) for a in (None, 1, 2, 3) for b in (None, "x", "y", "z", "zz")]
    frame = spark.createDataFrame(data, "a int, b string").repartition(4)
    order, token, seen = ["a", "b"], None, []
    while page := [tuple(r) for r in topn.page_after(frame, order, 3, token).collect()]:
        assert page == [tuple(r) for r in topn.page(frame, order, 3, len(seen) // 3).collect()]
        seen, token = seen + page, page[-1]
    assert seen == [tuple(r) for r in frame.orderBy(*[F.col(c).asc_nulls_last() for c in order]).collect()]
    assert "limit=3" in plan(topn.page_after(frame, order, 3, seen[-5])) and "offset" not in plan(topn.page_after(frame, order, 3, seen[-5])).lower()


# --- Z-order ----------------------------------------------------------------------


def files_to_open(path, column, value):
    """Files whose footer allows the value."""
    n = 0
    for f in glob.glob(f"{local(path)}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
        groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        n += any(s.has_min_max and s.min <= value <= s.max for s in groups)
    return n


def test_files_prune_on_either_column(spark):
    draw = random.Random(4)
    cats = [f"category {c:02d}" for c in range(40)]
    data = [(dt.date(2024, 1, 1) + dt.timedelta(draw.randrange(365)), draw.choice(cats), k) for k in range(20000)]
    frame = spark.createDataFrame([(d, c.replace("category ", ""), k) for d, c, k in data], "day date, category string, k int")
    path, plain = scratch_path(spark, "z"), scratch_path(spark, "by_day")
    assert layout.write_clustered(frame, path, ["day", "category"], files=64) == 20000
    frame.repartitionByRange(64, "day", "category").write.parquet(plain)
    assert rows(spark.read.parquet(path)) == rows(frame)
    assert len(glob.glob(f"{local(path)}/*.parquet")) == 64
    day, category = dt.date(2024, 5, 17), "17"
    assert files_to_open(path, "day", day) <= 16 and files_to_open(path, "category", category) <= 16
    assert files_to_open(plain, "category", category) > 40  # an order by day alone prunes on the day alone
    read = spark.read.parquet(path).where(F.col("category") == category)
    assert "PushedFilters: [IsNotNull(category), EqualTo(category,17)]" in plan(read)
    assert rows(read) == rows(frame.where(F.col("category") == category))


def test_z_order_of_other_types_nulls_and_hot_values(spark):
    draw = random.Random(5)
    data = [(draw.choice([None, 0.0, 0.0, 0.0, 2.5, -7.0]), dt.datetime(2024, 1, 1 + k % 28), draw.choice(["", "é", "zebra", None]), [k]) for k in range(4000)]
    frame = spark.createDataFrame(data, "x double, at timestamp, s string, l array<int>")
    path = scratch_path(spark, "z")
    layout.write_clustered(frame, path, ["x", "at", "s"], files=12, bits=3)
    assert rows(spark.read.parquet(path)) == rows(frame)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{local(path)}/*.parquet")]
    assert max(sizes) < 4000 / 4  # a hot value falls into several files
    empty = scratch_path(spark, "z")
    assert layout.write_clustered(frame.limit(0), empty, ["x"], files=3) == 0
    with pytest.raises(ValueError, match="Z-order"):
        layout.write_clustered(frame, empty + "x", ["l"], files=3)


def test_interleaved_bits(spark):
    frame = spark.range(64).select((F.col("id") % 8).cast("int").alias("a"), (F.col("id") / 8).cast("int").alias("b"))
    z = layout.interleaved([F.col("a"), F.col("b")], bits=3)
    expected = {(a, b): sum(((a >> i & 1) << 2 * i) | ((b >> i & 1) << 2 * i + 1) for i in range(3)) for a in range(8) for b in range(8)}
    assert {(r.a, r.b): r.z for r in frame.select("a", "b", z.alias("z")).collect()} == expected


# --- trigram search ---------------------------------------------------------------


def test_indexed_search_equals_the_scan(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices("abcAé %_[]'", k=draw.randrange(0, 30))) for _ in range(400)] + ["aaa", "aaaa", "", "ab", None, "İstanbul", "ÉÉÉ"]
    frame = spark.createDataFrame([(t, k) for k, t in enumerate(texts * 2)], "text string, k int").repartition(3)
    index = build_text_index(frame, "text", scratch_path(spark, "grams"))
    whole = max((t for t in texts if t), key=len)
    terms = ["", "a", "ab", "%_", "abc", "aaa", "aaaa", "ÉÉÉ", "éa", "zzz", "istanbul", "[]'", "a  b"] + [whole[3 : 3 + n] for n in range(1, 21)]
    for term in terms:
        expected = frame.where(matches("text", term))
        assert rows(index.rows(frame, term)) == rows(expected), term
        assert rows(index.texts(term)) == rows(expected.select("text").distinct()), term


def test_indexed_search_reads_few_texts(spark):
    frame = spark.range(20000).select(F.concat(F.lit("keyword number "), F.col("id").cast("string"), F.lit(" of many")).alias("text"))
    index = build_text_index(frame, "text", scratch_path(spark, "grams"))
    found = index.texts("Number 1234 ")
    assert [r.text for r in found.collect()] == ["keyword number 1234 of many"]
    assert "folder#" in plan(found).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert index.candidates("Number 1234 ").count() <= 3
    assert "PushedFilters: [In(gram" in plan(index.candidates("1234"))


# --- bucketed join ----------------------------------------------------------------


def _tables(spark, kw, tmap, **kwargs):
    out = scratch_path(spark, "bucketed")
    names = tuple(f"{side}_{out.rsplit('-', 1)[1]}" for side in ("k", "m"))
    write_bucketed(kw, tmap, names, out, buckets=8, **kwargs)
    return names


def test_bucketed_join_shuffles_nothing(spark):
    kw, tmap = fx.keywords(spark, SF_SMALL), catalog._map(spark, SF_SMALL)
    names = _tables(spark, kw, tmap)
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_topics_bucketed(spark, names)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        columns = catalog.KEYWORD_ROW_COLUMNS
        assert rows(joined, *columns) == rows(joins.attach_topics(kw, tmap), *columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_bucketed_join_of_a_hot_pair(spark):
    kw = spark.createDataFrame([(f"k{k}", 1, "H" if k % 3 else None, None) for k in range(900)], "keyword string, volume int, level1 string, level2 string")
    tmap = spark.createDataFrame([("t1", "H", None), ("t2", "H", None), ("t3", None, None), ("t4", "H", "-")], "topic string, category string, sub_category string")
    names = _tables(spark, kw, tmap, salts=16, heavy_rows=100)
    joined = attach_topics_bucketed(spark, names)
    columns = joined.columns
    assert rows(joined) == rows(joins.attach_topics(kw, tmap), *columns)
    held = spark.table(names[0]).groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(held) >= 6 and max(r["count"] for r in held) < 450


def test_pair_key_tells_pairs_apart(spark):
    values = [None, "", "-", "1:a", "a", "a/1:b", "/"]
    frame = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    assert frame.select(pair_key("a", "b").alias("p")).distinct().count() == len(values) ** 2
