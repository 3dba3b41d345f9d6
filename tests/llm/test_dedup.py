"""Exact, suffix-array and suffix-tree dedup and the Jaccard join against plain
Python, on the smallest table and on odd rows."""

import random

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import got, pairs
from trendlens.llm import _repeats, components, exact_dedup, jaccard_join, suffix_array, suffix_tree
from trendlens.llm.components import connected_components

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("table", ["odd", "small_docs", "empty"])
def test_exact(request, table):
    docs = request.getfixturevalue(table)
    out = exact_dedup.exact_dedup(docs, hash_all=True)
    assert out.columns == list(COLUMNS)
    expected = brute.exact(pairs(docs))
    rows = got(out, *COLUMNS)
    # rows that repeat the id and text of the row that stays share its verdict
    assert [r[:3] + r[4:] for r in rows] == [r[:3] + r[4:] for r in expected]
    assert {(r[0], r[4]): r[3] for r in rows} == {(r[0], r[4]): r[3] for r in sorted(expected, key=lambda r: r[3])}


def test_exact_reads_full_content_of_open_groups_only(odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert {r.doc_id for r in rows if r.text_sha256} >= {1, 3, 4, 5, 6, 7, 8}
    assert all(r.group_size == 1 for r in rows if r.text_sha256 is None)
    assert any(r.text_sha256 is None for r in rows)


def test_keep_one_row_of_each_text(odd):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r[4] for r in brute.exact(pairs(odd))})


def test_keep_one_of_repeated_and_null_ids_with_other_white_space(spark):
    rows = [(None, "a b"), (None, "ab"), (7, "c d"), (7, "cd"), (7, " c d"), (8, "e f"), (8, "ef "), (9, "g"), (None, "g h"), (9, "gh")]
    kept = got(exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert [r for r in kept if r[0] != 8] == sorted([(None, "a b"), (7, " c d"), (9, "g"), (None, "g h")], key=repr)
    assert [r for r in kept if r[0] == 8] in ([(8, "e f")], [(8, "ef ")])


def _bytes(docs):
    cut = suffix_array.remove_repeated_bytes(docs)
    return got(
        cut.select("doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256)),
    )


def _words(docs):
    return got(suffix_tree.remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)))


@pytest.mark.parametrize("table", ["odd", "small_docs", "empty"])
def test_repeated_bytes(request, table):
    docs = request.getfixturevalue(table)
    assert _bytes(docs) == brute.repeated_bytes(pairs(docs))


@pytest.mark.parametrize("table", ["odd", "small_docs", "empty"])
def test_repeated_words(request, table):
    docs = request.getfixturevalue(table)
    assert _words(docs) == brute.repeated_words(pairs(docs))


def test_repeats_over_many_blocks_and_hot_anchors(small_docs, monkeypatch):
    monkeypatch.setattr(_repeats, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(_repeats, "BLOCKS_PER_BUCKET", 3)
    monkeypatch.setattr(_repeats.remove_repeats, "__defaults__", (1,))
    assert _bytes(small_docs) == brute.repeated_bytes(pairs(small_docs))
    assert _words(small_docs) == brute.repeated_words(pairs(small_docs))


def test_spans_are_the_removed_ranges(odd):
    texts = dict(pairs(odd.where("doc_id is not null")))
    for r in suffix_array.remove_repeated_bytes(odd.where("doc_id is not null")).collect():
        raw, at, kept = (texts[r.doc_id] or "").encode(), 0, b""
        for s in r.spans:
            kept, at = kept + raw[at : s.start], s.end
        assert kept + raw[at:] == bytes(r.kept)


@pytest.mark.parametrize("table", ["odd", "small_docs", "empty"])
@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near(request, table, n, percent):
    docs = request.getfixturevalue(table)
    out = got(jaccard_join.near_duplicates(docs, jaccard_join.Rule(n, percent)))
    assert out == brute.near(pairs(docs), n, percent)


def test_near_finds_links_beside_the_groups_first_member(spark):
    """A large group whose members differ too much from its first, but not from
    each other: round 2 has to link them."""
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(i // 2 * 3, i // 2 * 3 + 3):
            words[(k * 7) % 120] = f"edit{i // 2}_{k}"
        words[(i * 11) % 120] = f"own{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90):
        assert got(jaccard_join.near_duplicates(docs, jaccard_join.Rule(3, percent))) == brute.near(rows, 3, percent)


def test_near_copies_beside_the_first_are_not_all_paired(spark, monkeypatch):
    """Copies that are like each other, but unlike twenty texts of smaller ids,
    which come first in their groups: they are joined by stars, not pair by pair."""
    draw, rows = random.Random(5), []
    for i in range(120):
        words = [f"w{k}" for k in range(240)]
        for k in draw.sample(range(5, 235), 2 if i >= 20 else 9):
            words[k] = f"own{i}_{k}"
        rows.append((i, " ".join(words)))
    paired, crossing = [], jaccard_join._crossing

    def counted(*args):
        out = crossing(*args)
        paired.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_crossing", counted)
    rule = jaccard_join.Rule(5, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_join.near_duplicates(docs, rule)) == brute.near(rows, 5, 80)
    assert len({c for _, _, c in brute.near(rows, 5, 80)}) == 21
    assert sum(paired) <= 4 * len(rows)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 102), (7, 200)]
    found = dict(got(connected_components(spark.createDataFrame(chain, "u long, v long"))))
    assert {found[k] for k in [*range(41), 200]} == {0}
    assert found[100] == found[101] == 100
    assert 102 not in found
    assert got(connected_components(spark.createDataFrame([], "u long, v long"))) == []


def test_small_tables_take_few_tasks(spark, monkeypatch):
    """Each shuffle leaves files for each task before it: rounds over a few links
    fill the disks where they run in all partitions."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, written = {k: spark.conf.get(k) for k in held}, {}

    def wrote(frame, name, real=components.materialize):
        out = real(frame, name)
        written.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "materialize", wrote)
    monkeypatch.setattr(jaccard_join, "materialize", wrote)
    rows = _templated(90, own=6, shared=60)
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = got(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.Rule(3, 80)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == sorted(brute.near(rows, 3, 80), key=repr)
    cores = spark.sparkContext.defaultParallelism
    # the first table of a component search is as its links come, the rounds are not
    assert max(written["mixed"] + written["near-pairs"] + written["stars"]) <= cores
    assert sum(n > cores for n in written["links"]) <= len(written["mixed"]) + 1


def _templated(n, own=22, shared=150, seed=1):
    """Texts that share most words but stay under the threshold; every tenth is
    a near copy of the one before."""
    draw = random.Random(seed)
    template = [f"t{k}" for k in range(shared)]
    out, last = [], None
    for k in range(n):
        if k % 10 == 9:
            words = list(last)
            words[draw.randrange(len(words))] = f"x{k}"
        else:
            words = list(template)
            for j in range(own):
                words.insert(draw.randrange(len(words) + 1), f"o{k}_{j}")
        last = words
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize(("large", "members", "cells"), [(64, 4096, 1 << 18), (3, 8, 1 << 18), (3, 4, 16)])
def test_templated_texts_in_large_word_groups(spark, monkeypatch, large, members, cells):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "PART_MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "RARITY_CELLS", cells)
    for rule in (jaccard_join.Rule(1, 85), jaccard_join.Rule(3, 90)):
        docs = _templated(150)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert got(jaccard_join.near_duplicates(frame, rule)) == sorted(brute.near(docs, rule.n, rule.percent), key=repr)


def test_rarest_tokens_of_linked_sets_meet():
    draw = np.random.default_rng(4)
    rule = jaccard_join.Rule(3, 80)
    count = draw.integers(0, 50, jaccard_join.RARITY_CELLS)
    for _ in range(300):
        common = draw.integers(1, 1 << 62, draw.integers(1, 60), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, draw.integers(1, 1 << 62, draw.integers(0, 12), dtype=np.uint64)])) for _ in "ab")
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            text, token = jaccard_join._rarest(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rule, count)
            assert len(np.intersect1d(token[text == 0], token[text == 1]))


def test_wide_sketches_bound_the_difference_from_below():
    draw = np.random.default_rng(6)
    for size in (600, 1500, 9000):
        common = draw.integers(0, 1 << 64, size, dtype=np.uint64)
        a = np.unique(common)
        b = np.unique(np.concatenate([common[: size * 9 // 10], draw.integers(0, 1 << 64, size // 3, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        bound = jaccard_join._fewest_different(jaccard_join._wide_sketch(a), jaccard_join._wide_sketch(b))
        assert differ * 3 / 5 < bound <= differ and (differ - bound) % 2 == 0
    assert len(jaccard_join._wide_sketch(common[:512])) == 0 and len(jaccard_join._wide_sketch(common[:513])) == 64


def test_large_sets_that_pass_the_short_sketch(spark):
    """Long texts whose short sketches are full of flips."""
    draw = random.Random(8)
    shared = [f"s{k}" for k in range(900)]
    docs = []
    for k in range(24):
        own = [f"o{k if k % 3 else k // 6}_{j}" for j in range(700 if k % 4 else 90)]
        docs.append((k, " ".join(shared + own)))
        docs.append((100 + k, " ".join([w if draw.random() > 0.01 else f"x{k}" for w in shared + own])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for rule in (jaccard_join.Rule(2, 80), jaccard_join.Rule(1, 90)):
        assert got(jaccard_join.near_duplicates(frame, rule)) == sorted(brute.near(docs, rule.n, rule.percent), key=repr)
