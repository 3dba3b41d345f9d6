"""WARC archives, hard negatives and vector codes against plain Python, on the
smallest tables and on odd rows."""

import gzip
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import SF, got
from trendlens.llm import hard_negatives, vector_codes, warc
from trendlens.session import scratch_path

NAN, INF = float("nan"), float("inf")


# --- plain Python -----------------------------------------------------------------


def is_whole(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def floors(v):
    return [math.floor(256 * x) for x in v]


def brute_records(pages):
    rows = [(p, (html or "").encode()) for p, html in pages]
    rows = [(p, b, hashlib.sha1(b).hexdigest()) for p, b in rows]
    last = {}
    for p, _, d in rows:
        last[d] = max(last.get(d, -math.inf), -math.inf if p is None else p)
    out = []
    for p, b, d in rows:
        best = None if last[d] == -math.inf else last[d]
        revisit = len(b) >= 1000 and p != best
        out.append((p, len(b), d, "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, vector, label, anchor)."""
    kept = [(i, floors(v), c, a) for i, v, c, a in rows if i is not None and c is not None and is_whole(v)]
    if kept:
        length = len(min(kept, key=lambda r: (r[0], len(r[1])))[1])
        kept = [r for r in kept if len(r[1]) == length]
    out = []
    for n, (i, v, c, a) in enumerate(kept):
        if not a:
            continue
        others = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for m, (j, w, d, _) in enumerate(kept) if m != n]
        others.sort()
        for s, p, _ in [r for r in others if r[2] == c][:positives]:
            fit = [r for r in others if r[2] != c and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, p, k, r[1], -s, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label)."""
    kept = [(i, floors(v), c) for i, v, c in rows if is_whole(v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(min(kept, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))[1])
    kept, order = ([r for r in some if len(r[1]) == length] for some in (kept, order))
    w = length // parts
    piece = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[v[p * w : (p + 1) * w] for _, v, _ in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            own = {}
            for x in piece:
                own.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            moved.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = moved
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    best = [[nearest(x[p], books[p]) for p in range(parts)] for x in piece]
    error = [sum(d for d, _ in b) for b in best]
    total = {}
    for (_, _, c), e in zip(kept, error, strict=True):
        total[c] = total.get(c, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), e, total[c], sha) for (i, _, c), b, e in zip(kept, best, error, strict=True)), key=repr)


# --- WARC -------------------------------------------------------------------------

BIG = "<p>é</p>" * 150
ODD_PAGES = [
    (1, "http://a/1", BIG),
    (9, "http://a/9", BIG),
    (9, "http://a/other", BIG),  # repeats the response's id and payload
    (5, None, BIG),
    (None, "http://a/null", BIG),
    (None, "", BIG + "x"),
    (None, "http://b\r\nX: y", BIG + "x"),
    (2, "http://a/2", None),
    (3, "http://a/3", ""),
    (4, "http://a/4", "short"),
    (6, "http://a/6", "short"),
    (7, "http://a/7", "a" * 999),
    (8, "http://a/8", "a" * 999),
    (10, "http://a/10", "a" * 1000),
    (11, "http://a/11", "a" * 1000),
    (12, "http://a/12", "\r\n\r\nWARC/1.1\r\n\r\n" * 3),
    (13, "http://a/13", "z" * 3_000_000),
    (14, "http://a/14", "z" * 3_000_000),
]
FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def odd_pages(spark):
    names = ["payload", "response", "archive", "offset", "length", "of"]
    rows = [(*r, *["clash"] * len(names)) for r in ODD_PAGES]
    schema = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_records_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = scratch_path(spark, "warc")
    records = warc.read_records(warc.write_archives(pages, folder), folder)
    assert got(records, *FIELDS) == brute_records([(r.page_id, r.html) for r in pages.collect()])
    held = records.where("record_type = 'response'")
    assert held.join(pages.select("page_id", "html"), "page_id").where("payload = html").count() == held.count()


def test_records_of_odd_pages(spark):
    pages = odd_pages(spark)
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(pages, folder, archive_bytes=2000)
    assert got(warc.read_records(index, folder), *FIELDS) == brute_records([(r[0], r[2]) for r in ODD_PAGES])
    assert {r.url for r in index.collect()} == {r[1] for r in ODD_PAGES}
    assert index.select("archive").distinct().count() > 3
    assert got(warc.read_records(warc.write_archives(pages.limit(0), folder), folder)) == []


def test_selected_records_and_the_archive_itself(spark):
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(odd_pages(spark), folder)
    some = warc.read_records(index.where("page_id in (4, 10, 12)"), folder)
    assert {r.page_id: r.payload for r in some.collect()} == {4: "short", 10: None, 12: ODD_PAGES[15][2]}
    # an archive is a plain gzip file of records one after the other
    store, root = warc.filesystem(folder)
    rows = sorted((r for r in index.collect()), key=lambda r: (r.archive, r.offset))
    for name in {r.archive for r in rows}:
        data = store.open_input_file(f"{root}/{name}").readall()
        mine = [r for r in rows if r.archive == name]
        assert [r.offset for r in mine] == [0, *np.cumsum([r.length for r in mine]).tolist()[:-1]]
        assert sum(r.length for r in mine) == len(data)
        assert gzip.decompress(data).count(b"WARC-Record-ID: ") == len(mine)


def test_a_changed_payload_is_found():
    digest = hashlib.sha1(b"abc").hexdigest()
    data = warc.record(1, "u", b"abc", digest, None, False)
    assert warc.parse(data)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"abc", b"abd"))


def test_ranges_are_coalesced():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 25, 10), ("a", 500, 10), ("b", 510, 10)]
    assert list(warc.coalesced(ranges, read_bytes=100, gap_bytes=5)) == [[0, 1, 2], [3], [4]]
    assert list(warc.coalesced(ranges, read_bytes=15, gap_bytes=5)) == [[0], [1], [2], [3], [4]]
    assert list(warc.coalesced([])) == []


# --- vectors ----------------------------------------------------------------------


def odd_vectors(n=160, length=32, seed=3):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        v = [draw.gauss(0, 0.3) for _ in range(length)]
        rows.append((k, v, draw.choice([0, 0, 0, 1, 2, None])))
    rows[3] = (3, None, 1)
    rows[4] = (4, [], 1)
    rows[5] = (5, [NAN] + [0.1] * (length - 1), 1)
    rows[6] = (6, [0.1] * (length - 1) + [None], 1)
    rows[7] = (7, [-INF] + [0.1] * (length - 1), 1)
    rows[8] = (8, [0.1] * (length + 16), 0)  # another length
    rows[9] = (9, [1000.0, -1000.0] * (length // 2), 0)
    rows += [(k, rows[20][1], 0) for k in (20, 20, 200, 201, 202, 250)]  # copies, repeated ids
    rows += [(300 + k, [0.0] * length, k % 2) for k in range(6)]
    return rows + [(None, rows[21][1], 0), (None, rows[22][1], 2)]


SCHEMA = "vec_id long, embedding array<double>, label int, v string, `row` string, anchor string, code string, place string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [(8192, 8192), (40, 3)])
def test_hard_negatives(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "ROWS", size[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", size[1])
    rows = odd_vectors()
    found = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    expected = brute_negatives([(i, v, c, i is not None and i % 10 == 0) for i, v, c in rows])
    assert len(expected) > 50 and sorted(got(found)) == expected


def test_hard_negatives_of_few_rows(spark):
    rows = odd_vectors()
    for some in (rows[:0], rows[3:8], rows[10:11], rows[10:14]):
        found = hard_negatives.mine(vectors(spark, some), F.lit(True))
        assert sorted(got(found)) == brute_negatives([(*r, True) for r in some])


def test_query_of_hard_negatives(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    moved = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.vec_id % 50 == 0) for r in rows]
    assert sorted(got(hard_negatives.op12_hard_negatives(spark, SF))) == brute_negatives(moved)


@pytest.mark.parametrize("largest", [1, 160, 9000, 1 << 23])
def test_packed_products_are_exact(largest):
    draw = np.random.default_rng(1)
    packing = hard_negatives.Packing(64, largest)
    a, c = draw.integers(-largest, largest + 1, (9, 64)), draw.integers(-largest, largest + 1, (31, 64))
    a[0], c[0], a[1], c[1] = largest, largest, -largest, largest
    assert packing.fields >= 1 and (packing.scores(a, packing.pack(c), len(c)) == a @ c.T).all()
    assert (packing.dtype is object) == (packing.width > 52)


def test_vector_codes_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 16)
    rows = odd_vectors()
    codes, books = vector_codes.compress(vectors(spark, rows))
    assert codes.columns == ["vec_id", "label", "code", "error"] and books.shape == (16, 64, 2)
    expected = brute_codes(rows)
    assert got(codes, "vec_id", "code", "error") == [r[:3] for r in expected]
    assert vector_codes.digest(books) == expected[0][4]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(1, 5, 3), (4, 256, 1), (16, 1, 2), (2, 7, 0)])
def test_vector_codes_of_other_shapes(spark, parts, entries, rounds):
    rows = odd_vectors(seed=parts)
    codes, _ = vector_codes.compress(vectors(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert got(codes, "vec_id", "code", "error") == [r[:3] for r in brute_codes(rows, parts, entries, rounds)]


def test_vector_codes_of_few_rows(spark):
    rows = odd_vectors()
    for some in (rows[:0], rows[3:8], rows[10:13], [(1, [0.5] * 5, 0)]):
        codes, _ = vector_codes.compress(vectors(spark, some))
        expected = [] if len(some) == 1 else brute_codes(some)
        assert got(codes, "vec_id", "code", "error") == [r[:3] for r in expected]


def test_query_of_vector_codes(spark, tmp_path):
    rows = [r for r in odd_vectors() if r[0] is not None]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert got(out, "vec_id", "code", "error", "label_error", "codebooks_sha256") == brute_codes(rows)


def test_cover_trees_cover():
    draw = np.random.default_rng(2)
    centres = draw.integers(-160, 160, (64, 8))
    data = np.concatenate([draw.integers(-160, 160, (300, 8)), np.zeros((50, 8), int), centres[draw.integers(0, 64, 600)] + draw.integers(-2, 3, (600, 8))])
    trees = vector_codes.cover_trees(data, 2)
    pieces = data.reshape(len(data), 2, 4)
    for k in range(len(trees.start)):
        points, row = trees.points[trees.start[k] : trees.end[k]], trees.row[trees.start[k] : trees.end[k]]
        assert (points == pieces[row, trees.position[k]]).all()
        assert np.sqrt(((points - points[0]) ** 2).sum(axis=1).max()) <= trees.radius[k]
        if n := trees.n_children[k]:
            below = slice(trees.child[k], trees.child[k] + n)
            assert trees.start[below][0] == trees.start[k] and trees.end[below][-1] == trees.end[k]
            assert (trees.start[below][1:] == trees.end[below][:-1]).all()
            assert (trees.points[trees.start[below][0]] == points[0]).all()
    books = centres.reshape(64, 2, 4).transpose(1, 0, 2)
    seen = np.zeros(len(trees.points), int)
    whole = 0
    for part, entry, start, end in vector_codes.assign(trees, books):
        whole += int((end - start)[end - start > 1].sum())
        for p, e, a, b in zip(part, entry, start, end, strict=True):
            seen[a:b] += 1
            square = ((trees.points[a:b, None] - books[p]) ** 2).sum(axis=2)
            assert (square.argmin(axis=1) == e).all()
    assert (seen == 1).all() and whole > len(seen) / 2  # most points go with their subtree


def test_arrow_batches_are_cut_into_blocks(spark):
    rows = odd_vectors(n=300, length=16)
    some = vectors(spark, [r for r in rows if is_whole(r[1]) and len(r[1]) == 16]).repartition(1)
    v = some.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x * 256).cast("int")).alias("v"))
    blocks = vector_codes.tree_blocks(v, 16, 16, block=64)
    sizes = [len(r.vec_id) for r in blocks.collect()]
    assert sizes[:-1] == [64] * (len(sizes) - 1) and sum(sizes) == some.count()


def test_matrix_reads_slices():
    column = pa.chunked_array([pa.array([[1, 2], [3, 4]]), pa.array([[5, 6]])])
    assert vector_codes._vectors.matrix(column, 2).tolist() == [[1, 2], [3, 4], [5, 6]]
