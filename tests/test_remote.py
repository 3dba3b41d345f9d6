"""Files behind byte ranges: every line once wherever the cuts fall, the same
rows as a file read, and web answers of all kinds (no server: answers are made up)."""

import email.message
import io
import random
import urllib.error

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import SF_SMALL, rows
from trendlens.sources import readers, remote

LINES = st.lists(st.text(alphabet="ab,é\r", max_size=7).map(str.encode), max_size=12)


@settings(max_examples=200, deadline=None)
@given(LINES, st.booleans(), st.lists(st.integers(0, 80), max_size=6), st.integers(1, 9))
def test_every_line_is_owned_once(lines, closed, cuts, block):
    data = b"\n".join(lines) + (b"\n" if closed and lines else b"")
    edges = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    got = []
    for a, b in zip(edges, edges[1:]):
        for found in remote.owned_lines(lambda x, y: data[x:y], len(data), a, b, block):
            got += found
    expected = data.split(b"\n")
    assert got == (expected[:-1] if expected[-1] == b"" else expected)


def test_a_range_inside_one_long_line_stops_at_its_end():
    data, seen = b"x" * 1000 + b"\nlast", []

    def fetch(a, b):
        seen.append((a, b))
        return data[a:b]

    assert list(remote.owned_lines(fetch, len(data), 100, 300, 50)) == []
    assert max(b for _, b in seen) == 300


TEXT = 'name,n,day\r\n"a, ""q""",1,2024-01-01\r\n\r\nb,,\nNA,3,2024-02-29\nété,4,NA\nlast,5,2024-03-01'
SCHEMA = "name string, n bigint, day date"


def _file(tmp_path, text, name="t.csv"):
    path = f"{tmp_path}/{name}"
    with open(path, "wb") as f:
        f.write(text.encode())
    return path


@pytest.mark.parametrize("split", [3, 17, 1 << 20])
@pytest.mark.parametrize("schema", [SCHEMA, None])
def test_same_rows_as_a_file_read(spark, tmp_path, split, schema):
    path = _file(tmp_path, TEXT)
    for na in (False, True):
        if not na and schema:
            continue  # the text NA is no date: the read fails, see below
        a = readers.read_csv(spark, path, schema=schema, pandas_na=na)
        b = remote.read_remote_csv(spark, path, schema, remote.FileFetcher(), split_bytes=split, block_bytes=5, pandas_na=na)
        assert rows(a) == rows(b) and len(rows(a)) == 5
        if na:  # otherwise Spark's own inference, which knows more types, has read the file
            assert a.schema == b.schema


def test_bad_rows(spark, tmp_path):
    path = _file(tmp_path, "name,n\na,1\nb,x\nc,2,more\nd\n")

    def read(**kw):
        return remote.read_remote_csv(spark, path, "name string, n bigint", remote.FileFetcher(), split_bytes=6, **kw)

    with pytest.raises(Exception, match="MALFORMED|not a bigint"):
        read().collect()
    assert rows(read(mode="DROPMALFORMED")) == [("a", 1)]
    kept = read(mode="PERMISSIVE", corrupt_column="bad")
    assert rows(kept) == sorted([("a", 1, None), ("b", None, None), ("c", 2, "c,2,more"), ("d", None, "d")], key=repr)
    assert sorted(r.name for r in read(mode="PERMISSIVE").collect()) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("text", ["", "name,n,day", "name,n,day\n", "\n\nname,n,day\n\n"])
def test_no_rows(spark, tmp_path, text):
    out = remote.read_remote_csv(spark, _file(tmp_path, text), SCHEMA, remote.FileFetcher())
    assert out.collect() == [] and out.columns == ["name", "n", "day"]


def test_several_files(spark, tmp_path):
    paths = [_file(tmp_path, TEXT, "a.csv"), _file(tmp_path, "name,n,day\nz,9,\n", "b.csv")]
    out = remote.read_remote_csv(spark, paths, SCHEMA, remote.FileFetcher(), split_bytes=20, pandas_na=True)
    assert out.rdd.getNumPartitions() > 2 and out.count() == 6
    other = _file(tmp_path, "x,y\n1,2\n", "c.csv")
    with pytest.raises(ValueError, match="headers"):
        remote.read_remote_csv(spark, [*paths, other], None, remote.FileFetcher())


def test_parquet_row_groups_and_columns(spark, tmp_path):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/orders.parquet"
    pq.write_table(pq.read_table(f"{SF_SMALL}/orders.parquet"), path, row_group_size=200)
    plain = spark.read.parquet(path)
    out = remote.read_remote_parquet(spark, path, fetcher=remote.FileFetcher(), batch_rows=64)
    assert out.rdd.getNumPartitions() == pq.ParquetFile(path).num_row_groups > 1
    assert out.dtypes == plain.dtypes and rows(out) == rows(plain)
    some = remote.read_remote_parquet(spark, path, ["o_totalprice", "o_orderkey"], remote.FileFetcher())
    assert rows(some) == rows(plain.select("o_totalprice", "o_orderkey"))
    with pytest.raises(ValueError, match="no columns"):
        remote.read_remote_parquet(spark, path, ["nope"], remote.FileFetcher())


def test_few_columns_fetch_few_bytes(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = f"{tmp_path}/wide.parquet"
    noise = random.Random(1)
    pq.write_table(pa.table({"a": list(range(1000)), "b": [noise.randbytes(8000) for _ in range(1000)]}), path)
    files, seen = remote.FileFetcher(), []

    class Counting:
        def fetch(self, url, start, end, version):
            seen.append(end - start)
            return files.fetch(url, start, end, version)

    size, version = files.stat(path)
    reader = remote.GroupReader(Counting(), [], ["a"], 100)
    assert sum(b.num_rows for b in reader.read(remote.Span(path, version, size, 0, 1))) == 1000
    assert sum(seen) < size / 2


def test_a_changed_file_fails(spark, tmp_path):
    path = _file(tmp_path, TEXT)
    out = remote.read_remote_csv(spark, path, SCHEMA, remote.FileFetcher(), pandas_na=True)
    _file(tmp_path, TEXT + "\nmore,1,")
    with pytest.raises(Exception, match="Changed"):
        out.collect()


# --- answers of a web server -------------------------------------------------------

DATA = bytes(range(256)) * 4


def _answer(status, body, **headers):
    class Answer(io.BytesIO):
        pass

    a = Answer(body)
    a.status, a.headers = status, email.message.Message()
    for k, v in headers.items():
        a.headers[k.replace("_", "-")] = v
    return a


def _serve(monkeypatch, answers=None, tag='"v1"'):
    """Requests get the given answers first, then proper ones."""
    asked, answers = [], list(answers or ())

    def open_(request, timeout):
        asked.append(dict(request.header_items()))
        if answers:
            a = answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a
        start, stop = (int(x) for x in request.get_header("Range")[6:].split("-"))
        body = DATA[start : stop + 1]
        return _answer(206, body, ETag=tag, Content_Length=str(len(body)), Content_Range=f"bytes {start}-{stop}/{len(DATA)}")

    monkeypatch.setattr(remote.urllib.request, "urlopen", open_)
    return asked


def _error(code):
    return urllib.error.HTTPError("u", code, "", email.message.Message(), None)


def test_http_ranges(monkeypatch):
    asked = _serve(monkeypatch)
    f = remote.HttpFetcher(headers={"Authorization": "secret"}, pause=0)
    assert f.stat("http://h.invalid/x") == (len(DATA), '"v1"')
    assert f.fetch("http://h.invalid/x", 10, 300, '"v1"') == DATA[10:300]
    assert asked[1]["Range"] == "bytes=10-299" and asked[1]["If-range"] == '"v1"' and asked[1]["Authorization"] == "secret"
    assert "secret" not in repr(f)


def test_http_failures(monkeypatch):
    f = remote.HttpFetcher(pause=0, tries=3)
    short = _answer(206, b"abc", ETag='"v1"', Content_Length="10", Content_Range="bytes 0-9/1024")
    _serve(monkeypatch, [_error(503), urllib.error.URLError("down")])
    assert f.fetch("http://h.invalid/x", 0, 10, '"v1"') == DATA[:10]
    _serve(monkeypatch, [short, _error(429)])
    assert f.fetch("http://h.invalid/x", 0, 10, '"v1"') == DATA[:10]
    _serve(monkeypatch, [_error(500)] * 3)
    with pytest.raises(urllib.error.HTTPError):
        f.fetch("http://h.invalid/x", 0, 10, '"v1"')
    asked = _serve(monkeypatch, [_error(404)])
    with pytest.raises(urllib.error.HTTPError):
        f.stat("http://h.invalid/x")
    assert len(asked) == 1
    _serve(monkeypatch, [_answer(200, DATA)])
    with pytest.raises(ValueError, match="no byte ranges"):
        f.stat("http://h.invalid/x")
    _serve(monkeypatch, tag='"v2"')
    with pytest.raises(remote.Changed):
        f.fetch("http://h.invalid/x", 0, 10, '"v1"')


def test_read_table_takes_urls(spark, tmp_path, monkeypatch):
    """Web locations go to the range reader, with the table's arguments."""
    path = _file(tmp_path, TEXT)

    class Local:  # made here, so it travels by value
        def stat(self, url):
            return remote.FileFetcher().stat(path)

        def fetch(self, url, start, end, version):
            return remote.FileFetcher().fetch(path, start, end, version)

    monkeypatch.setattr(remote, "HttpFetcher", Local)
    out = readers.read_table(spark, "https://h.invalid/t.csv", schema=SCHEMA, pandas_na=True, date_column="day")
    assert rows(out) == rows(readers.read_csv(spark, path, schema=SCHEMA, pandas_na=True))
    with pytest.raises(ValueError, match="multiline"):
        readers.read_table(spark, "https://h.invalid/t.csv", schema=SCHEMA, multiline=True)
