"""Chat formatting, licences, LM scoring, mixing, quality, BPE and the pipeline
against plain Python, on the smallest table and on odd rows."""

import collections
import math
import random

import llm_brute as brute
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from conftest_llm import SF, got, pairs
from oracle_check import compare, duck
from trendlens.llm import _seq, bpe, chat, lattice_lm, licenses, mixing, quality, queries

TABLES = ["odd", "small_docs", "empty"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_has_a_row_for_every_document(spark, small_docs, name):
    out = queries.QUERIES[name](spark, SF)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in small_docs.select("doc_id").collect())


# --- chat ------------------------------------------------------------------------

CHAT = [
    (1, 0, "us\ner\\n", "<|im_end|>\\<\\|x"),
    (1, 1, "assistant", ""),
    (1, 2, "assistant", None),
    (None, 0, None, "<\\\\|"),
    (None, 1, "assistant", "z"),
    (2, None, "assistant", "aé<|"),
    (2, None, "assistant", "aé<|"),
    (2, 0, "assistant", "<|im_start|>assistant\nok<|im_end|>"),
    (3, 1, "\\", "<\\"),
    (4, 1, "assistant", "long " * 50_000),
    *[(5, k, "user" if k % 2 else "assistant", f"turn {k} 你好") for k in range(300)],
]


def _read_back(r):
    turns = [p.split("\n", 1) for p in r.formatted.split(chat.START)[1:]]
    assert all(text.endswith(chat.END + "\n") for _, text in turns)
    turns = [(chat.unescape_role(role), chat.unescape(text[: -len(chat.END) - 1])) for role, text in turns]
    raw = r.formatted.encode()
    loss = "".join(chat.unescape(raw[s.start : s.end].decode()) for s in r.loss_spans)
    return (r.conv_id, r.n_turns, brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), brute.sha(loss))


def test_chat_reads_back(spark):
    turns = spark.createDataFrame([(*r, "clash") for r in CHAT], "conv_id long, turn int, role string, text string, formatted string")
    out = chat.format_chats(turns.repartition(3))
    assert sorted(map(_read_back, out.collect()), key=repr) == brute.chats(CHAT)
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_chat_conversations_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        turns = spark.createDataFrame(CHAT, "conv_id long, turn int, role string, text string")
        assert sorted(map(_read_back, chat.format_chats(turns).collect()), key=repr) == brute.chats(CHAT)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- licences ----------------------------------------------------------------------


@pytest.mark.parametrize("table", TABLES)
def test_license_phrases(request, table):
    docs = request.getfixturevalue(table)
    out = licenses.scan(docs).select(
        "doc_id",
        "n_words",
        F.size("places"),
        F.array_min("places.first"),
        F.array_max("places.last"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ","),
    )
    assert got(out) == brute.license_base(pairs(docs), licenses.PHRASES)


def test_license_templates(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "intro words " + gpl),
        (2, gpl.replace("version 3", "version 2")),
        (3, "x Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software"),
        (4, "general license of the public"),  # rare words, but not in place
        (5, "the MIT Kind of licenſe"),
        (6, "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = lambda i: {m.label for m in found[i].matches}
    assert label(1) == {"gpl-3"} and [m.start for m in found[1].matches] == [2]
    assert label(2) == {"gpl-2"}
    assert label(3) == {"mit"} and label(6) == {"bsd"}
    assert label(4) == label(5) == set()
    assert all(0 <= m.score <= 1 for r in found.values() for m in r.matches)


def _edited_licenses():
    """Whole texts, cut, edited and run together, in upper and lower case."""
    draw, rows = random.Random(3), []
    for name, (text, _) in licenses.TEMPLATES.items():
        w = text.split()
        cut = draw.randrange(len(w))
        edited = [x if draw.random() < 0.9 else "other" for x in w]
        inserted = w[:cut] + ["Example", "Corp"] + w[cut:]
        rows += [" ".join(v) for v in (w, ["preface", *w, "rest"], w[:cut], w[cut:], edited, inserted, w + w, [x.upper() for x in w])]
        rows.append("/*\n * " + "\n * ".join(w) + "\n */")
    rows.append(" ".join(text for text, _ in licenses.TEMPLATES.values()))
    return [(i, t) for i, t in enumerate(rows)]


def _license_brute(docs):
    return brute.license_scan(docs, licenses.PHRASES, licenses.TEMPLATES, licenses.LABELS, licenses.MIN_SCORE)


@pytest.mark.parametrize("table", [*TABLES, "edited"])
def test_license_labels_and_scores(request, spark, tmp_path, table):
    docs = spark.createDataFrame(_edited_licenses(), "doc_id long, text string") if table == "edited" else request.getfixturevalue(table)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    expected = _license_brute(pairs(docs))
    assert got(licenses.op5_license_scan(spark, str(tmp_path)), "doc_id", "base_labels", "labels", "score") == expected
    if table == "edited":
        whole = {label for _, _, labels, score in expected if score == 1.0 for label in labels.split(",")}
        assert whole == {licenses.LABELS.get(n, n) for n in licenses.TEMPLATES}


def test_license_in_a_text_of_megabytes(spark):
    mit = licenses.TEMPLATES["mit-text"][0]
    rows = [(1, "mit license software " * 100_000 + mit + " the" * 300_000), (2, "mit permission " * 200_000)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: (r.n_words, [(m.label, m.start, m.score) for m in r.matches]) for r in out.collect()}
    assert ("mit", 300_000, 1.0) in found[1][1] and found[2] == (400_000, [])


def test_license_query_gives_smallest_and_largest_start(spark, tmp_path):
    rows = [
        (1, "under the MIT license"),
        (2, "x apache license, version 2 and cc by-nc y under the mit license z"),
        (3, "under the mit"),
        (None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        w = brute.license_words(t)
        starts = [s for p in licenses.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        expected.append((i, len(starts), min(starts, default=None), max(starts, default=None)))
    assert expected[:2] == [(1, 1, 0, 0), (2, 3, 1, 10)]
    found = licenses.op5_license_scan(spark, str(tmp_path))
    assert got(found, "doc_id", "n_base", "first_word", "last_word") == sorted(expected, key=repr)


# --- LM ----------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_a_long_word_of_many_documents_is_in_the_head(spark):
    url = "https://example.org/" + "x" * 500
    rows = [(i, f"w{i} " + (url if i % 3 == 0 else "other")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    counts = lattice_lm.word_counts(docs).withColumn("marginal", F.lit(-1.0))
    assert {r.word for r in lattice_lm.frequent(counts, 2).collect()} == {url, "other"}


@pytest.mark.parametrize("table", ["odd", "small_docs"])
@pytest.mark.parametrize("head_words", [0, 200])
def test_lattice(request, table, head_words):
    docs = request.getfixturevalue(table)
    docs = docs.where("length(coalesce(text, '')) < 250 or doc_id = 1" if table == "odd" else "n_chars < 3000")
    rows = sorted(map(tuple, lattice_lm.score_documents(docs, MODEL, head_words=head_words).collect()), key=lambda r: brute.json.dumps(r[:3]))
    expected = brute.lattice(pairs(docs), MODEL)
    assert [r[:5] for r in rows] == [r[:5] for r in expected]
    for r, e in zip(rows, expected, strict=True):
        assert r[5:] == pytest.approx(e[5:], rel=1e-9)


def test_lattice_of_nothing_and_of_long_words(empty, odd):
    assert lattice_lm.score_documents(empty, MODEL).collect() == []
    scored = lattice_lm.score_documents(odd, MODEL).collect()
    assert len(scored) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in scored)


# --- mixing ------------------------------------------------------------------------


@pytest.mark.parametrize("table", TABLES)
def test_mixing(request, spark, table):
    docs = request.getfixturevalue(table)
    if "source" not in docs.columns:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs, block_tokens=8, shard_tokens=400).collect()
    assert len(out) == docs.count()
    size, taken = collections.Counter(), collections.Counter()
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    expected = brute.targets(dict(size))
    for r in out:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(expected[r.source], rel=1e-9)
    for s in size:
        shards = max(1, -(-size[s] // 400))
        assert abs(taken[s] - expected[s]) <= 8 * (shards + 1)
    again = mixing.mix(docs.repartition(5), block_tokens=8, shard_tokens=400).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


@pytest.mark.parametrize("seats", [0, 1, 2, 7, 50, 1000])
def test_apportion_is_sainte_lague(spark, seats):
    draw = random.Random(seats)
    votes = {f"p{k:02}": float(draw.choice([0, 1, 1, 5, 40, 1000]) * draw.randint(1, 9)) for k in range(23)}
    parties = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "p string, v double, s long")
    assert {r.p: r.quota for r in mixing.apportion(parties, [], ["p"], "v", "s").collect()} == brute.sainte_lague(votes, seats)


def test_targets_with_caps_and_null_source(spark):
    sizes = {"a": 1000, "b": 10, "c": 1, "Z": 0, "é": 500, None: 30}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert found == pytest.approx(brute.targets(sizes), rel=1e-9)


# --- quality -----------------------------------------------------------------------

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.mark.parametrize("table", TABLES)
def test_quality_base(request, spark, table):
    docs = request.getfixturevalue(table)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.with_quality(docs, labels, "verdict")
    assert out.columns == [*docs.columns, "verdict"]
    assert got(out.select("doc_id", *[f"verdict.{c}" for c in BASE])) == brute.quality(pairs(docs))


def test_quality_odd_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 0), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.trusted_ids(labels).tolist() == [2]
    nothing = quality.with_quality(odd, labels.limit(0), "v").select("v.*").collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in nothing)


def test_quality_keeps_good_and_drops_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    # learn from even ids, judge the odd ones
    verdicts = quality.with_quality(docs, labels.where("doc_id % 2 = 0"), "v").select("doc_id", "v.base_failed", "v.kept")
    judged = verdicts.join(labels, "doc_id").where("doc_id % 2 = 1 and not base_failed").collect()
    good = [r.kept for r in judged if r.quality == 1 and not r.toxic]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) < 0.2


# --- BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.mark.parametrize("table", TABLES)
def test_bpe(request, spark, reference, table):
    docs = request.getfixturevalue(table)
    out = bpe.encode_documents(docs, bpe.production_tokenizer(spark)).collect()
    encoded = [(r.doc_id, r.ids, bytes(r.decoded)) for r in out]
    expected = [(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs(docs)]
    assert sorted(encoded, key=repr) == sorted(expected, key=repr)


def test_bpe_random_texts(vocabulary, reference):
    import pyarrow as pa

    draw = random.Random(3)
    letters = "aabbcdeé ßñ\n\t 12'sreIm　́你好\x1c\x1f\x85​.!?<|>"
    texts = ["".join(draw.choices(letters, k=draw.choice([0, 1, 5, 50, 300]))) for _ in range(800)]
    texts += ["a" * 1000, "ab" * 333, "x" * 65 + " y", "é" * 200, "abc" * 2000]
    for cache in (300_000, 10):
        ids = pa.concat_arrays(list(bpe.encode_batches(iter([pa.array(texts[:400]), pa.array(texts[400:])]), vocabulary, public_tokenizers.PATTERN, cache)))
        assert ids.to_pylist() == [reference.encode_ordinary(t) for t in texts]
        decoded = list(bpe.decode_batches(iter([ids]), vocabulary))[0]
        assert decoded.to_pylist() == [t.encode() for t in texts]


def test_bpe_takes_little_memory_beside_its_texts(vocabulary, reference):
    """The words of all texts of a slice, index arrays for each byte and a cache
    without a limit in bytes filled the executors."""
    import tracemalloc

    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    texts = ["the cat sat on the mat, " * 40 + str(i) for i in range(500)]
    encoder.encode(texts)
    tracemalloc.start()
    ids = encoder.encode(texts)
    decoded = bpe.decode_lists(ids, vocabulary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.to_pylist() == [reference.encode_ordinary(t) for t in texts]
    assert decoded.to_pylist() == [t.encode() for t in texts]
    assert peak < 12 * sum(map(len, texts))


def test_bpe_cache_is_limited_in_bytes(vocabulary, reference):
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN, cache_bytes=200_000)
    draw = random.Random(4)
    most = 0
    for _ in range(30):
        texts = ["".join(draw.choices("abcdefghij", k=500)) + " the cat" for _ in range(10)] + [None, ""]
        assert encoder.encode(texts).to_pylist() == [reference.encode_ordinary(t or "") for t in texts]
        most = max(most, len(encoder.place))
    assert most * 500 < 300_000 and len(encoder.place) < 300


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("quality_verdict", F.lit(1)).withColumn("drop_id", F.lit(2))
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 5
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)

    kept = stages[0](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id: r.v.kept for r in quality.with_quality(docs, labels, "v").collect()}
    assert kept.columns == docs.columns and rows(kept) == rows(docs.where(F.col("doc_id").isin([i for i, k in verdict.items() if k])))

    single = stages[1](spark, kept, SF).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(r[0] for r in brute.exact(pairs(kept)) if r[3])

    apart = stages[2](spark, single, SF).cache()
    assert apart.columns == docs.columns
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, _, c in brute.near(pairs(single), 5, 80) if i == c)

    mixed = stages[3](spark, apart, SF).cache()
    assert mixed.columns == docs.columns
    size = collections.Counter({r.source: 0 for r in apart.collect()})
    out, times = collections.Counter(), collections.Counter()
    for r in apart.collect():
        size[r.source] += len(brute.words(r.text))
    for r in mixed.collect():
        out[r.source] += len(brute.words(r.text))
        times[r.doc_id] += 1
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in apart.collect()}
    assert sum(out.values()) == pytest.approx(sum(size.values()), rel=0.25)

    last = stages[4](spark, mixed, SF).collect()
    expected = [(i, len(reference.encode_ordinary(t)), brute.sha(t)) for i, t in pairs(mixed)]
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in last) == sorted(expected)


def test_pipeline_of_odd_rows_and_of_nothing(spark, odd, empty):
    for docs in (odd, empty):
        frame = docs
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
        assert len(frame.collect()) <= 3 * docs.count()


def test_near_copies_of_null_and_repeated_ids(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [
        (5, text("a")),
        (None, text("a") + " more"),  # a near copy of 5
        (None, text("b")),
        (None, text("c")),
        (None, text("c") + " more"),  # copies among null ids
        (6, text("d")),
        (7, text("d") + " more"),
        (7, text("e")),
        (8, text("f")),
        (8, text("f") + " more"),  # copies of one id
        (3, text("f") + " less"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text.split("0")[0]) for r in out.collect()), key=repr)
    assert left == sorted([(5, "a"), (None, "b"), (None, "c"), (6, "d"), (7, "e"), (3, "f")], key=repr)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_decides_rows_of_one_id_each(spark, doc_id):
    rows = [(doc_id, f"{k} " + "w " * (9 + k % 40), "abc"[k % 3]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    words, times = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        words[r.source] += len(brute.words(r.text))
        times[r.source, r.text] += 1
    assert {s: words[s] for s in "abc"} == pytest.approx(target, rel=0.1)
    # of a source that is cut, some rows stay and some go
    assert 0 < sum(s == "a" for s, _ in times) < 100


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def _plain_cells(text, buckets):
    """Cells of the 1-grams and 2-grams of a text, one number at a time."""
    whole = (1 << 64) - 1
    value, odd = [int(v) for v in _seq._BYTE], 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
        return x ^ (x >> 31)

    def word_hash(word):
        data = word.encode()
        return mix((sum(value[b] * pow(odd, j, 1 << 64) for j, b in enumerate(data)) + len(data) * 0xD6E8FEB86659FD93) & whole)

    one = [word_hash(w) for w in brute.words(text)]
    two = [mix((3 * a + b) & whole) for a, b in zip(one, one[1:], strict=False)]
    return [h % buckets for h in one + two]


def test_log_ratios_and_verdicts_are_those_of_plain_python(spark, small_docs):
    docs = pairs(small_docs)
    marks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        marks[r.doc_id].append(r.quality == 1 and (r.toxic or 0) == 0)
    trusted = {i for i, m in marks.items() if all(m)}
    cells = [_plain_cells(t, quality.BUCKETS) for _, t in docs]
    raw, good = collections.Counter(), collections.Counter()
    for (i, _), own in zip(docs, cells, strict=True):
        raw.update(own)
        good.update(own if i in trusted else ())
    share, s = sum(good.values()) / sum(raw.values()), quality.SMOOTHING
    ratio = {c: math.log((good[c] + s) / (raw[c] * share + s)) for c in raw}
    found = {r.doc_id: r for r in quality.op9_quality_rules(spark, SF).collect()}
    kept = 0
    for (i, _), own in zip(docs, cells, strict=True):
        llr = sum(ratio[c] for c in own) / max(len(own), 1)
        assert found[i].llr == pytest.approx(llr, abs=1e-9)
        assert found[i].kept == (not found[i].base_failed and llr >= quality.THRESHOLD) or abs(llr - quality.THRESHOLD) < 1e-9
        kept += found[i].kept
    assert 0 < kept < len(docs)
