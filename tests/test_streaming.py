"""The incremental rollup: restarts take only new files; totals equal the
batch rollup over all files."""

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, rows
from trendlens.session import scratch_path
from trendlens.sources import files
from trendlens.sources import fixtures as fx
from trendlens.sources.writers import rollup
from trendlens.streaming import compact, read_rollup, start_rollup_stream, vacuum
from trendlens.streaming.manifest import Manifest


def test_rollup_stream_is_incremental(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    first = facts.filter(F.col("raw_messages") % 2 == 0)
    second = facts.filter(F.col("raw_messages") % 2 == 1)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("landing", "parts", "ckpt"))
    first.repartition(3).write.parquet(src)
    start_rollup_stream(spark, src, facts.schema, sink, ckpt, files_per_batch=1).awaitTermination()
    assert rows(read_rollup(spark, sink)) == rows(rollup(first))
    batches_before = spark.read.parquet(sink).select("batch").distinct().count()

    second.repartition(2).write.mode("append").parquet(src)
    start_rollup_stream(spark, src, facts.schema, sink, ckpt, files_per_batch=1).awaitTermination()
    assert rows(read_rollup(spark, sink)) == rows(rollup(facts))
    assert spark.read.parquet(sink).select("batch").distinct().count() == batches_before + 2


def test_rollup_stream_from_csv(spark):
    from trendlens.sources.writers import write_csv

    facts = fx.topic_facts(spark, SF_SMALL)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("landing_csv", "parts_csv", "ckpt_csv"))
    write_csv(facts, src)
    start_rollup_stream(spark, src, facts.schema, sink, ckpt, fmt="csv").awaitTermination()
    assert rows(read_rollup(spark, sink)) == rows(rollup(facts))


def _land(spark, facts, files):
    src = scratch_path(spark, "landing")
    facts.repartition(files).write.parquet(src)
    return src


def test_totals_hold_when_spark_has_purged_its_commits(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    src, sink, ckpt = _land(spark, facts, 24), scratch_path(spark, "parts"), scratch_path(spark, "ckpt")
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "4")
    try:
        for every in (None, 5):  # without folding first
            sink, ckpt = f"{sink}-{every}", f"{ckpt}-{every}"
            start_rollup_stream(spark, src, facts.schema, sink, ckpt, files_per_batch=1, compact_every=every).awaitTermination()
            assert len(files.names(spark, f"{ckpt}/commits")) < 12
            assert rows(read_rollup(spark, sink, checkpoint=ckpt)) == rows(rollup(facts))
    finally:
        spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
    state = Manifest(spark, sink).state()
    assert state.generation == 3 and state.last_batch == 19 and sorted(state.batches) == [20, 21, 22, 23]
    assert len(state.runs) == 1  # the sums hardly shrink: every run goes into the next
    opened = read_rollup(spark, sink).inputFiles()
    assert len(opened) <= 5 * 8  # a run and four batches, of a file for each task at most


def test_compact_and_vacuum(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    src, sink, ckpt = _land(spark, facts, 9), scratch_path(spark, "parts"), scratch_path(spark, "ckpt")
    start_rollup_stream(spark, src, facts.schema, sink, ckpt, files_per_batch=2, compact_every=None).awaitTermination()
    before, expected = read_rollup(spark, sink), rows(rollup(facts))
    assert compact(spark, sink) == 0 and compact(spark, sink) is None
    assert rows(before) == rows(read_rollup(spark, sink)) == expected  # begun readers keep their files
    more = facts.limit(40)
    more.write.mode("append").parquet(src)
    start_rollup_stream(spark, src, facts.schema, sink, ckpt, compact_every=None).awaitTermination()
    assert compact(spark, sink, ratio=0) == 1  # a run of its own
    state = Manifest(spark, sink).state()
    assert len(state.runs) == 2 and not state.batches
    gone = vacuum(spark, sink, keep=1)
    assert set(gone) == {f"batch={i}" for i in range(6)}
    assert rows(read_rollup(spark, sink)) == rows(rollup(facts.unionByName(more)))
    assert vacuum(spark, sink) == []


def test_a_batch_done_again_counts_once(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    src, sink, ckpt = _land(spark, facts, 4), scratch_path(spark, "parts"), scratch_path(spark, "ckpt")
    run = lambda: start_rollup_stream(spark, src, facts.schema, sink, ckpt, files_per_batch=1, compact_every=3)
    run().awaitTermination()
    expected = rows(rollup(facts))
    # as if the driver had died before Spark's own commit: of a batch after the
    # last generation (3), then of a folded one too
    for lost in ([3], [2, 3]):
        for i in lost:
            files.delete(spark, f"{ckpt}/commits/{i}")
        run().awaitTermination()
        assert rows(read_rollup(spark, sink)) == expected
    assert len(files.names(spark, f"{sink}/batch=3")) > 1 and len(files.names(spark, f"{sink}/batch=2")) == 1


def test_half_written_batches_and_other_checkpoints(spark):
    facts = fx.topic_facts(spark, SF_SMALL)
    src, sink, ckpt = _land(spark, facts, 2), scratch_path(spark, "parts"), scratch_path(spark, "ckpt")
    empty = scratch_path(spark, "nothing")
    facts.limit(0).write.parquet(empty)
    start_rollup_stream(spark, src, facts.schema, sink, ckpt).awaitTermination()
    rollup(facts).write.parquet(f"{sink}/batch=7/attempt=x")  # without an entry
    assert rows(read_rollup(spark, sink)) == rows(rollup(facts))
    with pytest.raises(ValueError, match="checkpoint"):
        start_rollup_stream(spark, src, facts.schema, sink, ckpt + "-other")
    with pytest.raises(ValueError, match="checkpoint"):
        read_rollup(spark, sink, checkpoint=ckpt + "-other")
    with pytest.raises(Exception, match="(?i)exist"):  # two jobs that fold at a time
        Manifest(spark, sink).add_generation(0, 0, [])
        Manifest(spark, sink).add_generation(0, 0, [])
    start_rollup_stream(spark, empty, facts.schema, sink + "-empty", ckpt + "-empty").awaitTermination()
    assert read_rollup(spark, sink + "-empty").collect() == []


def test_folded_batches_have_a_file_for_every_core(spark, monkeypatch):
    """Of one file, one task writes a batch and few read it, however many cores there are."""
    from trendlens.plans import catalog

    facts, seen = fx.topic_facts(spark, SF_SMALL), {}

    def start(spark, src, schema, sink, ckpt, **kw):
        seen.update(kw, src=src, sink=sink)
        return start_rollup_stream(spark, src, schema, sink, ckpt, **kw)

    monkeypatch.setattr(catalog, "start_rollup_stream", start)
    assert rows(catalog.compacted_rollup(spark, SF_SMALL)) == rows(rollup(facts))
    assert seen["files_per_batch"] >= spark.sparkContext.defaultParallelism
    landed = len([n for n in files.names(spark, seen["src"]) if n.startswith("part-")])
    assert landed > 2 * spark.sparkContext.defaultParallelism
    state = Manifest(spark, seen["sink"]).state()
    assert state.generation >= 0 and -(-landed // seen["files_per_batch"]) == max(state.last_batch, *state.batches, -1) + 1
