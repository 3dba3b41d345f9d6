"""Incremental pre-aggregation (A20) with Structured Streaming.

Files land in a folder over time; each micro-batch is summed per key tuple, its
partial sums are written to a folder of their own, and an entry in the table's
manifest (:mod:`trendlens.streaming.manifest`) makes them part of the table.  A
batch that is retried replaces its entry, or is left out if it has been folded
already, so every batch counts once.  The query keeps no state between batches;
readers add the partial sums up again, which gives the same totals as a batch
rollup over all files.

Folding: :func:`compact` sums the batches since the last generation into one
run, together with the newest runs while they are at most ``ratio`` times as
large as what is folded into them.  Runs therefore grow geometrically: there are
about log(rows) of them, and a row is rewritten about as often.  The stream does
it every ``compact_every`` batches, which bounds the files a reader opens.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trendlens.operators.aggregate import total
from trendlens.sources.writers import rollup, write_parquet
from trendlens.streaming.manifest import Manifest, Part

KEYS = ("date", "level1", "level2", "topic")
METRICS = ("raw_conversations", "raw_messages", "raw_users")
COMPACT_EVERY = 50
RATIO = 4


def start_rollup_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    keys: Sequence[str] = KEYS,
    metrics: Sequence[str] = METRICS,
    files_per_batch: int | None = None,
    available_now: bool = True,
    fmt: str = "parquet",
    compact_every: int | None = COMPACT_EVERY,
) -> StreamingQuery:
    """Start the stream over the Parquet (or CSV, with a header row) files in
    ``source``.

    ``available_now=True`` processes what is there in as many batches as
    ``files_per_batch`` allows and stops; ``False`` keeps running.  Restarting
    with the same ``checkpoint`` only takes files that arrived since; another
    checkpoint for the same sink is an error.  ``compact_every=None`` leaves
    folding to jobs of the caller.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", int(files_per_batch))
    if fmt == "parquet":
        stream = reader.parquet(source)
    elif fmt == "csv":
        stream = reader.option("header", "true").option("escape", '"').csv(source)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")
    manifest = Manifest(spark, sink)
    manifest.open(checkpoint, rollup(spark.createDataFrame([], schema), keys, metrics).schema.json())

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= manifest.folded().last_batch:
            return  # done again after a failure, and folded before it
        part = f"batch={batch_id}/attempt={os.urandom(6).hex()}"
        rows = write_parquet(rollup(batch, keys, metrics), f"{manifest.sink}/{part}")
        manifest.add_batch(batch_id, Part(part, rows))
        if compact_every and manifest.pending() >= compact_every:
            compact(spark, sink, keys, metrics)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _sums(spark: SparkSession, manifest: Manifest, parts: Sequence[Part], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(manifest.table()["schema"]))
    paths = [f"{manifest.sink}/{p.path}" for p in parts]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.groupBy(*keys).agg(*[total(m, m) for m in metrics])


def compact(
    spark: SparkSession, sink: str, keys: Sequence[str] = KEYS, metrics: Sequence[str] = METRICS, ratio: float = RATIO
) -> int | None:
    """Folds the finished batches that are in no run yet into one, and switches
    readers to it; returns the new generation's number (None: nothing to fold).
    What it replaces stays for readers that have begun; see :func:`vacuum`."""
    manifest = Manifest(spark, sink)
    state = manifest.state()
    if not state.batches:
        return None
    runs, folded = list(state.runs), list(state.batches.values())
    while runs and runs[-1].rows <= ratio * sum(p.rows for p in folded):
        folded.append(runs.pop())
    path = f"_runs/{os.urandom(6).hex()}"
    rows = write_parquet(_sums(spark, manifest, folded, keys, metrics), f"{manifest.sink}/{path}")
    manifest.add_generation(state.generation + 1, max(state.batches), [*runs, Part(path, rows)])
    return state.generation + 1


def vacuum(spark: SparkSession, sink: str, keep: int = 2) -> list[str]:
    """Deletes folders that only generations before the newest ``keep`` need, and
    runs that a failed job left behind.  No :func:`compact` may run meanwhile."""
    if keep < 1:
        raise ValueError("keep must be >= 1")
    return Manifest(spark, sink).vacuum(keep)


def read_rollup(
    spark: SparkSession,
    sink: str,
    keys: Sequence[str] = KEYS,
    metrics: Sequence[str] = METRICS,
    checkpoint: str | None = None,
) -> DataFrame:
    """Totals per key tuple over all finished batches, folded or not.  With a
    ``checkpoint``, the table must be the one its query writes."""
    manifest = Manifest(spark, sink)
    if checkpoint is not None and manifest.table()["checkpoint"] != checkpoint.rstrip("/"):
        raise ValueError(f"{sink} is not written by the query of checkpoint {checkpoint}")
    return _sums(spark, manifest, manifest.state().parts, keys, metrics)
