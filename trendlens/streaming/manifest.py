"""What a rollup table consists of: a manifest of our own beside its data.

    <sink>/batch=<id>/attempt=<random>/   partial sums of a micro-batch
    <sink>/_runs/<random>/                folded batches
    <sink>/_manifest/table                checkpoint and schema, written once
    <sink>/_manifest/batch-<id>           path and rows of a finished batch
    <sink>/_manifest/generation-<n>       the runs, and the last batch in them

Every file of the manifest appears whole or not at all.  The table is the newest
generation's runs and the batches after its last one.  So a reader sees a batch
once, before and after it is folded, and a batch that is being written, or was
left half-written, not at all.  Nothing depends on how long Spark keeps its own
commit log.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from trendlens.sources import files


@dataclass(frozen=True)
class Part:
    """A folder below the sink, and how many rows it holds."""

    path: str
    rows: int


@dataclass(frozen=True)
class State:
    generation: int = -1
    last_batch: int = -1  # the last one that is in the runs
    runs: tuple[Part, ...] = ()
    batches: dict[int, Part] = field(default_factory=dict)

    @property
    def parts(self) -> list[Part]:
        return [*self.runs, *(self.batches[i] for i in sorted(self.batches))]


class Manifest:
    def __init__(self, spark: SparkSession, sink: str):
        self.spark, self.sink, self.folder = spark, sink.rstrip("/"), f"{sink.rstrip('/')}/_manifest"

    def _read(self, name: str) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.folder}/{name}"))

    def _write(self, name: str, content: dict, overwrite: bool = False) -> None:
        files.write_text(self.spark, f"{self.folder}/{name}", json.dumps(content), overwrite)

    def open(self, checkpoint: str, schema: str) -> None:
        """Binds the table to the one query that writes it: batch numbers of
        another checkpoint would be taken for retries."""
        if "table" in files.names(self.spark, self.folder):
            bound = self.table()
            if bound["checkpoint"] != checkpoint.rstrip("/"):
                raise ValueError(f"{self.sink} is written by the query of checkpoint {bound['checkpoint']}")
            if bound["schema"] != schema:
                raise ValueError(f"{self.sink} holds {bound['schema']}")
        else:
            self._write("table", {"checkpoint": checkpoint.rstrip("/"), "schema": schema})

    def table(self) -> dict:
        return self._read("table")

    def _numbers(self, kind: str) -> list[int]:
        prefix = f"{kind}-"
        return sorted(int(n.removeprefix(prefix)) for n in files.names(self.spark, self.folder) if n.startswith(prefix))

    def _generation(self, number: int) -> State:
        g = self._read(f"generation-{number}")
        return State(number, g["last_batch"], tuple(Part(p, n) for p, n in g["runs"]))

    def folded(self) -> State:
        """The newest generation, without the batches after it."""
        numbers = self._numbers("generation")
        return self._generation(numbers[-1]) if numbers else State()

    def pending(self) -> int:
        """Number of finished batches that are in no run yet."""
        last = self.folded().last_batch
        return sum(i > last for i in self._numbers("batch"))

    def state(self) -> State:
        base = self.folded()
        entries = {i: self._read(f"batch-{i}") for i in self._numbers("batch") if i > base.last_batch}
        return State(base.generation, base.last_batch, base.runs, {i: Part(e["path"], e["rows"]) for i, e in entries.items()})

    def add_batch(self, number: int, part: Part) -> None:
        """A batch that is done again replaces its entry."""
        self._write(f"batch-{number}", {"path": part.path, "rows": part.rows}, overwrite=True)

    def add_generation(self, number: int, last_batch: int, runs: list[Part]) -> None:
        """Readers switch to it at once; a number that is taken is an error, so
        that of two jobs that fold at a time one fails."""
        self._write(f"generation-{number}", {"last_batch": last_batch, "runs": [(p.path, p.rows) for p in runs]})

    def vacuum(self, keep: int) -> list[str]:
        """Deletes what none of the newest ``keep`` generations and no batch
        after the oldest of them needs; returns the deleted folders."""
        numbers = self._numbers("generation")
        if not numbers:
            return []
        kept = [self._generation(n) for n in numbers[-keep:]]
        old = [i for i in self._numbers("batch") if i <= kept[0].last_batch]
        runs = {f"_runs/{name}" for name in files.names(self.spark, f"{self.sink}/_runs")}
        gone = sorted(runs - {p.path for g in kept for p in g.runs}) + [f"batch={i}" for i in old]
        for path in gone:
            files.delete(self.spark, f"{self.sink}/{path}")
        for name in [f"batch-{i}" for i in old] + [f"generation-{n}" for n in numbers[:-keep]]:
            files.delete(self.spark, f"{self.folder}/{name}")
        return gone
