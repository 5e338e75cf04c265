"""A profile that follows a stream: one state table per micro-batch, combined level by level.

The states of ``fan`` batches become one, ``fan`` of those one again, and so on, so a reader opens
a number of folders that grows with the logarithm of the batches. A folder is named by its first
batch and the batches it spans; one that lies within another finished one counts no more, so a
failure between writing a combined folder and deleting its parts counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.columns import string_columns
from ..operators.merge import (
    combine_frequencies,
    combine_states,
    frequency_states,
    merge_frequencies,
    merge_states,
    profile_states,
)
from ..session import delete_folder, folder_system


class ProfileStream:
    """Keeps profile states under ``path``, a folder all executors share.

    ``update`` is meant for ``foreachBatch``. A replayed batch overwrites its own state, or is
    skipped if that is part of a combined one, so a restart after a failure counts nothing twice.
    A stream with a new checkpoint numbers its batches anew and needs a new ``path``.
    """

    def __init__(self, path: str, columns: Sequence[str] | None = None, fan: int = 16):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.path = path.rstrip("/")
        self.columns = columns
        self.fan = fan

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not self._combined(spark, "states", batch_id):
            self._write(profile_states(batch, self.columns, F.lit(str(batch_id))), "states", batch_id)
        texts = [c for c in string_columns(batch) if self.columns is None or c in self.columns]
        if texts and not self._combined(spark, "values", batch_id):
            self._write(frequency_states(batch, texts), "values", batch_id)
        self._compact(spark, "states", batch_id, combine_states)
        self._compact(spark, "values", batch_id, combine_frequencies)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start following a stream; returns the streaming query."""
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start() if trigger else writer.start()

    def profile(self, spark: SparkSession, limits: Thresholds = DEFAULTS) -> DataFrame:
        return merge_states(self._read(spark, "states"), limits)

    def top_values(self, spark: SparkSession, limits: Thresholds = DEFAULTS) -> DataFrame:
        return merge_frequencies(self._read(spark, "values"), limits.top_values)

    def _folder(self, kind: str, first: int, span: int = 1) -> str:
        return f"{self.path}/{kind}/span={span}/batch={first}"

    def _write(self, states: DataFrame, kind: str, first: int, span: int = 1) -> None:
        states.write.mode("overwrite").parquet(self._folder(kind, first, span))

    def _read(self, spark: SparkSession, kind: str) -> DataFrame:
        counted = _outermost(self._finished(spark, kind))
        return spark.read.parquet(*[self._folder(kind, *f) for f in counted])

    def _finished(self, spark: SparkSession, kind: str) -> list[tuple[int, int]]:
        """``(first, span)`` of every folder that was written to its end."""
        system, root = folder_system(spark, f"{self.path}/{kind}")
        number = lambda entry: int(entry.getPath().getName().split("=")[1])
        child = spark._jvm.org.apache.hadoop.fs.Path
        if not system.exists(root):
            return []
        return [
            (number(batch), number(span))
            for span in system.listStatus(root)
            for batch in system.listStatus(span.getPath())
            if system.exists(child(batch.getPath(), "_SUCCESS"))
        ]

    def _combined(self, spark: SparkSession, kind: str, batch_id: int) -> bool:
        return any(span > 1 and first <= batch_id < first + span for first, span in self._finished(spark, kind))

    def _compact(self, spark: SparkSession, kind: str, batch_id: int, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Combine each level whose last batch this one is."""
        span = self.fan
        while (batch_id + 1) % span == 0:
            first = batch_id + 1 - span
            finished = self._finished(spark, kind)
            parts = [f for f in finished if f[1] < span and first <= f[0] < first + span]
            if parts and (first, span) not in finished:
                states = spark.read.parquet(*[self._folder(kind, *f) for f in _outermost(parts)])
                self._write(combine(states).coalesce(1) if kind == "states" else combine(states), kind, first, span)
            for part in parts:
                delete_folder(spark, self._folder(kind, *part))
            span *= self.fan


def _outermost(folders: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The folders that lie in no other one."""
    inside = lambda a, b: a[1] < b[1] and b[0] <= a[0] < b[0] + b[1]
    return [a for a in folders if not any(inside(a, b) for b in folders)]
