"""Helpers shared by the operators: shared-folder tables, worker state, sorted runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import ensure_checkpoint_dir

#: A-Z only: the contracts lower-case no other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster names in ``spark.checkpoint.dir``.

    The path is deleted when the application's file system closes.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpiforge-{label}-{uuid.uuid4().hex}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def written(df: DataFrame, label: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    spark = session_of(df)
    path = shared_path(spark, label)
    df.write.format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    import sys
    import types

    name = "kpiforge_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


#: What a :class:`WordCache` holds at most, by its own estimate; longer words aren't kept.
CACHE_BYTES = 256 << 20
LONG_WORD = 64


class WordCache(dict):
    """word -> what ``make`` gives for it, kept for words that are not long.  At ``entries``
    words or ``CACHE_BYTES`` it starts anew."""

    def __init__(self, make, size, entries: int):
        self.make, self.size, self.entries, self.held = make, size, entries, 0

    def __missing__(self, word: str):
        got = self.make(word)
        if len(word) <= LONG_WORD:
            own = 160 + 2 * len(word) + self.size(got)
            if len(self) >= self.entries or self.held + own > CACHE_BYTES:
                self.clear()
                self.held = 0
            self.held += own
            self[word] = got
        return got


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rows_of(batch, *columns: int, step: int = 256) -> Iterator[tuple]:
    """The rows of an Arrow batch (its given columns, or all), a few at a time as Python values."""
    if columns:
        batch = batch.select(list(columns))
    for at in range(0, batch.num_rows, step):
        yield from zip(*[c.to_pylist() for c in batch.slice(at, step).columns], strict=True)


def sorted_runs(batches: Iterator, key: str) -> Iterator[dict[str, np.ndarray]]:
    """Chunks of a partition sorted by the 64-bit column ``key``: each chunk is a
    dictionary of numpy columns that holds whole runs of equal keys only.
    Memory: one Arrow batch plus the longest run."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: _values(batch.column(i)) for i, n in enumerate(batch.schema.names)}
        keys = now[key]
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last == 0 and held and held[-1][key][-1] == keys[0]:
            held.append(now)
            continue
        parts = [*held, {n: v[:last] for n, v in now.items()}]
        if sum(len(p[key]) for p in parts):
            yield {n: np.concatenate([p[n] for p in parts]) for n in now}
        held = [{n: v[last:] for n, v in now.items()}]
    if held:
        yield {n: np.concatenate([p[n] for p in held]) for n in held[0]}


def _values(column) -> np.ndarray:
    """A numpy column; one with nulls holds Python objects, so that numbers stay whole."""
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
