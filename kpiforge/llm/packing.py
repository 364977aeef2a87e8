"""Packing by sum of squares.

Documents become token ids; whole windows are cut off a long document, the rest
is placed online into a window whose fill level makes the sum of squared counts
of partly filled windows smallest.  The counts per level are the whole state of
a decision, so a task packs its rows as they stream by, without a shuffle.  At
the end of a task the windows still open are closed: the emptiest are cut up to
fill the gaps of the fullest, so a task pads one window at most.

Defined cases: null text counts as empty and packs its end id alone; rows with
equal or null ids are packed each for itself; an empty table gives no rows;
columns other than the two named are ignored.  Memory per task: the open
windows.  A lost task is rerun over the same input split and gives the same
sequence ids (task number, then a running number).
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from kpiforge.llm.common import rows_of
from kpiforge.llm.tokens import encoder

FLUSH = 4096


class LevelPacker:
    """Places rests (1 .. window-1 ids) into windows by the sum-of-squares rule.

    A piece is ``(payload, start, ids)`` with ``ids`` as bytes of 4-byte ids; a
    full window is handed to ``emit(pieces)`` at once.
    """

    def __init__(self, window: int, emit):
        self.window, self.emit = window, emit
        self.count = np.zeros(window + 1)
        self.count[window] = -0.5  # a filled window leaves the sum: its place costs 1, not 2
        self.open: list[list[list]] = [[] for _ in range(window)]

    def place(self, piece: tuple, size: int) -> None:
        n, b = self.count, self.window
        level = 0
        if size < b:
            here = n[1 : b - size + 1]
            cost = np.where(here > 0, n[1 + size : b + 1] - here + 1, np.inf)  # half the change of the sum
            best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # the fullest of equals
            if cost[best] <= n[size] + 0.5:
                level = best + 1
        held = self.open[level].pop() if level else []
        if level:
            n[level] -= 1
        held.append(piece)
        if level + size == b:
            self.emit(held)
        else:
            n[level + size] += 1
            self.open[level + size].append(held)

    def close(self) -> None:
        """Cut the emptiest open windows into the gaps of the fullest."""
        left = deque((level, held) for level in range(self.window - 1, 0, -1) for held in self.open[level])
        while left:
            level, held = left.popleft()
            while level < self.window and left:
                donor_level, donor = left.pop()
                payload, start, ids = donor.pop()
                take = min(self.window - level, len(ids) // 4)
                held.append((payload, start, ids[: 4 * take]))
                level += take
                if 4 * take < len(ids):
                    donor.append((payload, start + take, ids[4 * take :]))
                if donor_level > take:
                    left.append((donor_level - take, donor))
            self.emit(held)
        self.open = [[] for _ in range(self.window)]
        self.count[: self.window] = 0


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ``ids`` (little-endian, binary) if ``with_ids``."""
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    schema += ", ids binary" * with_ids

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        serial = TaskContext.get().partitionId() << 40

        def emit(pieces: list) -> None:
            nonlocal serial
            at = 0
            for (doc, total), start, ids in pieces:
                n = len(ids) // 4
                out.append((doc, start, n, zlib.crc32(ids), total, serial, at, *([ids] if with_ids else [])))
                at += n
            serial += 1

        def flush(doc_type):
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            types = [doc_type] + [pa.int64()] * 6 + [pa.binary()] * with_ids
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        packer, doc_type = LevelPacker(window, emit), None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, text in rows_of(batch):
                ids = enc.encode(text or "") + end
                total, whole = len(ids) // 4, len(ids) // 4 // window * window
                for at in range(0, whole, window):
                    emit([((doc, total), at, ids[4 * at : 4 * (at + window)])])
                if whole < total:
                    packer.place(((doc, total), whole, ids[4 * whole :]), total - whole)
                if len(out) >= FLUSH:
                    yield flush(doc_type)
        packer.close()
        if out:
            yield flush(doc_type)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """Training rows from ``pack(..., with_ids=True)``: sequence_id, n_tokens and
    the ids as one binary, padded to the window unless the fill is a power of two."""
    from pyspark.sql import functions as F

    pad = "hex(0)" if pad_id == 0 else None
    if pad is None:
        raise ValueError("only id 0 is offered for padding")
    rows = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    full = F.expr("aggregate(transform(p, x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))")
    even = F.expr("(n_tokens & (n_tokens - 1)) = 0")
    padded = F.unhex(F.rpad(F.hex(full), 8 * window, "0"))
    return rows.select("sequence_id", "n_tokens", F.when(even, full).otherwise(padded).alias("ids"))
