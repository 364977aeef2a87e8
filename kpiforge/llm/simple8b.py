"""Token-id files in Simple-8b words.

A 64-bit word is a selector in its low 4 bits and 60 bits of payload.  Selectors
2 to 15 hold ``COUNTS[s]`` values of ``60 // COUNTS[s]`` bits, the first value lowest;
selector 1 holds 120 zeros or more (their number in the payload); selector 0 is the
escape: the next word is one value of up to 64 bits.  The packer takes the selector
that fits most of the values ahead, the last word of a block is filled up with zeros.

A file row is a block of whole documents in ascending id order: part and block
number, ids before it in its part, the words (little-endian), and per document its id
and where its ids end in the block; readers decode a block with array operations,
selector by selector.  Blocks lie in a Parquet folder, one
part per task, so they are written, lost and rewritten like any Spark output and can be
read from any store that Spark reads.

Defined cases: null text has the end id alone; equal ids are ordered by their text's
hash, then by the text; null ids come first; extra columns are ignored; an empty table
writes no blocks and gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kpiforge.llm.common import rows_of, shared_path
from kpiforge.llm.tokens import encoder

#: Fixed values of the format: values per word of each selector (0 and 1 are special).
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
ESCAPE, ZEROS = 0, 1
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16

_U = np.uint64


#: Bits that each value under 2 ** 16 needs, 1 at least.
SMALL_WIDTHS = np.maximum(np.frexp(np.arange(1 << 16, dtype=float))[1], 1).astype(np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    if not len(values) or values.max() < 1 << 16:
        return SMALL_WIDTHS[values]
    high = values >> _U(16)
    return np.where(high > 0, widths(high) + np.uint8(16), SMALL_WIDTHS[values & _U(0xFFFF)])


def packed(values: np.ndarray) -> np.ndarray:
    """The values as Simple-8b words (unsigned 64-bit)."""
    values = np.ascontiguousarray(values, _U)
    n = len(values)
    if not n:
        return np.zeros(0, _U)
    need = widths(values)
    # the selector at every place: the most values that all fit; past the end zeros follow
    selector = np.zeros(n, np.uint8)
    most, span = need, 1
    for s in range(15, 1, -1):
        count = COUNTS[s]
        while span < count:  # most: the largest need of the next ``span`` values
            step = min(span, count - span)
            later = np.ones_like(most)
            later[: max(n - step, 0)] = most[step:]
            most, span = np.maximum(most, later), span + step
        fits = most <= 60 // count
        if not fits.any():
            break  # nor would more values in fewer bits
        selector[fits] = s
    zero = values == 0
    if zero.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], zero.view(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2):
            selector[a : max(b - 119, a)] = ZEROS
        ends = dict(edge.reshape(-1, 2)[:, ::-1].tolist())
        stops = sorted(ends)
    step = np.array(COUNTS)[selector].tolist()
    places: list[int] = []
    at = 0
    if (selector == ZEROS).any():
        import bisect

        for_run = selector.tolist()
        while at < n:
            places.append(at)
            at = stops[bisect.bisect_right(stops, at)] if for_run[at] == ZEROS else at + step[at]
    else:
        while at < n:
            places.append(at)
            at += step[at]
    place = np.array(places)
    kind = selector[place]
    size = np.where(kind == ESCAPE, 2, 1)
    word_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), _U)
    padded = np.concatenate([values, np.zeros(60, _U)])
    for s in np.unique(kind).tolist():
        mine = kind == s
        here, to = place[mine], word_at[mine]
        if s == ESCAPE:
            words[to + 1] = values[here]
        elif s == ZEROS:
            after = np.concatenate([place[1:], [n]])[mine]
            words[to] = _U(ZEROS) | ((after - here).astype(_U) << _U(4))
        else:
            count, bits = COUNTS[s], 60 // COUNTS[s]
            word = np.full(len(here), s, _U)
            for i in range(count):
                word |= padded[here + i] << _U(4 + i * bits)
            words[to] = word
    return words


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of Simple-8b words."""
    kind = (words & _U(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that are an escaped value
    escapes = np.flatnonzero(kind == ESCAPE)
    if len(escapes):  # a raw word may look like an escape: take them in order
        last = -2
        for e in escapes.tolist():
            if e != last + 1:
                raw[e + 1] = True
                last = e
    count = np.array(COUNTS)[kind]
    zeros = (kind == ZEROS) & ~raw
    count[zeros] = (words[zeros] >> _U(4)).astype(np.int64)
    count[raw] = 0
    ends = np.cumsum(count)
    out = np.zeros(max(int(ends[-1]) if len(ends) else 0, n), _U)
    starts = ends - count
    for s in range(2, 16):
        mine = np.flatnonzero((kind == s) & ~raw)
        if len(mine):
            bits = 60 // COUNTS[s]
            mask = _U((1 << bits) - 1)
            word, to = words[mine], starts[mine]
            for i in range(COUNTS[s]):
                out[to + i] = (word >> _U(4 + i * bits)) & mask
    mine = np.flatnonzero((kind == ESCAPE) & ~raw)
    out[starts[mine]] = words[mine + 1]
    return out[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
              text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, end it with ``end_id`` and write the blocks to ``path``."""
    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)
    names = ["part", "block", "before", "n_ids", "ids", "ends", "words"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, ends, held, size = [], [], [], 0

        def row():
            nonlocal block, before, size
            values = np.frombuffer(b"".join(held), "<u4")
            words = packed(values).astype("<u8").tobytes()
            got = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([block]), pa.array([before]), pa.array([size]), pa.array([ids], pa.list_(arrow_id)),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([words], pa.binary())], names)
            block, before, size = block + 1, before + size, 0
            for x in (ids, ends, held):
                x.clear()
            return got

        for batch in batches:
            for doc, text in rows_of(batch):
                data = enc.encode(text or "") + end
                held.append(data)
                size += len(data) // 4
                ids.append(doc)
                ends.append(size)
                if size >= block_ids:
                    yield row()
        if ids:
            yield row()

    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id")
               .sortWithinPartitions("id", F.xxhash64("text"), "text"))
    blocks = ordered.mapInArrow(run, f"part bigint, block bigint, before bigint, n_ids bigint, "
                                     f"ids array<{kind.simpleString()}>, ends array<bigint>, words binary")
    blocks.write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the blocks: id, start (ids of all documents before
    it), n_tokens, ids_crc32, and the ids as little-endian binary if ``with_ids``."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["ids"].dataType.elementType
    arrow_id = to_arrow_type(kind)
    # a row per part: as many as tasks wrote the files, whatever they hold, so the window is small
    # and the broadcast saves the blocks a shuffle
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", offset.alias("offset"))
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                values = unpacked(np.frombuffer(row["words"], "<u8"), row["n_ids"]).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                data = [values[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(row["ids"], arrow_id), pa.array(starts + row["before"] + row["offset"]), pa.array(ends - starts),
                        pa.array([zlib.crc32(x) for x in data], pa.int64())] + [pa.array(data, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names)

    both = blocks.join(F.broadcast(parts), "part").select("before", "offset", "n_ids", "ids", "ends", "words")
    return both.mapInArrow(run, f"id {kind.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def id_files(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, path).withColumnRenamed("id", "doc_id")
