"""SimHash near-duplicates by multi-index hashing.

Fingerprints have two segments of 32 bits.  Of two fingerprints at most three
bits apart, one segment differs in one bit at most, so a table per segment holds
each fingerprint under its own segment value, and each fingerprint looks up its
value and the ball of radius one around it.  Of a pair that differs in one bit
the one with the 0 bit does the look-up, which halves the ball.  What meets under
a value is verified on all 64 bits.

Equal fingerprints are one class before any look-up, so copies cost nothing
more.  A value's fingerprints are joined by a search that visits each of them
once and emits a tree, never all pairs.  Where very many unlinked fingerprints have one
segment value, they are dealt by the halves of the other segment, in the same way, so
that no task compares them all.

Defined cases: null text has no words, and texts without words share the
fingerprint zero; repeated rows are linked like other equal texts; a null id
never names a component that has another id; an empty table gives no rows;
very long texts are hashed whole in parts of bounded memory; extra columns are kept by ``one_per_group``, else ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import rows_of, run_bounds, sorted_runs, written
from kpiforge.llm.components import components

#: Shingles whose bits are counted at once; bounds memory for very long texts.
SPAN = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles (XXH64, seed 42)."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # bytes: lower() takes A-Z only, split() the six white-space bytes
    n = max(len(words) - width + 1, 1 if words else 0)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SPAN):
        part = words[at : min(at + SPAN, n) + width - 1]
        rows = zip(*[part[i:] for i in range(width)]) if len(part) >= width else [part]
        bits = np.frombuffer(b"".join([xxh64_digest(b" ".join(s), 42) for s in rows]), np.uint8)
        ones += np.unpackbits(bits).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, k (hash of the text) and fp (the fingerprint as a signed long), one row per document."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            got = [(xxh64_intdigest((t or "").encode(), 42), fingerprint(t, width)) for _, t in rows_of(batch)]
            cols = np.array(got, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[:, 0]), pa.array(cols[:, 1])], ["doc_id", "k", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, k bigint, fp bigint")


def tree(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the clusters of distinct fingerprints: each fingerprint is
    expanded once, against those no link has reached yet."""
    rest, a, b = prints, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, prints.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _ball(value: Column, width: int) -> Column:
    """One row for ``value`` (``bit`` -1) and one for each bit that is 0 in it: of two values
    that differ in a bit, the one with the 0 looks up the other."""
    return F.explode(F.filter(F.sequence(F.lit(-1), F.lit(width - 1)), lambda bit: (bit < 0) | (
        F.call_function("shiftright", value, F.greatest(bit, F.lit(0))).bitwiseAND(F.lit(1)) == 0)))


def links(prints: DataFrame, max_bits: int = 3, crowded: int = 4096) -> DataFrame:
    """Links (a, b) that span the clusters of the distinct fingerprints ``fp``.

    A segment value of more than ``crowded`` fingerprints makes the cells of its ball crowded.
    There the other segment is cut in two halves, one of which differs in one bit at most,
    and the members meet under the values of its ball."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one find up to three differing bits")
    prints = prints.select("fp")
    low = F.lit((1 << 32) - 1)
    parts = [F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32)]
    own = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).withColumn(
        "value", F.when(F.col("seg") == 0, parts[0]).otherwise(parts[1]))
    cell = F.expr("(case when bit < 0 then value else value | shiftleft(1L, bit) end) * 2 + seg").alias("cell")

    def around(values: DataFrame, *carried: str) -> DataFrame:
        return values.withColumn("bit", _ball(F.col("value"), 32)).select(cell, (F.col("bit") < 0).alias("own"), *carried)

    ball = around(own, "fp")
    hot = own.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    hot = written(around(hot).select("cell").distinct(), "crowded")
    # a cell that is no fingerprint's own value holds no link that another one lacks
    live = written(hot.join(own.select(F.expr("value * 2 + seg").alias("cell")), "cell", "left_semi"), "live")
    other = F.when(F.col("cell").bitwiseAND(F.lit(1)) == 0, parts[1]).otherwise(parts[0])
    halves = (ball.join(live, "cell", "left_semi")
              .select("cell", "own", "fp", other.alias("other"), F.explode(F.array(F.lit(0), F.lit(16))).alias("shift"))
              .withColumn("value", F.expr("shiftright(other, shift) & 65535L"))
              .withColumn("bit", _ball(F.col("value"), 16))
              .select(F.xxhash64("cell", "shift", F.expr("case when bit < 0 then value else value | shiftleft(1L, bit) end")).alias("cell"),
                      "own", "fp", (F.col("bit") < 0).alias("own_half")))

    def run(batches):
        import pyarrow as pa

        for part in sorted_runs(batches, "cell"):
            starts, ends = run_bounds(part["cell"])
            fps = part["fp"].view(np.uint64)
            own, half = (np.add.reduceat(part[c].astype(np.int64), starts) for c in ("own", "own_half"))
            a, b = [], []
            for k in np.flatnonzero((ends - starts > 1) & (own > 0) & (half > 0)):
                x, y = tree(np.unique(fps[starts[k] : ends[k]]), max_bits)
                a.append(x)
                b.append(y)
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    plain = ball.join(hot, "cell", "left_anti").select("cell", "own", "fp", F.col("own").alias("own_half"))
    return reduce(DataFrame.union, [rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")
                                    for rows in (plain, halves.select(*plain.columns))])


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int) -> DataFrame:
    """doc_id, k, fp, root (the smallest fingerprint that the row's one reaches), component_id."""
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(classes.select("fp"), max_bits), "a", "b")
    of = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    # written, so that a large component's rows can be split in the join
    least = written(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = of.join(least, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                   max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id it reaches)."""
    return _grouped(docs, id_col, text_col, width, max_bits).select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                  max_bits: int = 3) -> DataFrame:
    """The documents with one kept per group: that with the smallest id (a null id comes
    last), of several rows with that id the one with the smallest text hash."""
    rows = _grouped(docs, id_col, text_col, width, max_bits).groupBy("root", "doc_id", "k").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k")
    first = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "k", "rows"), order).alias("r"))
    first = written(first.select("r.*"), "first")
    # the caller's row is one column, so no name of his meets one of ours
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                      F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("own_k"))

    def kept(keep: DataFrame) -> DataFrame:
        return own.join(keep, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own_k") == F.col("k")), "left_semi")

    rows = kept(first.where("rows = 1")).unionByName(kept(first.where("rows > 1")).dropDuplicates(["id", "own_k"]))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
