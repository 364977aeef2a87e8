"""Threshold-scaled sketches of documents.

A text's sketch holds every hash of its ``width``-word shingles that is below a fixed
fraction of the hash range.  Whether a shingle is kept depends on the shingle alone, so
the sketch of several texts together is the union of their sketches, sketches of texts of
very different length can be compared, and containment and likeness are ratios of counts:
of the kept shingles of one text, how many does the other have.

A text with words but no hash below the limit is stood for by its smallest hash, so that
equal short texts compare as equal; in a union it goes where another text has one below.
A text without words has an empty sketch: likeness 1 with another empty one, else 0.

Defined cases: null text is empty; words are runs of other than ASCII white space, taken as
they are; texts of fewer than ``width`` words are one shingle; repeated shingles count
once; very long texts are hashed whole, in memory of a few machine words a word; equal
texts have equal sketches; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One hash in so many is kept.
SCALE = 8
WIDTH = 5


def limit(scale: int) -> int:
    """The largest hash that is kept."""
    return ((1 << 64) - 1) // scale


def text_sketch(text: str | None, scale: int = SCALE, width: int = WIDTH) -> np.ndarray:
    """The kept hashes of a text's shingles, ascending (unsigned)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().split()  # of bytes: the six white-space bytes
    unit = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - width + 1, min(len(words), 1))
    key = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        key = (key ^ unit[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(31)
    kept = np.unique(key[key <= np.uint64(limit(scale))])
    return kept if len(kept) or not n else key.min(keepdims=True)


def sketch(text: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """The sketch of a text column as an ascending array of BIGINT (the hash less 2^63)."""

    @F.arrow_udf("array<bigint>")
    def made(texts):
        import pyarrow as pa

        parts = [text_sketch(t.as_py(), scale, width) for t in texts]
        ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
        flat = (np.concatenate([np.zeros(0, np.uint64), *parts]) ^ np.uint64(1 << 63)).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return made(text)


def _low(a: Column, scale: int) -> Column:
    """The hashes below the limit."""
    return F.filter(a, lambda h: h <= F.lit(limit(scale) - (1 << 63)))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together."""
    both = F.array_sort(F.array_union(a, b))
    low = _low(both, scale)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """The share of the first text's shingles that the second one has (0 to 1), estimated
    from the sketches; 1 for a text without words."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Shingles in both texts by shingles in either (0 to 1), estimated from the sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(a: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits a hash, ascending, nothing between them."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h.bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """id, text, next_text: each row with the text of the next one by id (nulls first; equal
    ids by their text's hash), the last one with the first one's.

    The ids are dealt into ranges, and each range's first row goes to the range before it
    as well, so that every row meets the next one in its own range: one shuffle of the
    texts.  The driver receives the first key of each range.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    keys = rows.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("r")).agg(F.min("key").alias("key"))
    first = [r["key"] for r in keys.orderBy("r").collect()]  # one row per range
    if not first:
        return rows.select("key.id", "text", F.col("text").alias("next_text"))
    kind = rows.schema["key"].dataType
    start = F.array(*[F.struct(F.lit(k["id"]).cast(kind["id"].dataType).alias("id"), F.lit(k["h"]).cast("bigint").alias("h")) for k in first])
    steps = F.array(*[F.lit(1 << b) for b in range(len(first).bit_length() - 1, -1, -1)])
    # the last range that starts at the key or before it
    rows = rows.withColumn("range", F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s < len(first)) & (F.get(start, at + s) <= F.col("key")), at + s).otherwise(at)))
    ahead = F.struct(F.pmod(F.col("range") - 1, F.lit(len(first))).alias("range"), F.lit(1).alias("ahead"))
    own = F.struct(F.col("range"), F.lit(0).alias("ahead"))
    is_first = F.get(start, F.col("range")) == F.col("key")
    rows = rows.select("key", "text", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    over = Window.partitionBy("to.range").orderBy("to.ahead", "key")
    met = rows.withColumn("next_text", F.lead("text").over(over)).where("to.ahead = 0")
    return met.select("key.id", "text", "next_text")
