"""Quality rules with the document frequency of lines per host.

Every normalised line (A-Z lower-cased, white space collapsed) is hashed; a line
on more than ``max_docs`` distinct documents of a host, and there between more than
``max_docs`` distinct pairs of neighbouring lines, is boilerplate and goes.
Documents with equal texts are one document here, and near-copies share their lines'
neighbours, so that copies of a text don't make its lines boilerplate.  The neighbours
are the lines before and after that have a word; a text's ends stand for missing ones.  A document that loses lines and keeps fewer than
``min_words`` words, or less than ``min_left`` of them, is depleted and rejected,
as is one that fails the base rules.

Line counts are combined per task before they are shuffled; the lines of a host
that holds a third of all rows are spread by their hashes.  Defined cases: null
text has no words and fails the base rules; null hosts form one host of their own;
repeated rows get equal verdicts; an empty table gives no rows;
very long texts are one row in one task; extra columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import rows_of, written

SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\v\f\r"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    code = ids[:n]
    for i in range(1, width):  # numbered anew at each step, so that codes never overflow
        code = code * len(numbers) + ids[i : n + i]
        if i < width - 1 and len(numbers) > 1 << 20:
            code = np.unique(code, return_inverse=True)[1]
    _, of, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[of] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : n + i] |= twice
    return int(covered.sum())


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: id, host, tx (MD5 of the text), the base figures, and each distinct
    normalised line as (hash, words in all its places)."""
    id_type = dict(docs.dtypes)[id_col]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows, hashes, pairs, sizes, ends, keys = [], [], [], [], [0], []
            for _, _, text in rows_of(batch):
                text = text or ""
                data = text.encode()
                words = data.split()
                seen, lines, again, order = set(), {}, 0, []
                for line in data.split(b"\n"):
                    if parts := line.lower().split():
                        again += line in seen
                        seen.add(line)
                        order.append((xxh3_64_intdigest(b" ".join(parts)), len(parts)))
                near = [b"", *[h.to_bytes(8) for h, _ in order], b""]
                for i, (h, n) in enumerate(order):
                    key = h, xxh3_64_intdigest(near[i] + b"\n" + near[i + 2])
                    lines[key] = lines.get(key, 0) + n
                rows.append((len(words), len(text) - sum(map(text.count, SPACE)),
                             len(data) - len(data.translate(None, SYMBOLS)), again, repeated_words(words)))
                hashes.extend(h for h, _ in lines)
                pairs.extend(c for _, c in lines)
                sizes.extend(lines.values())
                ends.append(len(hashes))
                keys.append(hashlib.md5(data, usedforsecurity=False).digest())
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [*[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hashes, pairs)], pa.array(sizes, pa.int64())],
                ["h", "pair", "words"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), *[pa.array(c, pa.int64()) for c in cols], lines],
                ["id", "host", "tx", *counts, "lines"])

    host = F.concat(F.lit("="), F.col(host_col).cast("string"))  # a null host sorts before every "="
    return docs.select(id_col, F.coalesce(host, F.lit("")).alias("host"), text_col).mapInArrow(
        run, f"id {id_type}, host string, tx binary, {', '.join(f'{c} bigint' for c in counts)}, "
             "lines array<struct<h: bigint, pair: bigint, words: bigint>>")


def _frequent(measured: DataFrame, max_docs: int) -> DataFrame:
    """(host, tx, h, words) of the boilerplate lines of every distinct text, a row per pair of neighbours."""
    lines = measured.select("host", "tx", F.explode("lines").alias("l")).select("host", "tx", "l.*").distinct()
    lines = written(lines, "lines")
    often = (lines.groupBy("host", "h").agg(F.count_distinct("tx").alias("docs"), F.count_distinct("pair").alias("pairs"))
             .where((F.col("docs") > max_docs) & (F.col("pairs") > max_docs)))
    return lines.join(written(often.select("host", "h"), "often"), ["host", "h"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10,
          min_words: int = 50, min_left: float = 0.5) -> DataFrame:
    """Per row: id, host, tx, the base figures, n_line_words (words in removed
    lines), base_failed, kept, and ``gone``, the hashes of the removed lines."""
    measured = written(_measured(docs, id_col, text_col, host_col), "measured")
    gone = _frequent(measured, max_docs).groupBy("host", "tx").agg(
        F.sum("words").alias("n_line_words"), F.collect_set("h").alias("gone"))
    gone = written(gone, "gone")
    both = measured.drop("lines").join(gone, ["host", "tx"], "left").withColumn(
        "n_line_words", F.coalesce("n_line_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (F.col("n_line_words") > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return both.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised hash is in ``gone``."""

    @F.pandas_udf("string")
    def cut(texts, hashes):
        from xxhash import xxh3_64_intdigest

        def one(text, drop):
            if text is None or drop is None or not len(drop):
                return text
            drop = {int(h) & (1 << 64) - 1 for h in drop}
            return "\n".join(x for x in text.split("\n") if not (
                (w := x.encode().lower().split()) and xxh3_64_intdigest(b" ".join(w)) in drop))

        return texts.combine(hashes, one)

    return cut(text, gone)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   chars_col: str = "n_chars", **limits) -> DataFrame:
    """The documents that stay, without their boilerplate lines, with the columns of ``docs``."""
    verdict = judge(docs, id_col, text_col, host_col, **limits).where("kept")
    # equal host and text give equal verdicts, so rows that share an id keep apart
    verdict = verdict.groupBy("host", "tx").agg(F.first("gone").alias("gone"))
    verdict = written(verdict, "verdict")  # a plain table: many copies of one text can be split in the join
    # the caller's row is one column, so no name of his meets one of ours
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit("")).alias("host"),
                      F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("tx"))
    both = own.join(verdict, ["host", "tx"])
    changed, text = F.col("gone").isNotNull(), F.col("row")[text_col]
    both = both.select("row", changed.alias("changed"), F.when(changed, without_lines(text, F.col("gone"))).otherwise(text).alias("text"))

    def column(c: str, kind: str) -> Column:
        given = F.col("row")[c]
        if c == text_col:
            return F.col("text").alias(c)
        return F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(given).alias(c) if c == chars_col else given.alias(c)

    return both.select(*[column(c, kind) for c, kind in docs.dtypes])
