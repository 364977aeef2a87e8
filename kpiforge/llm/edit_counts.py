"""Token counts that follow edits.

A document's text is cut into leaves at places where the pre-tokenizer always cuts
(before a space after other than white space), about ``LEAF`` characters apart.  Two
heaps hold the sums of characters and of tokens over the leaves: node i has the
children 2i and 2i+1, the root is node 1.  An edit goes down the character sums to the
leaves it touches; they are encoded anew together with one leaf on either side, whose
outer ends the edit can't move, and the sums above them change.  Nothing else is read
or encoded again.  Leaves that would hold more than twice ``LEAF`` characters are cut
again, and the sums of the others are put into new heaps without being encoded.

Edits of a document apply one after another, each to the text that the one before it
left: ``(at, removed, inserted)`` in characters; what lies beyond the text's end is
clipped.  Defined cases: null text counts as empty; null or no edits leave the counts;
equal ids are edited each for itself; an empty table gives no rows;
very long texts are one row in one task; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import rows_of
from kpiforge.llm.tokens import encoder

LEAF = 256
_CUT = re.compile(r"(?<=\S) ")
EDITS = "array<struct<at: bigint, removed: bigint, inserted: string>>"


def cut_leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Pieces of a text whose token counts add up to that of the text."""
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + leaf)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


def _heaps(*leaves: np.ndarray) -> list[np.ndarray]:
    """For each array of figures per leaf the heap of their sums."""
    width = 1 << max(len(leaves[0]) - 1, 0).bit_length()
    out = []
    for figures in leaves:
        heap = np.zeros(2 * width, np.int64)
        heap[width : width + len(figures)] = figures
        at = width
        while at > 1:
            heap[at // 2 : at] = heap[at : 2 * at : 2] + heap[at + 1 : 2 * at : 2]
            at //= 2
        out.append(heap)
    return out


class CountTree:
    """The two heaps over a document's leaves; ``count`` gives a text's tokens."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2
        self.encoded = 0  # characters encoded by edits

    @classmethod
    def build(cls, text: str, count) -> CountTree:
        leaves = cut_leaves(text)
        return cls(*_heaps(np.array([len(x) for x in leaves], np.int64), np.array([count(x) for x in leaves], np.int64)))

    def replace(self, first: int, last: int, leaves: list[str], count) -> None:
        """Put any number of leaves in the place of some: the others keep their counts, and
        the heaps over them are added up again."""
        own = np.array([len(x) for x in leaves], np.int64), np.array([count(x) for x in leaves], np.int64)
        flat = [np.concatenate([heap[self.width : self.width + first], new, heap[self.width + last + 1 :]])
                for heap, new in zip((self.chars, self.tokens), own, strict=True)]
        there = flat[0] > 0
        self.chars, self.tokens = _heaps(flat[0][there], flat[1][there])
        self.width = len(self.chars) // 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, text: str, at: int, removed: int, inserted: str, count) -> str:
        """Apply one edit; gives the new text."""
        at = min(max(at, 0), len(text))
        end = min(at + max(removed, 0), len(text))
        new = text[:at] + inserted + text[end:]
        first, start = self.find(max(at - 1, 0))
        last, last_start = self.find(end)
        # one leaf of context on either side; leaves without text hold no boundary
        while start > 0:
            first, start = self.find(start - 1)
            if start == 0 or at - start > LEAF // 2:
                break
        stop = last_start + int(self.chars[self.width + last])
        if stop < len(text):
            last, last_start = self.find(stop)
            stop = last_start + int(self.chars[self.width + last])
        region = new[start : stop + len(inserted) - (end - at)]
        self.encoded += len(region)
        slots = last - first + 1
        if len(region) > 2 * LEAF * slots:  # more text than the leaves there can hold
            self.replace(first, last, cut_leaves(region), count)
            return new
        leaves = cut_leaves(region, max(LEAF, -(-len(region) // slots)))
        for i in range(slots):
            piece = leaves[i] if i < slots - 1 and i < len(leaves) else "".join(leaves[i:]) if i == slots - 1 else ""
            self.put(first + i, len(piece), count(piece))
        return new


def pii_edits(text: Column) -> Column:
    """Edits that put a mark in the place of every e-mail address and every run of
    nine digits or more (blanks, dots, dashes and brackets between them): an example
    of an edit stream, from the last to the first, so places hold in the given text."""

    @F.pandas_udf(EDITS)
    def found(texts):
        import pandas as pd

        pattern = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d(?:[ ().-]{0,2}\d){8,}")
        return pd.Series([[{"at": m.start(), "removed": m.end() - m.start(), "inserted": "[mail]" if "@" in m[0] else "[number]"}
                           for m in pattern.finditer(t or "")][::-1] for t in texts])

    return found(text)


def edited_counts(docs: DataFrame, tokenizer: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text",
                  with_trees: bool = False) -> DataFrame:
    """Per row: doc_id, n_edits, tokens_before, tokens_after, n_chars (after),
    chars_encoded (by the edits), n_leaves, and the heaps and the new text if
    ``with_trees`` (``chars``, ``tokens``, ``text``), to be kept for later edits:
    a row that has the heaps already, in columns ``chars`` and ``tokens`` of arrays, is edited
    without being encoded; columns of these names with other types are ignored."""
    kept = [c for c in ("chars", "tokens") if with_trees and dict(docs.dtypes).get(c) == "array<bigint>"]
    kept = kept if len(kept) == 2 else []
    names = ["doc_id", "n_edits", "tokens_before", "tokens_after", "n_chars", "chars_encoded", "n_leaves"]
    names += ["chars", "tokens", "text"] * with_trees

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)

        def count(text: str) -> int:
            return len(enc.encode(text)) // 4

        for batch in batches:
            rows = []
            for _, text, edits, *heaps in rows_of(batch):
                text = text or ""
                chars, tokens = heaps or (None, None)
                tree = CountTree(np.array(chars), np.array(tokens)) if chars else CountTree.build(text, count)
                before = int(tree.tokens[1]) if tree.width > 1 else int(tree.tokens[-1])
                for e in edits or []:
                    text = tree.edit(text, e["at"], e["removed"], e["inserted"] or "", count)
                root = min(1, len(tree.tokens) - 1)
                row = (len(edits or []), before, int(tree.tokens[root]), len(text), tree.encoded, int((tree.chars[tree.width :] > 0).sum()))
                rows.append((*row, tree.chars, tree.tokens, text) if with_trees else row)
            types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()] * with_trees
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} bigint" for n in names[1:7])
    schema += ", chars array<bigint>, tokens array<bigint>, text string" * with_trees
    return docs.select(id_col, text_col, edits_col, *kept).mapInArrow(run, schema)
