"""Periodic runs of words by maximal pairs.

A run is a stretch of words with smallest period q, at least ``min_length`` words and
``exponent`` periods long, that no neighbouring word extends.  The words at a run's
start and one period later begin a *maximal pair*: they agree for length - q words,
and the words before and behind the two copies differ.  The other way round, a maximal
pair at distance q that agrees for (exponent - 1) * q words or more is a stretch of
period q that can't be extended, so the pairs are the runs; of pairs with the same start
and end the smallest distance is the period.

The pairs come from the LCP-interval tree of the suffix array, bottom up.  A node holds
the places of its suffixes in order, in blocks of equal left word.  Where children meet
in a node of depth d, each place of the smaller one looks at the places of the larger one
no further than d / (exponent - 1) away, and steps over a block with its own left word as
a whole: every other place it sees is a maximal pair.  The smaller one is then merged into
the larger one, so n places are moved n log n times at most, and the pairs are no more
than the periods that all runs hold.

Nodes less than ``gram`` words deep have no such pair, and a run lies in a stretch of
places whose ``gram`` words occur again in that stretch; so the array is built over those
stretches only, each ended by a word of its own, for many documents at once.

Defined cases: null and empty texts have no words and no runs; a text is one row in one
task whatever its length, in memory of a few machine words a word; equal rows and ids are
rows of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from kpiforge.llm.common import rows_of

#: Words that are indexed at once (a longer text is indexed alone).
CHUNK = 1 << 18


def gram_length(min_length: int, exponent: int) -> int:
    """Words that two copies of a run's period share at least, and so many that the places
    whose words occur again are without a gap from one copy to the other."""
    return min(max(min_length - q, (exponent - 1) * q) - q + 1 for q in range(1, min_length + 1))


def _again(keys: np.ndarray) -> np.ndarray:
    """Where a value occurs more than once."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


def stretches(words: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in words) of the stretches that can hold a run.  Hashes decide, so
    a stretch may be too many or too long, which costs work and changes nothing."""
    n = len(words) - gram + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    unit = words.astype(np.uint64)
    for i in range(gram):
        key = _mixed(key + unit[i : i + n] + np.uint64(1))
    at = np.flatnonzero(_again(key))
    for _ in range(4):  # words that occur again, then those that do in their own stretch
        if not len(at):
            break
        stretch = np.cumsum(np.concatenate([[0], np.diff(at) > 1])).astype(np.uint64)
        keep = _again(_mixed(key[at] + stretch * np.uint64(0x9E3779B97F4A7C15)))
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return at, at
    first = np.concatenate([[True], np.diff(at) > 1])
    last = np.concatenate([first[1:], [True]])
    return at[first], at[last] + gram


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` in order, and how many words each shares with the next one
    (0 for the last), by doubling the length that the ranks compare."""
    n = len(text)
    rank = np.append(np.unique(text, return_inverse=True)[1].astype(np.int64), -1)
    ranks, step = [rank], 1
    while True:
        key = rank[:n] * (n + 1) + rank[np.minimum(np.arange(n) + step, n)] + 1
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        ranks.append(rank)
        step *= 2
    a, b, shared = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        shared += (ranks[k][a + shared] == ranks[k][b + shared]).astype(np.int64) << k
    return order, np.append(shared, 0)


class Places:
    """The places of a node's suffixes in order, with the first ones of each block of
    neighbours that have the same left word."""

    __slots__ = ("at", "heads")

    def __init__(self, place: int):
        self.at, self.heads = [place], [place]

    def meet(self, place: int, depth: int, reach: int, left: list[int], out: list) -> None:
        """Append the maximal pairs of ``place`` with these places, ``reach`` away at most."""
        at, heads, own = self.at, self.heads, left[place]
        here = bisect_left(at, place)
        k, low = here - 1, place - reach
        while k >= 0 and at[k] >= low:
            if left[at[k]] == own:
                k = bisect_left(at, heads[bisect_right(heads, at[k]) - 1]) - 1
            else:
                out.append((at[k], place, depth))
                k -= 1
        k, high = here, place + reach
        while k < len(at) and at[k] <= high:
            if left[at[k]] == own:
                block = bisect_right(heads, at[k])
                if block == len(heads):
                    break
                k = bisect_left(at, heads[block])
            else:
                out.append((place, at[k], depth))
                k += 1

    def add(self, place: int, left: list[int]) -> None:
        at, heads, own = self.at, self.heads, left[place]
        here = bisect_left(at, place)
        before = left[at[here - 1]] if here else None
        if here < len(at):
            after = left[at[here]]
            if after == own and after != before:
                heads.pop(bisect_left(heads, at[here]))
            elif after != own and after == before:
                insort(heads, at[here])
        if before != own:
            insort(heads, place)
        at.insert(here, place)


def maximal_pairs(order: list[int], shared: list[int], left: list[int], least: int, periods: int) -> list[tuple[int, int, int]]:
    """(i, j, depth): i < j, the words from i and j on agree for ``depth`` words and no
    further, the words before them differ, and (j - i) * periods <= depth.  Nodes of the
    tree that are less than ``least`` deep are left out."""
    out: list[tuple[int, int, int]] = []
    open_nodes: list[tuple[int, Places]] = []

    def merged(a: Places, b: Places, depth: int) -> Places:
        if len(a.at) < len(b.at):
            a, b = b, a
        reach = depth // periods
        for place in b.at:
            a.meet(place, depth, reach, left, out)
        for place in b.at:
            a.add(place, left)
        return a

    for place, depth in zip(order, shared, strict=True):
        node = Places(place)
        while open_nodes and open_nodes[-1][0] > depth:
            below, other = open_nodes.pop()
            node = merged(other, node, below)
        if depth < least:
            continue
        if open_nodes and open_nodes[-1][0] == depth:
            node = merged(open_nodes.pop()[1], node, depth)
        open_nodes.append((depth, node))
    return out


def runs_of(words: np.ndarray, min_length: int = 6, exponent: int = 4) -> np.ndarray:
    """The runs of a sequence of word numbers: rows (start, length, period) by start, then
    period."""
    gram = gram_length(min_length, exponent)
    starts, ends = stretches(words, gram)
    none = np.zeros((0, 3), np.int64)
    if not len(starts):
        return none
    size = ends - starts + 1  # a word of its own ends each stretch
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    source = np.arange(int(size.sum())) - np.repeat(begin - starts, size)
    stop = begin + size - 1
    text = words[np.minimum(source, len(words) - 1)]
    text[stop] = int(words.max()) + 1 + np.arange(len(stop))
    left = np.where(source > 0, words[np.maximum(source - 1, 0)], -1)
    left[stop] = text[stop]
    order, shared = suffix_array(text)
    found = maximal_pairs(order.tolist(), shared.tolist(), left.tolist(), gram, exponent - 1)
    if not found:
        return none
    i, j, depth = np.array(found, np.int64).T
    start, period = source[i], j - i
    length = depth + period
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) & (length >= min_length)
    rows = np.stack([start, length, period], 1)[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _chunk_runs(texts: list[list[bytes]], min_length: int, exponent: int) -> list[np.ndarray]:
    """The runs of each text's words."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(t) for t in texts])
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    # a word counts as another one in every document, so nothing agrees across documents
    words = words * len(texts) + np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    runs = runs_of(words, min_length, exponent)
    of = np.searchsorted(ends, runs[:, 0], "right")
    runs[:, 0] -= (ends - sizes)[of]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, each run without what follows its first period."""
    if not len(runs):
        return b" ".join(words)
    out, at = [], 0
    starts, ends = runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1]
    by = np.argsort(starts)
    for a, b in zip(starts[by].tolist(), ends[by].tolist()):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return b" ".join(out + words[at:])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                  exponent: int = 4) -> DataFrame:
    """Per row: id, n_words, runs (array of start, length and period, by start, then
    period) and collapsed (the words outside the repetitions, joined by one space)."""
    if min_length < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    kind = docs.schema[id_col].dataType

    def run(batches):
        import pyarrow as pa

        id_type = to_arrow_type(kind)
        run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

        def rows(ids, texts):
            found = _chunk_runs(texts, min_length, exponent)
            flat = np.concatenate(found)
            ends = np.cumsum([0] + [len(r) for r in found]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(flat.T)], ["start", "length", "period"])
            kept = pa.array([collapse(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), values).cast(run_type), kept], ["id", "n_words", "runs", "collapsed"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in rows_of(batch):
                words = (text or "").encode().split()  # of bytes: the six white-space bytes
                ids.append(doc)
                texts.append(words)
                size += len(words)
                if size >= CHUNK or len(ids) >= 4096:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
