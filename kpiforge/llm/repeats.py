"""Removal of repeated byte strings with a run-length Burrows-Wheeler index.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else in the corpus.  The corpus is dealt out so that equal strings meet:

1. Every window of ``length`` bytes picks the smallest hash of the ``gram``-byte
   strings in it, the leftmost of equals.  Equal windows pick equal anchors.
   Windows next to each other that pick the same place form a segment; about one
   byte in ``(length - gram) / 2`` starts one, and a segment is a row of hashes
   without its text.
2. Anchors that occur once are done.  A segment that has a copy is repeated as a
   whole, however many copies there are; one of each kind goes on.
3. The kinds of an anchor are indexed with their text, whole anchors together until
   an index is full: a Burrows-Wheeler transform as runs with sampled ends.  Every
   text is streamed through it from its end, a step over the runs for each byte; that
   gives the matching statistics, and matches of ``length`` bytes or more are marked.
4. An anchor of more than ``group_segments`` kinds is dealt anew by more of its windows:
   a segment is cut by how many bytes its windows have before the anchor, and a piece
   goes to the hash of all that such windows have in common.  Ranges are halved, and
   those bytes grow (124 of 200 first), until no key is crowded; a key of single windows
   holds one kind.  Then 2 and 3 again, so there is one way for every size.

Every step is exact up to collisions of 128 hash bits; step 1 only decides what
meets.  Defined cases: null text counts as empty; texts under ``length`` bytes
never match; equal rows are copies of each other; rows with equal ids and other
texts are separate documents; an empty table gives no rows;
very long texts are cut into segments, in one task only while they are hashed and put together; extra columns are ignored or kept as named.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kpiforge.llm.common import rows_of, run_bounds, sorted_runs, worker_state, written

#: Windows hashed at once: the arrays stay in the processor's cache.
SPAN = 1 << 16
#: Bytes of segment text that one index holds (more if one anchor has more): its arrays
#: stay in the processor's cache.
INDEX_BYTES = 1 << 17
#: Kinds of segments of one anchor that are indexed together; beyond it the anchor is dealt anew by more bytes.
GROUP_SEGMENTS = 256

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and the powers of an odd base and of its inverse."""
    state = worker_state()
    if "gram_tables" not in state:
        base = 0x9E3779B97F4A7C15
        size = SPAN + (1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        state["gram_tables"] = (_mixed(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F)), *both)
    return state["gram_tables"]


def segments(data: bytes, length: int = 200, gram: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and the anchor's place of each segment of a text."""
    n, places = len(data) - length + 1, length - gram + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(_U), none, none, none
    values, powers, inverse = _tables()
    raw = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, n, SPAN):
        part = raw[at : min(at + SPAN, n) + length - 1]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
        hashes = _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        least = (hashes & ~_U((1 << 17) - 1)) | np.arange(len(hashes), dtype=_U)  # ties: the leftmost
        width = 1
        while 2 * width <= places:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < places:
            least = np.minimum(least[: len(least) - (places - width)], least[places - width :])
        place = (least & _U((1 << 17) - 1)).astype(np.int64)
        starts, ends = run_bounds(place)
        out.append((hashes[place[starts]], starts + at, ends - starts, place[starts] + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class RunIndex:
    """A Burrows-Wheeler transform over several texts, kept as its runs.

    A run has a letter, a length, the suffix positions sampled at its two ends, and
    ``jump``, the match of its first suffix with the last one of the run before it that
    has the same letter, that letter included.  Matches don't cross texts: each text has
    an end of its own.  The suffix array is used to build the runs and isn't kept.
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        many, n = len(texts), len(raw)
        if n + many >= 1 << 21:
            raise ValueError("an index holds less than 2 MB")
        stops = np.cumsum(self.sizes)
        ends = np.repeat(stops, self.sizes)
        order = _suffix_order(raw, ends)
        # the suffixes in order: first the empty one of every text, then the others
        place = np.concatenate([stops, order])
        left = np.concatenate([np.zeros(many, np.int64), ends[order] - order])
        letter = np.full(many + n, -1, np.int16)  # -1: nothing before it, a text starts
        inner = np.concatenate([self.sizes > 0, ~np.isin(order, stops - self.sizes)]) if many else np.zeros(0, bool)
        letter[inner] = raw[place[inner] - 1]
        self.heads, tails = run_bounds(letter) if many else (np.zeros(0, np.int64),) * 2
        self.lengths = tails - self.heads
        self.letters = letter[self.heads]
        self.first, self.last = place[self.heads], place[tails - 1]  # the sampled ends
        # where a run's first suffix goes with its letter put before it
        by_letter = np.argsort(self.letters, kind="stable")
        self.step = np.zeros(len(self.heads), np.int64)
        self.step[by_letter] = np.cumsum(self.lengths[by_letter]) - self.lengths[by_letter]
        after = by_letter[1:][self.letters[by_letter[1:]] == self.letters[by_letter[:-1]]]
        before = by_letter[:-1][self.letters[by_letter[1:]] == self.letters[by_letter[:-1]]]
        self.jump = np.zeros(len(self.heads), np.int64)
        self.jump[after] = 1 + _common(raw, self.last[before], self.first[after],
                                       np.minimum(left[tails[before] - 1], left[self.heads[after]]))
        self.jump_down = np.zeros(len(self.heads), np.int64)
        self.jump_down[before] = self.jump[after]

    def matching_statistics(self) -> np.ndarray:
        """For every position the length of its longest match elsewhere.

        All texts are streamed from their ends, a byte of each at a time.  A step goes
        from a suffix's row to that of the suffix a byte longer.  Inside a run the
        neighbours in suffix order take the same step, so their matches get a byte longer;
        at a run's end the match is that with the sampled end of the nearest run of the letter.
        """
        out = np.zeros(int(self.sizes.sum()), np.int64)
        row = np.arange(len(self.sizes))  # of the empty suffixes
        place = np.cumsum(self.sizes)
        start = place - self.sizes
        up, down = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        while True:
            going = place > start
            if not going.all():
                row, place, start, up, down = row[going], place[going], start[going], up[going], down[going]
            if not len(row):
                return out
            run = np.searchsorted(self.heads, row, "right") - 1
            at = row - self.heads[run]
            up = np.where(at == 0, self.jump[run], up + 1)
            down = np.where(at == self.lengths[run] - 1, self.jump_down[run], down + 1)
            row, place = self.step[run] + at, place - 1
            out[place] = np.maximum(up, down)

    def spans(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, start and size of the maximal stretches under matches of ``least`` bytes or more."""
        match = self.matching_statistics()
        n = len(match)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        place = np.arange(n)
        covered = np.maximum.accumulate(np.where(match >= least, place + match, 0)) > place
        first = np.zeros(n, bool)
        first[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = True
        inner = covered[1:] & covered[:-1] & ~first[1:]  # goes on from the position before
        starts = np.flatnonzero(covered & np.concatenate([[True], ~inner]))
        stops = np.flatnonzero(covered & np.concatenate([~inner, [True]])) + 1
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[starts]
        return owner, starts - (np.cumsum(self.sizes) - self.sizes)[owner], stops - starts


def _suffix_order(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of texts that end at ``ends`` in order; equal ones in the texts' order."""
    n = len(raw)
    # rank by the first five bytes, then by twice as many; 0 stands after a text's end.  A rank is the
    # first row of its class in suffix order; sorting takes in only classes of several suffixes, and
    # the place in the low bits of a key keeps equal suffixes in the texts' order
    place = np.arange(n)
    if not n:
        return place
    key = np.zeros(n, np.int64)
    for i in range(5):
        rest = max(n - i, 0)
        key *= 257
        key[:rest] += np.where(place[:rest] + i < ends[:rest], raw[n - rest :].astype(np.int64) + 1, 0)
    low_bits = (1 << 21) - 1
    order = place.copy()
    rank = np.zeros(n + 1, np.int32)
    rows, active, depth = place, place, 5
    longest = int((ends - place).max())
    while True:
        key = np.sort(key << 21 | active)
        active = key & low_bits
        key >>= 21
        order[rows] = active
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(key)]]))
        rank[active] = np.repeat(rows[heads], sizes) + 1
        several = np.repeat(sizes > 1, sizes)
        rows, active = rows[several], active[several]
        if depth >= longest or not len(active):
            return order
        after = active + depth
        key = rank[active].astype(np.int64) << 21 | np.where(after < ends[active], rank[np.minimum(after, n)], 0)
        depth *= 2


def _common(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the places a and b have in common, at most ``most``."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(_U)
    word = np.zeros(len(raw) + 1, _U)  # the eight bytes from each place on
    for i in range(8):
        word |= padded[i : i + len(word)] << _U(8 * i)
    size = np.zeros(len(a), np.int64)
    going = np.flatnonzero(most > 0)
    while len(going):
        differ = word[a[going] + size[going]] ^ word[b[going] + size[going]]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + _U(1))) - _U(1)) >> 3).astype(np.int64)
        size[going] += same
        going = going[(same == 8) & (size[going] < most[going])]
    return np.minimum(size, most)


def _key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _segment_rows(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """anchor, seg (hash of the segment's bytes), id, k (hash of the text), start, size, and
    ahead, the bytes of the first window before the anchor."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        names = ["anchor", "seg", "id", "k", "start", "size", "ahead"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, (_, text) in enumerate(rows_of(batch)):
                data = (text or "").encode()
                anchors, starts, counts, places = segments(data, length, gram)
                if not len(starts):
                    continue
                sizes = counts + length - 1
                cols[0].append(anchors.view(np.int64))
                cols[1].append(np.array([xxh64_intdigest(data[a:b], 7) for a, b in zip(
                    starts.tolist(), (starts + sizes).tolist(), strict=True)], _U).view(np.int64))
                cols[2].append(np.full(len(starts), i))
                cols[3].append(np.full(len(starts), np.array(xxh64_intdigest(data, 42), _U).view(np.int64)))
                cols[4].append(starts)
                cols[5].append(sizes.astype(np.int32))
                cols[6].append((places - starts).astype(np.int32))
            if cols[0]:
                got = [np.concatenate(c) for c in cols]
                ids = batch.column(0).take(pa.array(got[2]))
                yield pa.RecordBatch.from_arrays([ids if n == "id" else pa.array(g) for n, g in zip(names, got, strict=True)], names)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"anchor bigint, seg bigint, id {id_type}, k bigint, start bigint, size int, ahead int")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The wanted segments with their bytes: anchor, id, k, start, size, ahead, bytes."""
    lists = wanted.groupBy("id", "k").agg(F.collect_set(F.struct("anchor", "start", "size", "ahead")).alias("parts"))
    texts = docs.select(F.col(id_col).alias("own_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("data"),
                        _key(text_col).alias("own_k"))
    both = texts.join(lists, texts["own_id"].eqNullSafe(lists["id"]) & (F.col("own_k") == F.col("k")))
    # rows with equal id and text are one here
    return both.select("id", "k", "data", F.explode("parts").alias("p")).select(
        F.col("p.anchor").alias("anchor"), "id", "k", F.col("p.start").alias("start"), F.col("p.size").alias("size"),
        F.col("p.ahead").alias("ahead"), F.expr("substring(data, cast(p.start + 1 as int), p.size)").alias("bytes"))


def _indexed(texts: DataFrame, id_type: str, length: int) -> DataFrame:
    """Spans under long matches, found by one run index per INDEX_BYTES of segments."""
    arrow_id = to_arrow_type(texts.schema["id"].dataType)

    def run(batches):
        import pyarrow as pa

        for part in sorted_runs(batches, "anchor"):
            # equal rows of the table give equal segments: one is enough
            once = list({(a, x): i for i, (a, x) in enumerate(zip(part["anchor"].tolist(), part["bytes"], strict=True))}.values())
            part = {n: v[once] for n, v in part.items()}
            starts, ends = run_bounds(part["anchor"])
            sizes = np.add.reduceat(np.array([len(x) for x in part["bytes"]]), starts)
            at = 0
            while at < len(starts):  # whole anchors until the index is full
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), INDEX_BYTES)) + at)
                lo, hi = starts[at], ends[stop - 1]
                at = stop
                if hi - lo < 2:
                    continue
                owner, begin, size = RunIndex(list(part["bytes"][lo:hi])).spans(length)
                if len(owner):
                    owner = owner + lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["id"][owner].tolist(), arrow_id), pa.array(part["k"][owner]), pa.array(part["start"][owner] + begin),
                         pa.array(size.astype(np.int32))], ["id", "k", "start", "size"])

    return (texts.select("anchor", "id", "k", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(run, f"id {id_type}, k bigint, start bigint, size int"))


def _dealt(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Segments cut where the bytes of a window before the anchor pass a multiple of
    ``width``, under the hash of all bytes that the windows of such a piece have in common
    whatever their segment: the anchor with ``length - gram - width + 1`` bytes around it."""
    piece = F.explode(F.expr(f"sequence((ahead - size + {length}) div {width}, ahead div {width})")).alias("part")
    cut = texts.select("anchor", "id", "k", "start", "size", "ahead", "bytes", piece)
    cut = (cut.withColumn("skip", F.expr(f"cast(greatest(ahead - (part + 1) * {width} + 1, 0) as int)"))
           .withColumn("windows", F.expr(f"cast(least(ahead - part * {width}, size - {length}) - skip + 1 as int)"))
           .withColumn("core", F.expr(f"substring(bytes, cast(ahead - part * {width} + 1 as int), {length - width + 1})")))
    cut = cut.select(F.xxhash64("core", "anchor", "part").alias("anchor"), "id", "k", (F.col("start") + F.col("skip")).alias("start"),
                     (F.col("windows") + length - 1).alias("size"), (F.col("ahead") - F.col("skip")).alias("ahead"),
                     F.expr(f"substring(bytes, skip + 1, windows + {length - 1})").alias("bytes"))
    return cut.withColumn("seg", F.xxhash64("bytes"))


def _settled(rows: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Spans of the segments that have a copy; one segment of each kind where an anchor has
    several kinds; the anchors that have more than ``most`` kinds."""
    anchors = written(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("a"), F.max("seg").alias("b"))
                      .where("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("alike")), "anchors")
    met = written(rows.join(anchors, "anchor"), "met")
    mixed = met.where("not alike")
    place = F.struct("k", "id", "start")
    kinds = written(mixed.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "kinds")
    crowded = written(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select("anchor"), "crowded")
    mixed = written(mixed.join(kinds, ["anchor", "seg"]), "mixed")
    span = ["id", "k", "start", "size"]
    return ([met.where("alike").select(span), mixed.where("copies > 1").select(span)],
            mixed.where(place.eqNullSafe(F.col("first"))).select(*rows.columns), crowded)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 48,
                   group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """Per document with repeats: id, k (hash of its text) and ``spans``, the byte
    ranges (start, size) to remove; they may overlap."""
    if not 7 <= gram <= length < SPAN:
        raise ValueError("7 <= gram <= length < 65536")
    id_type = dict(docs.dtypes)[id_col]
    most = min(group_segments, ((1 << 21) - 1) // (2 * length + 1))  # an index holds 2 MB, a segment two windows
    rows = written(_segment_rows(docs, id_col, text_col, length, gram), "segments")
    marks, kinds, crowded = _settled(rows, most)
    texts = written(_texts(docs, kinds, id_col, text_col), "texts")
    width = length - gram + 1
    while True:
        marks.append(_indexed(texts.join(crowded, "anchor", "left_anti"), id_type, length))
        if crowded.isEmpty():
            break
        # halved until pieces are single windows, of which one key has one kind
        width = (width + 1) // 2
        rows = written(_dealt(texts.join(crowded, "anchor", "left_semi"), length, width), "dealt")
        more, texts, crowded = _settled(rows, most)
        marks += more
    return reduce(DataFrame.union, marks).groupBy("id", "k").agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal (start, end) ranges of the spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["size"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 48,
                    group_segments: int = GROUP_SEGMENTS, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs``: its ``keep`` columns (the id by default), n_bytes,
    n_removed, n_spans, kept_sha256 and kept_text.  The hash is of the remaining
    bytes; kept_text leaves out a character of which bytes were removed."""
    keep = keep if keep is not None else [id_col]
    spans = repeated_spans(docs, id_col, text_col, length, gram, group_segments)
    own = docs.select(F.struct(*keep).alias("kf_row"), F.col(id_col).alias("kf_id"), F.col(text_col).alias("kf_text"),
                      _key(text_col).alias("kf_k"))
    both = own.join(spans, F.col("kf_id").eqNullSafe(F.col("id")) & (F.col("kf_k") == F.col("k")), "left")
    row_type = dict(both.dtypes)["kf_row"]
    names = ["kf_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for text, found in rows_of(batch, 1, 2):
                data = (text or "").encode()
                cuts = merged(found or [])
                at, left = 0, []
                for a, b in cuts:
                    left.append(data[at:a])
                    at = b
                rest = b"".join([*left, data[at:]])
                out.append((len(data), len(data) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(),
                            rest.decode(errors="ignore") if cuts else text))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [
                pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    done = both.select("kf_row", "kf_text", "spans").mapInArrow(
        run, f"kf_row {row_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    return done.select(*[F.col("kf_row")[c].alias(c) for c in keep], *names[1:])
