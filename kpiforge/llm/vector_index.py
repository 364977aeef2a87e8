"""Near-duplicate vectors by an inverted multi-index.

Both halves of the unit vectors have a codebook of their own; the pairs of code words
form a product grid, and a vector lies in the cell of its two nearest words.  For every
vector the multi-sequence order visits cells by the sum of the two distances; it goes on
for as many cells as pairs at exactly the threshold need to meet, from one side or the
other, in ``recall`` of all cases.  Those pairs are simulated from the sample: a sample
vector and one turned away from it by the threshold angle in a random direction, the
farthest that still links.  Everything that shares a visited cell is compared in double
precision, in blocks.

Equal vectors are one class before the index.  A cell's classes are split into blocks of
about ``block`` by their hashes, and those that visit it into blocks of about ``visitors``;
every block of the one meets every block of the other in a place of its own, so a cell with a
third of all rows is many tasks' work, and a task holds a place at a time.  A place adds up
link counts and emits a tree of its links, never pairs.  The codebooks are fitted
on ``sample`` classes, those with the smallest hashes; every vector is indexed.

Defined cases: a vector that is null, empty, zero or has a null or non-finite component
links with nothing and is its own component; vectors of different length don't link;
equal ids are separate vectors and name one component each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import run_bounds, sorted_runs, written
from kpiforge.llm.components import components

SEED = 42


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, node (MD5 of the unit vector, null if it can't link), unit (doubles, little-endian)."""
    id_type = dict(vectors.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, units = [], []
            for v in batch.column(1).to_pylist():
                unit = None
                if v and None not in v:
                    v = np.array(v, np.float64)
                    if np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                        v = v / top  # no overflow in the squares
                        unit = (v / np.sqrt(v @ v) + 0.0).astype("<f8").tobytes()
                nodes.append(unit and hashlib.md5(unit, usedforsecurity=False).hexdigest())
                units.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.string()), pa.array(units, pa.binary())], ["id", "node", "unit"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"id {id_type}, node string, unit binary")


def fit_codebook(points: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Code words of the points by Lloyd's iterations from random points."""
    book = points[rng.choice(len(points), min(words, len(points)), replace=False)]
    for _ in range(rounds):
        near = (np.sum(book**2, 1) - 2 * points @ book.T).argmin(1)
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, points)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def visited(units: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The first ``cells`` cells of every vector's multi-sequence order, home first."""
    half = units.shape[1] // 2
    first, second = books
    a = np.sum(first**2, 1) - 2 * units[:, :half] @ first.T
    b = np.sum(second**2, 1) - 2 * units[:, half:] @ second.T
    order_a, order_b = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
    sorted_a, sorted_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    # (i, j) has i * j + i + j nearer cells or more, so only those with (i + 1)(j + 1) <= cells can be visited
    pairs = [(i, j) for i in range(min(len(first), cells)) for j in range(min(len(second), cells // (i + 1)))]
    i, j = np.array(pairs).T
    nearest = np.argsort(sorted_a[:, i] + sorted_b[:, j], 1, kind="stable")[:, :cells]
    return (np.take_along_axis(order_a, i[nearest], 1) * len(second) + np.take_along_axis(order_b, j[nearest], 1)).astype(np.int64)


def cells_needed(sample: np.ndarray, books, threshold: float, recall: float, rng: np.random.Generator, tries: int = 4000) -> int:
    """Cells to visit so that pairs at the threshold meet in ``recall`` of all cases."""
    x = sample[rng.integers(0, len(sample), tries)]
    turn = rng.standard_normal(x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(turn, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(1 - threshold**2) * turn / np.where(norm > 0, norm, 1)
    most = len(books[0]) * len(books[1])
    cells = 4
    while cells < most:
        here, there = visited(x, books, cells), visited(y, books, cells)
        depth = np.minimum(_depth(here, there[:, 0]), _depth(there, here[:, 0]))
        enough = np.sort(depth)[min(int(np.ceil(recall * tries)), tries - 1)]
        if enough < cells:
            return int(enough) + 1
        cells *= 2
    return most


def _depth(order: np.ndarray, cell: np.ndarray) -> np.ndarray:
    hit = order == cell[:, None]
    return np.where(hit.any(1), hit.argmax(1), order.shape[1])


def fit(classes: DataFrame, threshold: float, recall: float, sample: int, cell_rows: int, tries: int = 4000) -> dict:
    """Per vector length: the two codebooks and the number of cells to visit."""
    chosen = classes.orderBy("node").limit(sample).select("unit").collect()
    n = classes.count()
    by_size: dict[int, list] = {}
    for r in chosen:
        v = np.frombuffer(r["unit"], "<f8")
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for size, rows in by_size.items():
        rng = np.random.default_rng(SEED)
        points = np.stack(rows)
        words = int(np.clip(round((n / cell_rows) ** 0.5), 1, 256))
        books = tuple(fit_codebook(p, words, rng) for p in (points[:, : size // 2], points[:, size // 2 :]))
        out[size] = books, cells_needed(points, books, threshold, recall, rng, tries)
    return out


def _visits(classes: DataFrame, model: dict) -> DataFrame:
    """node, weight, unit, cells (visited, home first); a length the sample lacks has one cell."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = batch.column(2).to_pylist()
            lists: list = [None] * len(raw)
            for size in {len(x) for x in raw}:
                at = [i for i, x in enumerate(raw) if len(x) == size]
                if size // 8 in model:
                    got = visited(np.stack([np.frombuffer(raw[i], "<f8") for i in at]), *model[size // 8])
                else:
                    got = np.zeros((len(at), 1), np.int64)
                for i, cells in zip(at, (got + (size << 32)).tolist(), strict=True):
                    lists[i] = cells
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], ["node", "weight", "unit", "cells"])

    return classes.select("node", "weight", "unit").mapInArrow(run, "node string, weight bigint, unit binary, cells array<bigint>")


def _compared(rows: DataFrame, threshold: float, step: int = 1024) -> DataFrame:
    """Per place: link counts (node, n) of its visitors and members, and links (a, b) that span its clusters."""

    def run(batches):
        import pyarrow as pa

        for part in sorted_runs(batches, "place"):
            for lo, hi in zip(*run_bounds(part["place"]), strict=True):
                member = part["member"][lo:hi].astype(bool)
                if not member.any() or hi - lo < 2:
                    continue
                order = np.concatenate([np.flatnonzero(member), np.flatnonzero(~member)]) + lo
                m = int(member.sum())
                asking = np.flatnonzero(part["visitor"][order].astype(bool))  # members of other visitor blocks are only met
                units = np.stack([np.frombuffer(part["unit"][i], "<f8") for i in order])
                weight, node, home = part["weight"][order].astype(np.int64), part["node"][order], part["home"][order]
                cells = part["cells"][order[:m]]
                count = np.zeros(len(order), np.int64)
                label = np.arange(m)
                a, b = [], []
                for at in range(0, len(asking), step):
                    rows_at = asking[at : at + step]
                    hit = units[rows_at] @ units[:m].T >= threshold
                    line, y = np.nonzero(hit)
                    own = rows_at[line] == y
                    line, y = line[~own], y[~own]
                    x = rows_at[line]
                    np.add.at(count, x, weight[y])
                    outer = x >= m  # a member that doesn't visit the other's cell is found from here only
                    ox, oy = x[outer], y[outer]
                    other = home[ox] != home[oy]
                    back = np.ones(len(ox), bool)
                    back[other] = [home[i] in cells[j] for i, j in zip(ox[other].tolist(), oy[other].tolist(), strict=True)]
                    np.add.at(count, oy[~back], weight[ox[~back]])
                    # one link per row and cluster found so far
                    for k in np.unique(line).tolist():
                        i = int(rows_at[k])
                        tops = np.unique(label[y[line == k]]) if len(x) < 64 else np.unique(label[hit[k]])
                        if i < m:
                            tops = np.unique(np.append(tops, label[i]))
                            if len(tops) > 1:
                                a.extend([node[tops[0]]] * (len(tops) - 1))
                                b.extend(node[tops[1:]])
                                label[np.isin(label, tops[1:])] = tops[0]
                        else:
                            a.extend([node[i]] * len(tops))
                            b.extend(node[tops])
                            if len(tops) > 1:
                                label[np.isin(label, tops[1:])] = tops[0]
                got = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*node[got], *[None] * len(a)], pa.string()), pa.array([*count[got].tolist(), *[None] * len(a)], pa.int64()),
                     pa.array([*[None] * len(got), *a], pa.string()), pa.array([*[None] * len(got), *b], pa.string())], ["node", "n", "a", "b"])

    return rows.mapInArrow(run, "node string, n bigint, a string, b string")


def _spread(visits: DataFrame, block: int, visitors: int) -> DataFrame:
    """A row per place that a class goes to: as a visitor to all member blocks of its cells, in its
    visitor block; as a member to all visitor blocks of its home, in its member block."""
    # a row per cell in use, 256 * 256 for a vector length at most
    each = visits.select("home", F.explode("cells").alias("cell"))
    blocks = each.groupBy("cell").agg(F.sum((F.col("cell") == F.col("home")).cast("bigint")).alias("members"), F.count("*").alias("n"))
    blocks = written(blocks.where("members > 0").select(
        "cell", F.ceil(F.col("members") / block).alias("blocks"), F.ceil(F.col("n") / visitors).alias("rounds")), "blocks")
    spread = visits.select("node", "weight", "unit", "home", "cells", F.explode("cells").alias("cell")).join(blocks, "cell")
    at_home, zero = F.col("cell") == F.col("home"), F.lit(0).cast("bigint")
    own_b, own_v = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rounds"))

    def place(b, v, member, visitor):
        return F.struct(b.alias("b"), v.alias("v"), member.alias("member"), F.lit(visitor).alias("visitor"))

    asks = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda b: place(b, own_v, at_home & (b == own_b), True))
    met = F.transform(F.filter(F.sequence(zero, F.col("rounds") - 1), lambda v: at_home & (v != own_v)),
                      lambda v: place(own_b, v, F.lit(True), False))
    spread = spread.select("*", F.explode(F.concat(asks, met)).alias("p"))
    return spread.select(F.xxhash64("cell", "p.b", "p.v").alias("place"), F.col("p.member").alias("member"), F.col("p.visitor").alias("visitor"),
                         "node", "weight", "unit", "home", F.when(F.col("p.member"), F.col("cells")).alias("cells"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.98,
                 sample: int = 10_000, cell_rows: int = 64, block: int = 4096, visitors: int = 8192) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = written(_classes(vectors, id_col, vector_col), "vectors")
    classes = written(rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("weight"), F.min("id").alias("least"), F.first("unit").alias("unit")), "classes")
    model = fit(classes, threshold, recall, sample, cell_rows)
    visits = written(_visits(classes, model).withColumn("home", F.col("cells")[0]), "visits")
    spread = _spread(visits, block, visitors)
    found = written(_compared(spread.repartition("place").sortWithinPartitions("place"), threshold), "found")
    counts = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.where("a is not null"), "a", "b")
    of = (classes.select("node", "weight", "least").join(counts, "node", "left").join(parts, "node", "left")
          .select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                  F.coalesce("root", "node").alias("root")))
    # written, so that a large component's rows can be split in the join
    least = written(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = of.join(least, "root").select("node", "n_links", "component_id")
    done = rows.select("id", "node").join(of, "node", "left")
    component = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                       component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
