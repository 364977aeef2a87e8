"""Periodic runs, the conversation trie and scaled sketches, held against plain versions."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from kpiforge.llm import periodic, prefix_trie, queries, scaled_sketch  # noqa: E402

SF = "/root/testdata/sf0.001"


def saved(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# periodic runs

def plain_runs(w, min_length=6, exponent=4):
    """Every distance q: stretches of places that agree with the place q behind."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in w], np.int64)
    best = {}
    for q in range(1, len(w) // exponent + 1):
        edge = np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]]))
        for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if end - start + q >= max(min_length, exponent * q):
                best.setdefault((start, end - start + q), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("limits", [(6, 4), (6, 3), (4, 2), (2, 2), (10, 5)])
def test_runs_of_made_up_words(limits):
    rng = random.Random(3)
    for _ in range(400):
        letters, n, w = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 70), []
        while len(w) < n:
            w += [rng.randrange(letters) for _ in range(rng.randint(1, 7))] * rng.randint(1, 9)
        assert [tuple(r) for r in periodic.runs_of(np.array(w, np.int64), *limits).tolist()] == plain_runs(w, *limits)


def test_long_repetitions_take_few_steps():
    n = 50_000
    assert periodic.runs_of(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert periodic.runs_of(np.arange(n) % 7).tolist() == [[0, n, 7]]
    hot = np.zeros(n, np.int64)  # one frequent word, each time before and behind another one
    hot[::2] = np.arange(1, n // 2 + 1)
    assert len(periodic.runs_of(hot)) == 0


def test_runs_of_documents(spark):
    rows = brute.edge_rows() + [(50 + i, t, "a") for i, t in enumerate([
        "a " * 5, "a " * 6, "x y\tx\ny x y x y z", "q " * 9 + "r " * 9, ("one two three " * 4).strip(), "b c " * 12, "tail " + "s t u v " * 300])]
    real = [(r.doc_id + 1000, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += real
    got = periodic.periodic_runs(brute.documents(spark, rows).repartition(3)).collect()
    want = []
    for i, t, _ in rows:
        w = brute.SPACE.findall(t or "")
        runs = plain_runs(w)
        want.append((i, len(w), runs, plain_collapsed(w, runs)))
    assert sum(len(x[2]) for x in want) > 8
    assert sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(brute.documents(spark, [])).count() == 0


def test_runs_query(spark, tmp_path):
    rows = brute.edge_rows() + [
        (100 + i, " ".join(f"w{j % (3 + i)}x{j // 40}" for j in range(5 * i)), "a") for i in range(60)]
    sf = saved(brute.documents(spark, rows), tmp_path, "documents")
    want = []
    for i, t, _ in rows:
        w = brute.SPACE.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()))
    assert sum(x[1] for x in want) > 5
    assert sorted(map(tuple, queries.op11_periodic_runs(spark, sf).collect()), key=repr) == sorted(want, key=repr)


# prefix trie

def plain_nodes(convs):
    """conv_id -> turns (role, text); the rows of all nodes."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, total = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        total[k] = sum(total[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), leaves[k], total[k],
                    hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest())
                   for k, m in members.items()), key=repr)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, _, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


CONV = "conv_id bigint, turn bigint, role string, text string, block bigint, place bigint, n bigint, x bigint, part bigint, size bigint"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1) for r in rows], CONV).repartition(5)


def trie_rows(query):
    return sorted(map(tuple, query.collect()), key=repr)


def test_trie_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(None, 1, "user", "no conversation"), (12, None, "user", "first"), (12, 0, None, "second"), (12, 5, "user", None),
            (47, 1, "user", "repeated"), (47, 1, "user", "repeated"), (48, 3, "", "")]
    for c in range(100, 260):
        if c % 15:  # some conversations have no base
            start = rng.randrange(3)
            rows += [(c, t, "ua"[t % 2], f"{start}-{t}-{rng.randrange(2)}é") for t in range(rng.choice([1, 2, 8, 9, 16, 17, 30]))]
    rows += [(c, t, "user", f"same {t}") for c in range(9000, 9060) for t in range(4)]  # many copies
    rows += [(c, t, "user", f"long {t}") for c in (300, 301, 302) for t in range(700 if c != 301 else 500)]
    sf = saved(conversations(spark, rows), tmp_path, "conversations")
    got = trie_rows(queries.op12_prefix_trie(spark, sf))
    assert got == plain_nodes(plain_rebuilt(rows))
    assert any(r[5] > 1 and r[1] > 8 for r in got)


def test_running_figures_cross_stretches_and_ends_cross_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    convs = {c: [("u", f"{t if t < 90 or c % 2 else c}") for t in range(60 + c)] for c in range(60)} | {1000 + i: [("u", "0")] for i in range(30)}
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    placed = prefix_trie.placed_turns(conversations(spark, rows))
    sizes = placed.groupBy("conv_id").agg({"place": "max"}).selectExpr("conv_id", "`max(place)` + 1 as n")
    empty = spark.createDataFrame([(2000, 0), (2001, 0)], "conv_id bigint, n bigint")
    nodes = prefix_trie.prefix_nodes(placed, sizes.unionByName(empty))
    assert nodes.select("x", "y").distinct().count() == nodes.count()
    assert trie_rows(nodes.drop("x", "y")) == plain_nodes(convs | {2000: [], 2001: []})


def test_no_conversations(spark, tmp_path):
    assert queries.op12_prefix_trie(spark, saved(conversations(spark, []), tmp_path, "conversations")).count() == 0


# scaled sketches

def plain_shingles(t, width=5):
    w = brute.SPACE.findall(t or "")
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def unsigned(fingerprint):
    return [int(fingerprint[i : i + 16], 16) for i in range(0, len(fingerprint), 16)]


def test_sketch_keeps_every_hash_below_the_fraction():
    words = [f"v{i * 31 % 977}" for i in range(20_000)]
    whole = scaled_sketch.text_sketch(" ".join(words), scale=1)
    assert len(whole) == len(plain_shingles(" ".join(words)))  # no two shingles have one hash
    kept = scaled_sketch.text_sketch(" ".join(words), scale=8)
    assert kept.tolist() == [h for h in whole.tolist() if h < 1 << 61] and 90 < len(kept) < 160
    # a shingle's hash is the same in every text
    part = scaled_sketch.text_sketch("  ".join(words[100:400]), scale=1)
    assert set(part.tolist()) <= set(whole.tolist())
    assert len(scaled_sketch.text_sketch(None)) == len(scaled_sketch.text_sketch(" \n")) == 0
    assert len(scaled_sketch.text_sketch("two words")) == 1


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(2)
    words = [f"t{rng.randrange(5000)}" for _ in range(30_000)]
    pairs = [(" ".join(words), " ".join(words[:9000])), (" ".join(words[:9000]), " ".join(words)), ("", ""), ("", "a b c"), ("a b c", "a b c"),
             ("a b c", None), ("a b", " ".join(words[:500])), (" ".join(words[:500]), "a b")]
    s = scaled_sketch
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.withColumns({"sa": s.sketch(df["a"]), "sb": s.sketch(df["b"])})
    got = df.select("i", s.as_text(s.merged(df["sa"], df["sb"])).alias("m"), s.containment(df["sa"], df["sb"]).alias("c"),
                    s.likeness(df["sa"], df["sb"]).alias("l")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got, strict=True):
        x, y = plain_shingles(a), plain_shingles(b)
        assert abs(r.l - (len(x & y) / len(x | y) if x | y else 1)) < 0.05
        assert abs(r.c - (len(x & y) / len(x) if x else 1)) < 0.05
        both = np.union1d(s.text_sketch(a), s.text_sketch(b))
        low = both[both <= s.limit(s.SCALE)]
        assert unsigned(r.m) == (low if len(low) else both[:1]).tolist()


def test_next_row_of_every_row(spark):
    rows = brute.edge_rows() + [(None, "another", "a")]
    order = sorted(((i is not None, i or 0), i, t or "") for i, t, _ in rows)
    for ranges in (1, 3, 40):
        got = scaled_sketch.with_next(brute.documents(spark, rows).repartition(4), ranges=ranges).collect()
        texts = defaultdict(list)
        for _, i, t in order:
            texts[i].append(t)
        assert sorted((repr(r.id), r.text) for r in got) == sorted((repr(i), t) for _, i, t in order)
        assert sorted(r.next_text for r in got) == sorted(r.text for r in got)  # one circle
        ids = sorted(texts, key=lambda i: (i is not None, i or 0))
        after = dict(zip(ids, ids[1:] + ids[:1]))
        for r in got:
            assert r.next_text in texts[r.id] or r.next_text in texts[after[r.id]]
            if len(texts[r.id]) == 1:
                assert r.next_text in texts[after[r.id]]
    assert scaled_sketch.with_next(brute.documents(spark, [])).count() == 0
    one = scaled_sketch.with_next(brute.documents(spark, [(7, "alone", "a")])).collect()
    assert [tuple(r) for r in one] == [(7, "alone", "alone")]


def test_sketch_query(spark, tmp_path):
    real = [(r.doc_id + 1000, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = list({i: (i, t, s) for i, t, s in brute.edge_rows() + real if i is not None}.values())
    rows.sort()
    sf = saved(brute.documents(spark, rows).repartition(6), tmp_path, "documents")
    got = {r.doc_id: r for r in queries.op13_scaled_sketch(spark, sf).collect()}
    assert sorted(got) == [i for i, _, _ in rows]
    errors = []
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (scaled_sketch.text_sketch(x).tolist() for x in (t, edited, after))
        assert unsigned(r.fingerprint) == a and unsigned(r.edited_fingerprint) == b
        for value, other, text in ((r.near_edited, b, edited), (r.near_next, c, after)):
            assert value == (len({*a} & {*other}) / len({*a} | {*other}) if a or other else 1.0)
            x, y = plain_shingles(t), plain_shingles(text)
            if len(x) > 300:
                errors.append(abs(value - len(x & y) / len(x | y)))
    assert len(errors) > 50 and sum(errors) / len(errors) < 0.04
