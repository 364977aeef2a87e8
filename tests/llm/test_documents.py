"""Operators over documents, held against the plain versions."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from kpiforge.llm import automaton, edit_counts, licenses, packing, quality, repeats, simhash, simple8b, tokens  # noqa: E402
from kpiforge.llm.queries import BYTE_BPE, WORD_BPE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r.doc_id + 100, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return brute.edge_rows() + real


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.documents(spark, rows).repartition(5, "text").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return brute.documents(spark, [])


def by_row(got):
    return sorted(got, key=repr)


def test_empty_tables_give_no_rows(empty):
    for df in (packing.pack(empty, BYTE_BPE), quality.judge(empty), quality.kept_documents(empty), licenses.scan(empty),
               automaton.coded(empty, WORD_BPE), simhash.simhash_groups(empty), simhash.one_per_group(empty),
               repeats.without_repeats(empty), simple8b.id_files(empty, WORD_BPE)):
        assert df.count() == 0
    assert edit_counts.edited_counts(empty.withColumn("edits", edit_counts.pii_edits(empty["text"])), BYTE_BPE).count() == 0


# packing

def test_pieces_hold_every_id_once(docs, rows):
    lib = brute.library(BYTE_BPE)
    want = {}
    for i, t, _ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.setdefault((i, ids), 0)
        want[i, ids] += 1
    pieces = packing.pack(docs, BYTE_BPE, with_ids=True).collect()
    by_window, by_doc = {}, {}
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and 0 < p.length <= 2048
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    got = {}
    for (i, total), parts in by_doc.items():  # rows with equal ids and lengths interleave: compare as bags
        got[i] = got.get(i, 0) + sum(len(x) for _, x in parts)
    for i in {i for i, _ in want}:
        assert got[i] == sum(len(ids) * n for (j, ids), n in want.items() if j == i)
    single = [k for k, n in want.items() if n == 1 and sum(j == k[0] for j, _ in want) == 1]
    for i, ids in single:
        assert b"".join(x for _, x in sorted(by_doc[i, len(ids) // 4])) == ids
    used = sum(p.length for p in pieces)
    windows = len(by_window)
    assert windows - used / 2048 <= 5  # one open window a task at most


def test_packer_takes_the_least_sum_of_squares():
    rng, window = random.Random(5), 16
    full = []
    packer = packing.LevelPacker(window, full.append)
    counts = [0] * (window + 1)
    for _ in range(500):
        size = rng.randint(1, window - 1)
        packer.place((None, 0, b"\0" * 4 * size), size)
        before = sum(x * x for x in counts[1:window])

        def after(level):
            n = list(counts)
            if level:
                n[level] -= 1
            n[level + size] += 1
            return sum(x * x for x in n[1:window])

        best = min(after(x) for x in range(window - size + 1) if x == 0 or counts[x])
        now = [int(x) for x in packer.count[:window]] + [0]
        assert sum(x * x for x in now[1:window]) == best, before
        counts = now
    packer.close()
    fills = sorted(sum(len(p[2]) // 4 for p in held) for held in full)
    assert sum(x < window for x in fills) <= 1


def test_sequences_are_padded_but_at_powers_of_two(spark):
    pieces = spark.createDataFrame(
        [(1, 0, 2, 0, b"\1\0\0\0\2\0\0\0"), (1, 2, 1, 2, b"\3\0\0\0"), (2, 0, 4, 0, b"\4\0\0\0" * 4)],
        "sequence_id bigint, start bigint, length bigint, offset bigint, ids binary")
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces, window=8).collect()}
    assert got == {1: b"\1\0\0\0\2\0\0\0\3\0\0\0" + bytes(20), 2: b"\4\0\0\0" * 4}


# quality

FIGURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()


def test_quality_rules(docs, rows):
    got = by_row((r.id, *[r[c] for c in FIGURES]) for r in quality.judge(docs).collect())
    assert got == by_row(x[:8] for x in brute.quality(rows))


def test_boilerplate_lines_go_and_depleted_documents_too(spark):
    text = [f"alpha{i} " + " ".join(f"t{i}x{j}" for j in range(60)) for i in range(30)]
    rows = [(i, f"Accept  ALL cookies\n{t}" if i < 25 else t, "h") for i, t in enumerate(text)]
    rows += [(100 + i, "accept all cookies\n" + "\n".join(["Accept all cookies"] * 40) + f"\nrest{i} " + "u v w " * 3, "h") for i in range(3)]
    rows += [(200, "Accept all cookies\n" + text[0], "other"), (201, None, None), (202, text[3], None)]
    docs = brute.documents(spark, rows)
    want = brute.quality(rows)
    assert by_row((r.id, *[r[c] for c in FIGURES]) for r in quality.judge(docs).collect()) == by_row(x[:8] for x in want)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert by_row((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == by_row((x[0], x[8], len(x[8])) for x in want if x[7])
    assert any(x[7] and "ookies" not in x[8] for x in want[:25])


def test_lines_of_near_copies_stay(spark):
    """The same line on many documents: a notice between other lines each time, and a passage with the same neighbours."""
    body = [[f"n{i} " + " ".join(f"d{i}s{j}w{k}" for k in range(20)) for j in range(4)] for i in range(600)]
    copied = [" ".join(f"c{j}w{k}" for k in range(20)) for j in range(6)]
    rows = [(i, "\n".join([*body[i][:2], "Subscribe to our letter", *body[i][2:]]), "large") for i in range(40)]  # a fifteenth of its host
    rows += [(i, "\n".join(body[i]), "large") for i in range(40, 600)]
    rows += [(1000 + i, "\n".join([*copied, f"signed by {i}"]), "large") for i in range(50)]
    rows += [(2000, "\n".join(f"{body[i][0]}\nread more" for i in range(30)), "small")]  # often, but on one document
    want = brute.quality(rows)
    docs = brute.documents(spark, rows)
    assert by_row((r.id, *[r[c] for c in FIGURES]) for r in quality.judge(docs).collect()) == by_row(x[:8] for x in want)
    kept = {r.doc_id: r.text for r in quality.kept_documents(docs).collect()}
    assert kept == {x[0]: x[8] for x in want if x[7]} and len(kept) == len(rows)
    assert all("Subscribe" not in kept[i] for i in range(40))
    # only the last of the copied lines has a different neighbour in each copy
    assert all(kept[1000 + i] == "\n".join([*copied[:5], f"signed by {i}"]) for i in range(50))
    assert kept[2000].count("read more") == 30


def test_repeated_words_with_many_words():
    rng = random.Random(2)
    for n in (0, 2, 3, 50, 400):
        words = [str(rng.randint(0, 6)).encode() for _ in range(n)]
        text = " ".join(w.decode() for w in words)
        assert quality.repeated_words(words) == brute.quality([(1, text, "h")])[0][5]


# licenses

def test_license_scan(docs, rows):
    got = by_row((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(docs).collect())
    assert got == by_row((i, *brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES)) for i, t, _ in rows)
    assert any(x[6] for x in got) and any(x[2] > 1 for x in got)


def test_license_scan_finds_partial_templates_anywhere(spark):
    rng = random.Random(4)
    templates = [("one", "a b c d e f g h i j"), ("two", "a a x y z")]
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefghijxyzqrstuv") + rng.choice(["", "", "1"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "-", "\n"]).join(words).upper(), "s"))
    got = by_row((r.doc_id, r.labels, round(r.score, 9)) for r in licenses.scan(
        brute.documents(spark, rows), phrases={"a b": "ab"}, templates=templates, block=20).collect())
    want = [(i, *brute.licenses(t, {"a b": "ab"}, templates, block=20)) for i, t, _ in rows]
    assert got == by_row((x[0], x[6], round(x[7], 9)) for x in want)


NOTICES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License)", "apache released": "Released under the Apache license",
    "apache german": "Mit Dank. Licensed under the Apache License, Version 2.0.",
    "cc": "Licensed under CC BY 4.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": "Licensed under the GNU Lesser General Public License", "mit": "Released under the MIT License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
    "mit long": licenses.TEMPLATES[11][1].upper(), "bsd long": licenses.TEMPLATES[2][1],
    "mit half": " ".join(licenses.TEMPLATES[11][1].split()[25:80]), "scattered": " x ".join("released under the old mit then the license".split()) + " y" * 70,
}


def test_notices_get_their_own_labels(spark):
    rows = [(i, "before " * 40 * (i % 3) + text + " after" * 50, "s") for i, text in enumerate(NOTICES.values())]
    got = {r.doc_id: r.labels for r in licenses.scan(brute.documents(spark, rows)).collect()}
    assert dict(zip(NOTICES, (got[i] for i in range(len(NOTICES))))) == {
        "apache": "apache", "apache released": "", "apache german": "apache", "cc": "cc-by", "cc-by-nc": "cc-by,cc-by-nc", "cc-by-sa": "cc-by,cc-by-sa", "gpl": "gpl",
        "lgpl": "gpl,lgpl",  # its words hold the base phrase of gpl
        "mit": "mit", "isc": "isc", "mit long": "mit", "bsd long": "bsd", "mit half": "", "scattered": "mit"}
    want = {i: brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES)[5] for i, t, _ in rows}
    assert got == want


# tokens

ODD = ["", " ", "a  b", "\n\nx", "don't WE'VE 'tis", "tab\there", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "é Å Σσς",
       "İIı", "中文 एक", "x y　z", "﻿‍", "\x1c\x85", "\U0001f600!", "12345 6", "ǅﬁ", "...!!!", " lead", "trail "]


def test_words_encode_like_the_library(rows):
    rng = random.Random(1)
    texts = ODD + [t or "" for _, t, _ in rows] + ["".join(rng.choice("".join(ODD) + "ab ") for _ in range(40)) for _ in range(400)]
    for name in (BYTE_BPE, WORD_BPE):
        lib, enc = brute.library(name), tokens.Encoder(name, cache_words=500)
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_every_plain_character_is_classed_like_the_library():
    for name in (BYTE_BPE, WORD_BPE):
        lib, enc = brute.library(name), tokens.Encoder(name)
        plain = [chr(c) for c in range(0x2100) if not enc.words.odd(chr(c))]
        assert len(plain) > 500
        for c in plain:
            for t in (f"a{c}b", f"1{c}1 x{c} {c}y", f"-{c}{c}'s"):
                if not enc.words.odd(t):
                    assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_automaton_codes_like_the_library(docs, rows):
    lib = brute.library(WORD_BPE)
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = automaton.coded(docs, WORD_BPE, with_ids=True).collect()
    assert by_row((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == by_row(want)
    coder = automaton.Coder(WORD_BPE)
    for t in ODD:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids and coder.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def naive_bpe(word, merges):
    parts = list(word)
    for u, v in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == u and parts[i + 1] == v:
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


def test_automaton_of_random_merges():
    rng = random.Random(9)
    for _ in range(60):
        vocab, merges = list("abc"), []
        for _ in range(rng.randint(1, 14)):  # a trained list: the next merge is of tokens that stand together
            text = ["".join(rng.choice("aabbc") for _ in range(12)) for _ in range(4)]
            pairs = [(x, y) for w in text for s in [naive_bpe(w, merges)] for x, y in zip(s, s[1:]) if x + y not in vocab]
            if pairs:
                merges.append(rng.choice(pairs))
                vocab.append("".join(merges[-1]))
        made = automaton.MergeAutomaton({t: i for i, t in enumerate(vocab)}, merges)
        for _ in range(60):
            word = "".join(rng.choice("aabbc") for _ in range(rng.randint(1, 14)))
            assert [vocab[t] for t in made.run(word)] == naive_bpe(word, merges), (merges, word)


# simhash

def test_simhash_groups(docs, rows):
    got = by_row((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == by_row(brute.simhash([r[:2] for r in rows]))
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert by_row(r.doc_id for r in kept.select("doc_id").collect()) == by_row(brute.simhash_roots([r[:2] for r in rows])[1])


def test_hamming_balls_find_every_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    for bits in (0, 1, 2, 3):
        links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "fp bigint"), bits).collect()]
        got = brute.components([s[0] for s in signed], links)
        pairs = [(a[0], b[0]) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count() <= bits]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in links)
        assert got == brute.components([s[0] for s in signed], pairs)


@pytest.mark.parametrize("crowded", [4096, 100, 3])
def test_a_segment_value_that_most_fingerprints_share(spark, crowded):
    rng = random.Random(3)
    prints = set()
    for _ in range(700):
        x = rng.getrandbits(32) << 32 | 0xABCDEF
        prints.add(x)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), crowded=crowded).collect()]
    assert {(min(x), max(x)) for x in links} <= {(min(x), max(x)) for x in near}
    assert brute.components(signed, links) == brute.components(signed, near)


# repeats

@pytest.mark.parametrize("group_segments", [256, 2])
def test_repeated_strings_go(docs, rows, group_segments):
    got = repeats.without_repeats(docs, group_segments=group_segments).collect()
    want = brute.without_repeats([t for _, t, _ in rows])
    assert by_row((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == by_row(
        (i, *w[:4]) for (i, _, _), w in zip(rows, want))


def test_many_equal_and_periodic_rows(spark):
    """Hot groups: copies, repeated rows, periods, and one passage in many surroundings."""
    rng = random.Random(5)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, "abc" * 2000, "s")] * 3 + [(i, passage + f" end {i % 3}", "s") for i in range(10, 60)]
    rows += [(100 + i, "".join(rng.choice("abcdefgh ") for _ in range(300)) + passage + "".join(rng.choice("xyz ") for _ in range(260)), "s") for i in range(120)]
    rows += [(300 + i, "a" * (150 + 20 * i), "s") for i in range(8)]
    want = brute.without_repeats([t for _, t, _ in rows])
    for group in (256, 50, 1):
        got = repeats.without_repeats(brute.documents(spark, rows), group_segments=group).collect()
        assert by_row((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == by_row(
            (i, *w[:4]) for (i, _, _), w in zip(rows, want))


def test_repeated_strings_of_small_alphabets(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        t = "".join(rng.choice(rng.choice(["ab", "äb", "a"])) for _ in range(rng.randint(0, 120)))
        rows.append((i, t + (rows[rng.randrange(i)][1][:50] if i and rng.random() < 0.6 else ""), "s"))
    got = repeats.without_repeats(brute.documents(spark, rows), length=20, gram=8).collect()
    want = brute.without_repeats([t for _, t, _ in rows], 20)
    assert by_row((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == by_row(
        (i, *w[:4]) for (i, _, _), w in zip(rows, want))


def test_matching_statistics_come_from_the_runs():
    texts = [b"abracadabra, abracadabra", b"his abracadabra goes on"]
    whole = repeats.RunIndex(texts).matching_statistics()
    assert whole.max() == 12 and len(repeats.RunIndex(texts[:1] * 40).heads) == len(repeats.RunIndex(texts[:1]).heads)
    for name in ("heads", "lengths", "step", "jump"):
        index = repeats.RunIndex(texts)
        getattr(index, name)[:] = 0
        assert (index.matching_statistics() != whole).any()


def test_run_index_gives_matching_statistics():
    rng = random.Random(1)
    for _ in range(80):
        least = rng.choice([8, 10, 16])
        texts = ["".join(rng.choice(rng.choice(["ab", "a"])) for _ in range(rng.randint(0, 60))).encode() for _ in range(rng.randint(0, 5))]
        texts += texts[:1]
        index = repeats.RunIndex(texts)
        whole = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]

        def match(i, j):
            best = 0
            for x, y in whole:
                if (x, y) != (i, j):
                    n = 0
                    while j + n < len(texts[i]) and y + n < len(texts[x]) and texts[i][j + n] == texts[x][y + n]:
                        n += 1
                    best = max(best, n)
            return best

        for (i, j), got in zip(whole, index.matching_statistics().tolist()):
            want = match(i, j)
            assert got == want
        covered = {(t, a + j) for t, a, n in zip(*map(np.ndarray.tolist, index.spans(least))) for j in range(n)}
        assert covered == {(i, j + d) for i, j in whole if (n := match(i, j)) >= least for d in range(n)}


# edits

def test_edited_counts(spark, docs, rows):
    lib = brute.library(BYTE_BPE)

    def count(text):
        return len(lib.encode(text, add_special_tokens=False).ids)

    got = edit_counts.edited_counts(docs.withColumn("edits", edit_counts.pii_edits(docs["text"])).drop("chars", "tokens"), BYTE_BPE,
                                    with_trees=True).collect()
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert r.tokens_after == count(r.text) and r.n_chars == len(r.text) and r.tokens_before in [count(t) for t in texts[r.doc_id]]
        assert r.n_edits or r.text in texts[r.doc_id]
    # kept trees take later edits without the documents being encoded
    again = spark.createDataFrame([(r.doc_id, r.text, r.chars, r.tokens, [(3, 4, " new words"), (0, 0, "Start"), (10**9, 1, " end")]) for r in got],
                                  f"doc_id bigint, text string, chars array<bigint>, tokens array<bigint>, edits {edit_counts.EDITS}")
    for r in edit_counts.edited_counts(again, BYTE_BPE, with_trees=True).collect():
        assert r.tokens_after == count(r.text) and r.n_edits == 3 and r.text.endswith(" end")


def test_edits_touch_little():
    lib = brute.library(BYTE_BPE)

    def count(text):
        return len(lib.encode(text, add_special_tokens=False).ids)

    rng, text = random.Random(6), " ".join(f"word{i}" for i in range(20_000))
    tree = edit_counts.CountTree.build(text, count)
    for _ in range(20):
        text = tree.edit(text, rng.randrange(len(text)), rng.randint(0, 30), rng.choice(["", " x", "\n", "abc"]), count)
    assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)
    assert tree.encoded < 20 * 5 * edit_counts.LEAF


def test_random_edits():
    lib = brute.library(BYTE_BPE)

    def count(text):
        return len(lib.encode(text, add_special_tokens=False).ids)

    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "'s", "1", "ß", "x y"]) for _ in range(rng.randint(0, 900)))
        tree = edit_counts.CountTree.build(text, count)
        for _ in range(rng.randint(1, 6)):
            text = tree.edit(text, rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 700]), rng.choice(["", " ", "x", "\n ", "'s abc", "long " * 90]), count)
            assert tree.tokens[min(1, len(tree.tokens) - 1)] == count(text)


# id files

def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, bits = int(rng.integers(0, 400)), int(rng.choice([1, 2, 5, 16, 32, 60, 63, 64]))
        v = rng.integers(0, 1 << min(bits, 63), n, dtype=np.uint64)
        v = v * np.uint64(2) + np.uint64(1) if bits == 64 else v
        few = rng.random(n) < rng.choice([0.0, 0.5])
        v[few] = rng.integers(0, 4, few.sum(), dtype=np.uint64)
        if n > 200 and rng.random() < 0.5:
            v[20 : 20 + int(rng.integers(100, 170))] = 0
        assert (simple8b.unpacked(simple8b.packed(v), n) == v).all()
    assert len(simple8b.packed(np.zeros(10_000, np.uint64))) < 5
    assert len(simple8b.packed(np.full(60, 1, np.uint64))) == 1


def test_id_files(spark, docs, rows):
    lib = brute.library(WORD_BPE)
    got = sorted(simple8b.id_files(docs, WORD_BPE).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(ids) == len(rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = []
    for i, t, _ in rows:
        x = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert by_row((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == by_row(want)


def test_many_edits_of_one_place_encode_little():
    lib = brute.library(BYTE_BPE)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(6)
    for start, place, most in (("", None, 20), ("word " * 200, 500, 40)):  # inside a text a leaf on either side is read, too
        text = start
        tree = edit_counts.CountTree.build(text, count)
        for i in range(400):
            new = " " + " ".join(rng.choice(["some", "more", "words", "12", "and"]) for _ in range(8))
            text = tree.edit(text, len(text) if place is None else place, 0, new, count)
        assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)
        assert tree.encoded <= most * len(text)
        assert max(tree.chars[tree.width :]) < 3 * edit_counts.LEAF
        while text:
            text = tree.edit(text, 7, 900, "", count) if len(text) > 7 else tree.edit(text, 0, 9, "", count)
        assert tree.tokens[1] == 0


def test_long_words_are_not_kept(monkeypatch):
    from kpiforge.llm import common

    lib, enc = brute.library(BYTE_BPE), tokens.Encoder(BYTE_BPE)
    text = " ".join("ab" * 3000 + str(i) for i in range(30)) + " short words"
    assert enc.encode(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(enc.cache) <= 2 and enc.cache.held < 1000
    monkeypatch.setattr(common, "CACHE_BYTES", 20_000)
    many = " ".join(f"w{i}" for i in range(5000))
    assert enc.encode(many) == np.array(lib.encode(many, add_special_tokens=False).ids, "<u4").tobytes()
    assert enc.cache.held <= 20_000 and sum(len(k) + len(v) for k, v in enc.cache.items()) < 20_000
    own = automaton.Coder(WORD_BPE)
    assert own.encode(text) == brute.library(WORD_BPE).encode(text, add_special_tokens=False).ids and len(own.cache) <= 2
