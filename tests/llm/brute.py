"""Plain Python versions of what the operators must give."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile("[^\x20\x09-\x0D]+")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

NAMES = ("id k fp host tx node line spans start size anchor component_id cell ids part kept gone own_id own_k data parts all "
         "least root page slot edits chars tokens unit weight w best row own_text "
         "kf_row kf_id kf_text kf_k kf_h kf_t kf_gone kf_host kf_tx kf_own kf_rows rows changed words runs ahead range h t "
         "n_bytes n_removed n_spans kept_sha256 kept_text").split()


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def documents(spark, rows):
    """rows: (doc_id, text, source); every other column has a name that an operator uses inside."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, *["x"] * len(NAMES)) for i, t, s in rows], schema)


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    words = [f"w{i * 7919 % 613}" for i in range(30_000)]
    long = " ".join(words)
    base = " ".join(f"word{i}" for i in range(80))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "a"), (5, base, "a"), (5, base, "a"), (6, base.upper(), "b"),
        (7, base.replace("word7 ", "other "), "b"), (None, "no id at all", "b"), (8, long, "c"), (9, "äöü ß Éa 中文 <|endoftext|> it's", "c"),
        (10, long[5000:9000] + " tail", "c"), (11, "x", "c"), (11, "y", "c"), (12, "a  b\n\n c \n" * 30, None), (13, "zz " * 400, "a"),
        (14, "Licensed under CC BY-NC 4.0. All rights reserved. all rights\nreserved, cc by cc by", "a"),
        (15, "This is released (under) the MIT-license, 1 2 3", "b"),
    ]


def components(nodes, links):
    """Node -> smallest node it reaches, over hashable nodes with an order."""
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = SPACE.findall((text or "").translate(AZ))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    """[(id, fingerprint, component)] of (id, text) rows."""
    return simhash_roots(rows)[0]


def simhash_roots(rows):
    """The same, and the smallest id (or None) of every group."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3]
    of = components(distinct, links)
    least = defaultdict(list)
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[of[f]].append(i)
    return ([(i, f, min(least[of[f]], default=None)) for (i, _), f in zip(rows, prints)],
            [min(least[r], default=None) for r in set(of.values())])


def without_repeats(texts, length=200):
    """Per text: bytes, removed bytes, removed runs, SHA-256 of the rest, the rest."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest))
    return out


def quality(rows, max_docs=10, min_words=50, min_left=0.5):
    """Per (id, text, host) row: the figures, base_failed, kept and the text without boilerplate lines."""
    def key(line):
        return " ".join(SPACE.findall(line.translate(AZ)))

    of_line, between = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        lines = ["", *[key(x) for x in (t or "").split("\n") if key(x)], ""]
        for before, line, after in zip(lines, lines[1:], lines[2:]):
            of_line[host, line].add(t)
            between[host, line].add((before, after))
    out = []
    for i, t, host in rows:
        text = t or ""
        words = SPACE.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {j + d for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if key(x)]

        def boiler(line):
            return bool(key(line)) and min(len(of_line[host, key(line)]), len(between[host, key(line)])) > max_docs

        gone = sum(len(SPACE.findall(x)) for x in lines if boiler(x))
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        left = len(words) - gone
        kept = not failed and not (gone and (left < min_words or left < min_left * len(words)))
        rest = "\n".join(x for x in text.split("\n") if not boiler(x)) if gone else t
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
                    failed, kept, rest))
    return out


def licenses(text, phrases, templates, threshold=0.8, block=64):
    words = WORD.findall((text or "").translate(AZ))
    places, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    more, best = set(), 0.0
    for label, text, *marks in templates:
        t, marks = set(text.split()), set(" ".join(marks).split())
        for other, theirs, *_ in templates:
            if other != label and len(t & set(theirs.split())) >= threshold * len(t) - 1e-9:
                marks |= t - set(theirs.split())
        half = max(block // 2, len(text.split()))
        for at in range(0, max(len(words), 1), half):
            own = set(words[at : at + 2 * half])
            if len(t & own) >= threshold * len(t) - 1e-9 and marks <= own:
                more.add(label)
                best = max(best, len(t & own) / len(t))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | more)), 1.0 if places else best)
