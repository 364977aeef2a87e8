"""License scan: an exact set-similarity join of text blocks with notice templates.

A template is compared with windows of twice its words (``block`` at least), every half
window, so any stretch as long as the template lies whole in one.  It matches a window that
contains at least ``threshold`` of its distinct words, and all of its *marks*: the words
that name the license, and those that a template of another label lacks whose words alone
would reach the threshold, such as "lesser" beside the same notice without it.  Words are
ordered by their frequency in all documents, the rarest first.  A match needs ``need =
ceil(threshold * size)`` common words, so it shares one of the first ``size - need + 1``
words of the template (prefix filter); the window has ``need`` template words at least
(length filter); and behind a common word both must have enough words left (positional
filter).  What passes is counted in full.

All of it is DataFrame work.  Only template words are ever counted or collected: as
many numbers as the templates have words.  Base phrases are places where a phrase's
words stand one after another.

Defined cases: null text counts as empty: no words, no labels, score 0; equal rows get
equal results; rows with equal ids and other texts keep apart; a very long text is many
windows; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import ascii_lower

# The base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Customary wordings of public license notices, by label, with the words that name the license.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
            "the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser"),
    ("mit", "released under the mit license", "mit released"),  # "mit" alone is a German word
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
            "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the software", "permission sublicense"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla"),
]
#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k (hash of the text) and ``line``: the words, each with a blank on either side."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.trim(F.regexp_replace(ascii_lower(text), BETWEEN, " "))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), F.concat(F.lit(" "), line, F.lit(" ")).alias("line"))


def _checked(sentence: str) -> str:
    if not re.fullmatch(r"[0-9a-z\x80-\U0010ffff]+( [0-9a-z\x80-\U0010ffff]+)*", sentence):
        raise ValueError(f"not a sequence of lower-case words: {sentence!r}")
    return sentence


def _base(lines: DataFrame, phrases: dict[str, str]) -> DataFrame:
    n = F.when(F.col("line") == "  ", F.lit(0)).otherwise(_spaces(F.col("line")) - 1).cast("long")
    rows = lines.withColumn("n_words", n)
    counts, firsts, lasts, labels = [], [], [], []
    for i, (phrase, label) in enumerate(phrases.items()):
        there, own = f" {_checked(phrase)} ", f"n{i}"
        rows = rows.withColumn(own, F.when(F.col("line").contains(there), F.regexp_count(
            "line", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0).cast("long"))
        found = F.col(own) > 0
        after = _spaces(F.substring_index("line", there, -1))
        counts.append(F.col(own))
        firsts.append(F.when(found, _spaces(F.substring_index("line", there, 1)).cast("long")))
        lasts.append(F.when(found, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    several = len(phrases) > 1
    return rows.select(
        "id", "k", "n_words", reduce(Column.__add__, counts).alias("n_base"),
        (F.least(*firsts) if several else firsts[0]).alias("first_word"),
        (F.greatest(*lasts) if several else lasts[0]).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"))


def frequency_order(lines: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words, the rarest in all documents first, equals by spelling."""
    counted = (lines.select(F.explode(F.split("line", " ")).alias("w")).where(F.col("w").isin(vocabulary))
               .groupBy("w").count().collect())  # one row per template word at most
    n = {r["w"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]  # distinct, in order of spelling
    marks: tuple[str, ...]
    need: int
    half: int  # every so many words a window of twice as many begins


def prepared(templates: Sequence[tuple], threshold: float, block: int) -> list[Template]:
    """Templates from (label, text) or (label, text, marks)."""
    sets = [(t[0], set(_checked(t[1]).split()), set(_checked(t[2]).split() if len(t) > 2 else []), len(t[1].split())) for t in templates]
    out = []
    for label, words, marks, length in sets:
        if not marks <= words:
            raise ValueError(f"marks that the template of {label!r} doesn't have: {sorted(marks - words)}")
        need = math.ceil(threshold * len(words) - 1e-9)
        for other, theirs, _, _ in sets:
            if other != label and need <= len(words & theirs) < len(words):
                marks = marks | words - theirs
        out.append(Template(label, tuple(sorted(words)), tuple(sorted(marks)), need, max(block // 2, length)))
    return out


def matches(lines: DataFrame, templates: Sequence[tuple], threshold: float, block: int) -> DataFrame:
    """id, k, start (word), label, containment of every window and template that match."""
    given = prepared(templates, threshold, block)
    order = frequency_order(lines, sorted({w for t in given for w in t.words}))
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for n, t in enumerate(given):
        words = sorted(t.words, key=rank.get)
        entries += [(w, n, t.label, i, len(words), t.need, words, t.marks, t.half) for i, w in enumerate(words[: len(words) - t.need + 1])]
    prefix = lines.sparkSession.createDataFrame(
        entries, "w string, t int, label string, place int, size int, need int, words array<string>, marks array<string>, half int")
    start = " (?:" + "|".join(sorted({e[0] for e in entries})) + ") "
    some = lines.where(F.col("line").rlike(start)).select("id", "k", F.split(F.trim("line"), " ").alias("all"))
    halves = sorted({t.half for t in given})
    sizes = some.withColumn("h", F.explode(F.array(*map(F.lit, halves))))
    blocks = sizes.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.col("h"))))
    own = F.array_intersect(F.array(*map(F.lit, order)), F.slice("all", F.col("start") + 1, F.col("h") * 2))
    least = F.element_at(F.create_map(*[F.lit(x) for h in halves for x in (h, min(t.need for t in given if t.half == h))]), F.col("h"))
    own = blocks.select("id", "k", "h", "start", own.alias("own")).where(F.size("own") >= least)
    tokens = own.select("id", "k", "h", "start", "own", F.posexplode("own").alias("at", "w"))
    left = F.least(F.size("own") - F.col("at"), F.col("size") - F.col("place"))
    met = (tokens.join(F.broadcast(prefix.withColumnRenamed("w", "pw")), (F.col("w") == F.col("pw")) & (F.col("h") == F.col("half")))
           .where(F.size("own") >= F.col("need"))  # prefix: the given templates' words
           .where(F.least("at", "place") + left >= F.col("need")).where(F.size(F.array_except("marks", "own")) == 0)
           .select("id", "k", "start", "t", "label", "size", "need", F.size(F.array_intersect("own", "words")).alias("common")))
    return met.where("common >= need").select("id", "k", "start", "label", (F.col("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: Sequence[tuple] | None = None, threshold: float = 0.8, block: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, and
    score: 1 with a base phrase, else the best containment of a template that matches."""
    lines = _words(docs, id_col, text_col)
    base = _base(lines, PHRASES if phrases is None else phrases)
    found = matches(lines, TEMPLATES if templates is None else templates, threshold, block)
    best = found.groupBy("id", "k").agg(F.max("containment").alias("best"), F.collect_set("label").alias("more")).select(
        F.col("id").alias("own_id"), F.col("k").alias("own_k"), "best", "more")
    both = base.join(best, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("k") == F.col("own_k")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
