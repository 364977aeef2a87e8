"""BPE by a deterministic automaton over tokens.

The automaton accepts a word's correct tokenization and no other split of it.  It
starts as one state with an arc for every base symbol and is extended by one gadget
per merge (u, v), in merge order: the state that u leads to is copied without its v arc
for u to lead to from now on, and every state with a u arc gets an arc labelled uv to
where v leads.  Where an arc leads thus depends on its label alone, so a state is named
by its last token, and a gadget is three table entries: the parts of uv, its order of
birth, and the pair (u, v) with the time from which it is closed.  Whether a state has
an arc follows from these tables by going back through the copies in at most as many
steps as the two tokens have symbols; arcs that were asked for stay in a transition
table.

Encoding a word runs the automaton over it: from each reached place the longest label
first, places that lead nowhere are not entered again, and as the tokenization is unique
a place is reached in one way only.  Decoding emits the labels of the arcs.

Defined cases: null text counts as empty: no ids, the empty string; repeated rows and ids
are encoded each for itself; an empty table gives no rows; texts may be of any length
(a word's tokens are kept in a bounded cache, nothing else grows);
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

from pyspark.sql import DataFrame

from kpiforge.llm.common import WordCache, rows_of, worker_state
from kpiforge.llm.tokens import Words, resolve

NEVER = 1 << 60
#: Words, and arcs, that a worker keeps; at the limit the table starts anew.
CACHE_WORDS = 900_000
CACHE_ARCS = 1 << 20


class MergeAutomaton:
    """The automaton of a merge list over the symbols of a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.label = {i: t for t, i in vocab.items()}
        size = max(vocab.values(), default=-1) + 1
        self.birth, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.closed: dict[int, int] = {}
        self.size = size
        self.arcs: dict[int, bool] = {}
        for time, (u, v) in enumerate(merges):
            self.gadget(time, vocab[u], vocab[v], vocab[u + v])
        # characters of the longest label that starts with three given ones
        self.reach: dict[str, int] = {}
        for t in vocab:
            t = t.removesuffix(suffix)
            self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))

    def gadget(self, time: int, u: int, v: int, uv: int) -> None:
        if self.birth[uv] >= 0:
            raise ValueError("two merges make the same token")
        if NEVER in (self.birth[u], self.birth[v]) or not self.follows(u, v, time):  # v never follows u, so the gadget would add no arc
            self.birth[uv] = NEVER
            return
        self.birth[uv], self.left[uv], self.right[uv] = time, u, v
        self.closed[u * self.size + v] = time

    def follows(self, x: int, t: int, time: int = NEVER) -> bool:
        """Whether the state that x leads to at ``time`` has an arc labelled t."""
        birth, closed, size = self.birth, self.closed, self.size
        while True:
            if closed.get(x * size + t, NEVER) < time:
                return False
            if birth[t] >= max(birth[x], 0):  # the arc was added where its left part had one
                time, t = birth[t] + 1, self.left[t]
            elif birth[x] > birth[t]:  # the state was then that of its right part
                time, x = birth[x], self.right[x]
            else:
                return True

    def run(self, word: str) -> list[int]:
        """The labels (token ids) on the accepting path of a word; symbols are its
        characters, the last one with the suffix."""
        n, vocab, birth, arcs, size, reach = len(word), self.vocab, self.birth, self.arcs, self.size, self.reach
        if len(arcs) > CACHE_ARCS:
            arcs.clear()
        path: list[int] = []  # token ids
        ends: list[int] = []
        dead: set[int] = set()
        at, end = 0, n
        while at < n:
            most = at + reach.get(word[at : at + 3], 2)
            end = most if most < end else end
            last = path[-1] * size if path else -1
            while end > at:
                t = vocab.get(word[at:] + self.suffix if end == n else word[at:end])
                if t is not None and end not in dead and birth[t] < NEVER:
                    if last < 0:
                        break
                    ok = arcs.get(last + t)
                    if ok is None:
                        ok = arcs[last + t] = self.follows(path[-1], t)
                    if ok:
                        break
                end -= 1
            if end == at:
                dead.add(at)
                if not path:
                    raise ValueError(f"no path for {word!r}")
                path.pop()
                end = ends.pop() - 1
                at = ends[-1] if ends else 0
            else:
                path.append(t)
                ends.append(end)
                at, end = end, n
        return path


class Coder:
    """Encodes and decodes texts with the automaton of a tokenizer file."""

    def __init__(self, tokenizer: str):
        path = resolve(tokenizer)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model["ignore_merges"] or model["continuing_subword_prefix"] or spec["decoder"]:
            raise ValueError("a BPE model without prefixes and decoder is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.words = Words(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.label | {i: t for t, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        # word -> its ids, the ids as decimals, the labels
        self.cache = WordCache(self._run, lambda x: 200 + 4 * len(x[0]) + len(x[1]) + len(x[2]), CACHE_WORDS)

    def _run(self, word: str) -> tuple[array, bytes, bytes]:
        run = self.automaton.run
        return self.entry([t for p in self.words.pieces(word) for t in run(p)])

    def entry(self, ids: list[int]) -> tuple[array, bytes, bytes]:
        return array("I", ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode()

    def _odd(self, text: str) -> list[int]:
        """Ids of a text that can't be cut at white space: special tokens come out
        first, then the tokenizer's own normalizer and pre-tokenizer cut the rest."""
        library, ids = self.words.library, []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                if library.normalizer is not None:
                    part = library.normalizer.normalize_str(part)
                for piece, _ in library.pre_tokenizer.pre_tokenize_str(part):
                    ids.extend(self.automaton.run(piece))
        return ids

    def parts(self, text: str) -> list[tuple[array, bytes, bytes]]:
        """Per word its ids, the ids as decimals and the labels, the latter two joined
        by spaces; words without ids are left out."""
        if not text:
            return []
        if self.words.odd(text):
            ids = self._odd(text)
            return [self.entry(ids)] if ids else []
        return [x for x in map(self.cache.__getitem__, self.words.cut(text)) if x[0]]

    def encode(self, text: str) -> list[int]:
        return [t for x in self.parts(text) for t in x[0]]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, joined as a tokenizer without a decoder joins them."""
        return " ".join(map(self.labels.__getitem__, ids))


def coder(tokenizer: str) -> Coder:
    """The worker's coder for this tokenizer, kept across its tasks."""
    state = worker_state()
    key = f"coder:{tokenizer}"
    if key not in state:
        state[key] = Coder(tokenizer)
    return state[key]


def coded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces),
    decoded_sha256 (of the decoded text), and ids and decoded if ``with_ids``."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches):
        import pyarrow as pa

        own = coder(tokenizer)
        for batch in batches:
            rows = []
            for _, text in rows_of(batch):
                parts = own.parts(text or "")
                labels = b" ".join([x[2] for x in parts])
                row = (sum([len(x[0]) for x in parts]), hashlib.sha256(b" ".join([x[1] for x in parts])).hexdigest(),
                       hashlib.sha256(labels).hexdigest())
                rows.append((*row, [t for x in parts for t in x[0]], labels.decode()) if with_ids else row)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names) - 1]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", ids array<int>, decoded string" * with_ids)
