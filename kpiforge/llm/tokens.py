"""Ids of the public tokenizers, word by word with a bounded cache.

``encode`` gives the ids that the tokenizers library gives for the whole text.
Text of plain characters is cut at white space, where both pre-tokenizers cut
anyway; a word not met before is split by the tokenizer's pattern and goes to
the library's BPE model, a known one costs a dictionary look-up.  Every other
text (rare characters, odd white space, special tokens) goes to the library
whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from kpiforge.llm.common import WordCache, worker_state

#: Words kept per worker at most; their bytes are bounded, too (``common.CACHE_BYTES``).
CACHE_WORDS = 1 << 20

#: Texts of characters whose class and case mapping no Unicode version changed.
_PLAIN = re.compile("[\n\x20-\x7e¡-įı-ɏ‐-‧€]*")


def _ascii(pattern: str) -> str:
    """A pre-tokenizer's pattern for texts of ASCII characters."""
    for old, new in ((r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]"), (r"[\p{L}]", "[A-Za-z]"), (r"[\p{N}]", "[0-9]"),
                     (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]")):
        pattern = pattern.replace(old, new)
    return pattern


def resolve(tokenizer: str) -> str:
    """``tokenizer`` is a file's path, or the name of a file of public_tokenizers."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def byte_letters() -> list[str]:
    """The printable letter of each byte, by the byte-level rule: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Words:
    """Cuts plain texts into words whose ids don't depend on their neighbours."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre = spec["pre_tokenizer"] or {}
        self.folded = pre.get("type") == "Sequence"  # lower case, white space dropped
        known = pre.get("type") == "ByteLevel" and not spec["normalizer"] and not pre["add_prefix_space"]
        if self.folded:
            split, level = pre["pretokenizers"]
            known = split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and [
                x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
            self.pattern = regex.compile(split["pattern"]["Regex"])
        else:
            import public_tokenizers

            self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.ascii = re.compile(_ascii(self.pattern.pattern))
        self.known = known
        self.letters = byte_letters()

    def odd(self, text: str) -> bool:
        return not self.known or not _PLAIN.fullmatch(text) or "<|" in text or (not self.folded and (
            "  " in text or " \n" in text or "\n " in text or "\n\n" in text))

    def cut(self, text: str) -> list[str]:
        """Words of a plain text; where blanks count, "\\n" leads the first word of a
        later line, and "\\t" the text's first one, which has no blank before it."""
        return text.lower().split() if self.folded else ("\t" + text.replace("\n", " \n")).split(" ")

    def pieces(self, word: str) -> list[str]:
        """The byte-level pieces that the pre-tokenizer makes of one word."""
        if word.isascii():  # printable ones stand for themselves
            if self.folded:
                return [word] if word.isalpha() else self.ascii.findall(word)
            if word.isalpha():
                return ["Ġ" + word]
            if word and word[0] not in "\n\t'":  # the blank before it goes to its first piece
                found = self.ascii.findall(word)
                found[0] = "Ġ" + found[0]
                return found
        if not self.folded:
            word = word[1:] if word[:1] == "\t" else word if word[:1] == "\n" else " " + word
        return ["".join(map(self.letters.__getitem__, p.encode())) for p in self.pattern.findall(word)]


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: str, cache_words: int = CACHE_WORDS):
        self.words = Words(resolve(tokenizer))
        self.cache = WordCache(self._ids, len, cache_words)

    def _ids(self, word: str) -> bytes:
        tokenize = self.words.library.model.tokenize
        return array("I", [t.id for p in self.words.pieces(word) for t in tokenize(p)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.words.odd(text):
            return array("I", self.words.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.cache.__getitem__, self.words.cut(text)))


def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder for this tokenizer, kept across its tasks."""
    state = worker_state()
    key = f"encoder:{tokenizer}"
    if key not in state:
        state[key] = Encoder(tokenizer)
    return state[key]
