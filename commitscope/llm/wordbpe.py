"""Batch tokenisation with the tokenizers library for vocabularies that drop white space.

White space never enters a token of such a vocabulary, so a text's ids are its words' ids in order. Words of printable
ASCII and Latin-1 letters, which normalisation only lower-cases, are cut into the pre-tokeniser's pieces for a slice of
texts at once (``cut``), and a piece goes straight to the library's BPE model; words with an apostrophe are cut one by
one, and every other word goes through the library's whole pipeline. Each distinct piece or word is encoded once per
worker and remembered (the memory is bounded; forgetting changes no result). A file whose normaliser, pre-tokeniser or
special tokens differ from those that these short cuts know (``KNOWN``) is encoded by the library text by text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import worker_cache

MEMORY_WORDS = 600_000
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The pre-tokeniser's split of a lower-cased plain word.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


#: The settings under which a text's ids are its words' ids.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


SPACE, LETTER, DIGIT, MARK, ODD = range(5)
#: What a byte is; of those of two-byte letters the first decides (see ``cut``).
KINDS = np.full(256, ODD, np.uint8)
KINDS[0x21:0x7F] = MARK
KINDS[[0x20, *range(0x09, 0x0E)]] = SPACE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[0x27] = ODD


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts in order, how many there are up to each text's end): a plain word's lower-cased pieces, any other word whole and as it is."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held if held else b"", np.uint8)[offsets[0] : offsets[-1]].copy()
    bounds = offsets - offsets[0]
    kind = KINDS[data]
    # letters of two bytes: 0xC3 and 0x80 to 0xBF, but for the signs of multiplication and division
    lead = np.flatnonzero(data == 0xC3)
    tail = data[lead + 1]
    letter = lead[(tail != 0x97) & (tail != 0xB7)]
    kind[letter] = kind[letter + 1] = LETTER
    begins = np.zeros(len(data), bool)
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    angle = np.flatnonzero(data[:-1] == 0x3C)
    kind[angle[(data[angle + 1] == 0x7C) & ~begins[angle + 1]]] = ODD
    change = begins | (kind == DIGIT)
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    capital = (data >= 0x41) & (data <= 0x5A)
    capital[letter + 1] = data[letter + 1] <= 0x9E
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        # words with an odd byte stay whole: neither cut nor lower-cased
        first = ~space
        first[1:] &= space[:-1] | begins[1:]
        start = np.flatnonzero(first)
        mine = np.unique(np.searchsorted(start, odd, "right") - 1)
        stop = np.append(start[1:], len(data))[mine]
        size = stop - start[mine]
        inside = np.repeat(start[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        change[inside] = capital[inside] = False
        change[start[mine]] = True
    data[capital] += 0x20
    start = np.flatnonzero(change & ~space)
    keep = ~space
    seen = np.cumsum(keep, dtype=np.int64 if len(data) >= 1 << 31 else np.int32)
    places = np.append(seen[start] - 1, seen[-1:]).astype(np.int64) if len(data) else np.zeros(1, np.int64)
    units = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data[keep])])
    return units, np.searchsorted(start, bounds[1:])


class WordTokenizer:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab = self.tokenizer.get_vocab_size()
        made = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in made["added_tokens"]]
        self.by_word = {k: made[k] for k in KNOWN} == KNOWN and made["model"]["type"] == "BPE" and all(re.fullmatch(r"<\|\w+\|>", t) for t in special)
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.units: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        cache = worker_cache("tokenizers")
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def _piece(self, piece: str) -> bytes:
        """The ids of a lower-cased piece of a plain word."""
        return array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]).tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not PLAIN.fullmatch(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        return b"".join(map(self._piece, PARTS.findall(word.lower())))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; ids per text). Texts without nulls."""
        if not self.by_word:
            coded = [np.array([*e.ids, end_id], np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *coded]), np.array(list(map(len, coded)), np.int64)
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        units, ends = cut(texts)
        flat = units.dictionary_encode()
        known = self.units
        if len(known) > MEMORY_WORDS:
            known.clear()
        names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded = [known.get(u) for u in names]
        for i in [i for i, ids in enumerate(coded) if ids is None]:
            u = names[i]
            plain = PLAIN.fullmatch(u) and "'" not in u and "<|" not in u
            coded[i] = known[u] = self._piece(u) if plain else self._word(u)
        coded.append(np.array([end_id], np.uint32).tobytes())
        codes = np.insert(flat.indices.to_numpy(zero_copy_only=False), ends, len(coded) - 1)
        joined = pa.array(coded, pa.large_binary()).take(pa.array(codes))
        upto = np.frombuffer(joined.buffers()[1], np.int64)[1 + ends + np.arange(len(ends))] // 4
        return np.frombuffer(joined.buffers()[2], np.uint32)[: int(upto[-1])], np.diff(upto, prepend=0)
