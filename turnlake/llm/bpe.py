"""BPE encoding and decoding for tokenizers with word ends.

Words are encoded by backtracking: one Aho-Corasick pass finds the longest
vocabulary token from every position, tokens are tried longest first, and a
token is kept only if the pair with its predecessor is compatible, that is, if
no merge of the vocabulary would ever join across their border. Tried positions
are marked, so that the time is linear in the word. Decoding gathers token
strings from one byte table through an offset table.

Defined results: null and empty texts have no tokens and decode to the empty
text; special tokens' strings in a text become their ids. Repeated rows are
encoded each on its own; an empty table gives an empty result. Only the named
id and text columns are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers; beyond it the memory is emptied.
REMEMBERED_WORDS = 300_000
_WORD_END = "</w>"
_BASE = -1
#: Ranges of letters and digits newer than this Python's Unicode
#: data that the vocabulary's library knows; it takes all others for symbols.
KNOWN_NEW = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CE), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3),
    (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x16EA0, 0x16EB8), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
#: First and last capital newer than this Python's Unicode data, with the small letter of the first; the library knows these.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Combining marks that the library's tables do not know as such; it neither moves nor composes them.
UNMOVED = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 "
    "11070 1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 "
    "1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Fixed value: the second part of a composed letter that the library's tables lack.
UNCOMPOSED = "11930"
_APART = re.compile("[" + "".join("-".join(f"\\U{int(end, 16):08X}" for end in part.split("-")) for part in f"{UNMOVED} {UNCOMPOSED}".split()) + "]")


def composed(text: str) -> str:
    """The text in the normal form NFC as the library has it."""
    if text.isascii() or not _APART.search(text):
        return unicodedata.normalize("NFC", text)
    out, at = [], 0
    for m in _APART.finditer(text):
        out += [unicodedata.normalize("NFC", text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, unicodedata.normalize("NFC", text[at:])])


class _Words(dict):
    """Word to the bytes of its ids, filled on demand."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        ids = self[word] = np.array(self.encode(word), "<u4").tobytes()
        return ids


class Codec:
    """Encoder and decoder of a tokenizer file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model.get("end_of_word_suffix") != _WORD_END or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"{path}: not a lower-casing BPE vocabulary with word ends")
        self._pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self._find = self._pattern.findall
        known = {c for a, b in KNOWN_NEW for c in range(a, b + 1)}
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        new = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn" and ord(c) not in known]
        self._new_letters, self._as_symbols = frozenset(new), dict.fromkeys(map(ord, new), "\ue000")
        self._lower = {c: low + c - a for a, b, low in NEW_CAPITALS for c in range(a, b + 1)}
        self._capitals = frozenset(map(chr, self._lower))
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self._special, key=len, reverse=True)
        self._special_split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if longest_first else None
        vocabulary: dict[str, int] = model["vocab"]
        size = max([*vocabulary.values(), *self._special.values()]) + 1
        letters = _byte_letters()

        self._length = [0] * size
        self._rank, self._left, self._right = [_BASE] * size, [0] * size, [0] * size
        self._pair: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self._rank[whole], self._left[whole], self._right[whole] = rank, left, right
            self._pair[left << 20 | right] = rank
        self._tokens = ahocorasick.Automaton()
        symbols = {}
        for token, i in vocabulary.items():
            ends = token.endswith(_WORD_END)
            raw = [letters[c] for c in (token[: -len(_WORD_END)] if ends else token)]
            if ends:
                raw[-1] += 256
            symbols[i] = "".join(map(chr, raw))
            self._length[i] = len(raw)
            self._tokens.add_word(symbols[i], (len(raw), i))
        by_text = {s: i for i, s in symbols.items()}
        self._shorter = [-1] * size
        for i, s in symbols.items():
            self._shorter[i] = next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), -1)
        self._tokens.make_automaton()
        self._compatible: dict[int, bool] = {}
        self._words = _Words(self.encode_word)

        strings = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self._special.items()}
        encoded = [(strings[i] + " ").encode() if i in strings else b"" for i in range(size)]
        self._table = np.frombuffer(b"".join(encoded), np.uint8)
        self._offset = np.concatenate(([0], np.cumsum([len(e) for e in encoded])))

    def _fits(self, first: int, second: int) -> bool:
        """Whether the two tokens can stand side by side: undo their merges,
        latest first, and look for a merge over the border that comes before."""
        key = first << 20 | second
        known = self._compatible.get(key)
        if known is not None:
            return known
        rank, pair, limit, fits = self._rank, self._pair, 1 << 30, True
        while True:
            if pair.get(first << 20 | second, limit) < limit:
                fits = False
                break
            if rank[first] > rank[second]:
                limit, first = rank[first], self._right[first]
            elif rank[second] != _BASE:
                limit, second = rank[second] + 1, self._left[second]
            else:
                break
        if len(self._compatible) >= 4 * REMEMBERED_WORDS:
            self._compatible.clear()
        self._compatible[key] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, its end included."""
        raw = word.encode("utf-8", "surrogatepass")
        n, longest = len(raw), {}
        for at, (size, token) in self._tokens.iter(raw[:-1].decode("latin-1") + chr(raw[-1] + 256)):
            longest[at - size + 1] = token
        token = longest[0]
        if self._length[token] == n:
            return [token]
        length, shorter, fits = self._length, self._shorter, self._fits
        dead, ids, at, last = bytearray(n + 1), [], 0, -1
        while True:
            to = at + length[token]
            if not dead[to] and (last < 0 or fits(last, token)):
                ids.append(token)
                if to == n:
                    return ids
                last, at, token = token, to, longest[to]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = ids.pop()
                last = ids[-1] if ids else -1
                at -= length[token]

    def _plain(self, text: str) -> bytes:
        text = composed(text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # letters are lowered one by one, without regard to a word's end
        words, text = self._words, text.lower()
        if not text.isascii() and not self._capitals.isdisjoint(text):
            text = text.translate(self._lower)
        if text.isascii() or self._new_letters.isdisjoint(text):
            return b"".join([words[w] for w in self._find(text)])
        spans = (m.span() for m in self._pattern.finditer(text.translate(self._as_symbols)))
        return b"".join([words[text[a:b]] for a, b in spans])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        text = text or ""
        if self._special_split is None or not any(s in text for s in self._special):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self._special_split(text)
        return np.frombuffer(
            b"".join(np.array([self._special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)),
            "<u4",
        )

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, joined by spaces, in UTF-8."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start = self._offset[ids]
        size = self._offset[ids + 1] - start
        ends = np.cumsum(size)
        at = np.repeat(start - ends + size, size) + np.arange(ends[-1])
        return self._table[at].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; path is the vocabulary file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t.as_py()) for t in part.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["_id", "ids"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the decoded tokens of every row; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [
                    own.decode(np.array([], np.int64) if not x.is_valid else x.values.to_numpy(zero_copy_only=False))
                    for x in part.column(1)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    picked = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass over the texts, without keeping ids between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [own.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([own.decode_bytes(x) for x in ids], pa.binary())],
                    names=["_id", "ids", "decoded"],
                )

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, ids binary, decoded binary").withColumnRenamed("_id", id_col)
