"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import arrow_map

#: Words whose ids a worker keeps; when they are that many, they become the older store and a new one begins.
CACHED_WORDS = 250_000
#: Words longer than this are encoded but not kept.
CACHED_CHARS = 64
#: Symbols of a word from which its tree is kept in compact arrays: a word of millions of letters then takes some 40 bytes each.
LONG_WORD = 4096
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


#: Bits of a token id in the packed numbers below.
ID_BITS = 20


def merge_word(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the symbols of a word until no pair can: always the leftmost pair of the lowest rank first.

    A segment tree stands over the places of the symbols. The leaf of a place holds (rank, id made, place) of the pair
    that starts there as one number, or a large one where none can merge; each inner node holds the least below it.
    So the root names the leftmost pair of the lowest rank, and a merge changes three leaves and the nodes above them.
    ``merges`` has, at ``left id << ID_BITS | right id``, the number ``rank << ID_BITS | id made``.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, none = merges.get, (1 << 63) - 1
    bits = (n - 2).bit_length()
    size = 1 << bits
    hold = list if n < LONG_WORD else (lambda x: array("q", x))
    tree, symbols = hold([none]) * (2 * size), hold(symbols)
    left = symbols[0]
    for i in range(n - 1):
        right = symbols[i + 1]
        made = get(left << ID_BITS | right)
        if made is not None:
            tree[size + i] = made << bits | i
        left = right
    for j in range(size - 1, 0, -1):
        a, b = tree[2 * j], tree[2 * j + 1]
        tree[j] = a if a < b else b
    best = tree[1]
    if best == none:
        return list(symbols)
    after, before = hold(range(1, n + 1)), hold(range(-1, n - 1))
    while best != none:
        i = best & (size - 1)
        symbols[i] = new = (best >> bits) & ((1 << ID_BITS) - 1)
        j = after[i]
        k = after[i] = after[j]
        symbols[j] = -1
        if k < n:
            before[k] = i
            made = get(new << ID_BITS | symbols[k])
            tree[size + i] = none if made is None else made << bits | i
            tree[size + j] = none
        else:
            tree[size + i] = none
        h = before[i]
        if h >= 0:
            made = get(symbols[h] << ID_BITS | new)
            tree[size + h] = none if made is None else made << bits | h
        low, high = size + (i if h < 0 else h), size + (i if k == n else j)
        if high - low < 8:  # the paths to the root are nearly one
            while high > 1:
                low >>= 1
                high >>= 1
                for p in range(low, high + 1):
                    a, b = tree[2 * p], tree[2 * p + 1]
                    tree[p] = a if a < b else b
        else:
            for p in (low, size + i, high):
                while p > 1:
                    p >>= 1
                    a, b = tree[2 * p], tree[2 * p + 1]
                    tree[p] = a if a < b else b
        best = tree[1]
    return [s for s in symbols if s >= 0]


class Standins(dict):
    """For ``str.translate``: a character that the library's pattern takes for another kind than ``regex`` does (they have
    different versions of Unicode) becomes one that both take for the library's kind; all others stay. The library is
    asked once for each character that is met."""

    def __init__(self, pattern: str) -> None:
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if len(self.split(f"a{c}a")) == 1:
            known, stand = LETTER(c), "a"
        elif len(self.split(f"!{c}!")) == 1:
            known, stand = not LETTER(c) and not NUMBER(c), "!"
        else:
            known, stand = NUMBER(c), "0"
        self[code] = out = code if known else ord(stand)
        return out


def newer_characters() -> str:
    """A pattern of the code points that Python's Unicode has no character for, as the library's may have one; beyond the
    first 65,536 it takes all, which keeps the search fast."""
    unknown = np.array([i > 0xFFFF or unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], unknown, [False]]).astype(np.int8)))
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2)) + "]"


LETTER, NUMBER = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match


class WordBpe:
    """The tokenizer of a file of words with word ends: its normaliser, its splitting and its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merges = {vocab[a] << ID_BITS | vocab[b]: rank << ID_BITS | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.standins = Standins(pattern)
        self.space = regex.compile(f"[{SPACE}]+")
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.stops = {c: self.word(c) for c in ",."}
        self.odd = regex.compile(r"[\x1c-\x1f]").search  # str.split() takes these for blanks
        self.newer = re.compile(newer_characters()).search
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str

    def word(self, word: str) -> bytes:
        """The ids of a word that is not in ``known``. What was known before the last change of stores moves over."""
        ids = self.before.get(word)
        if ids is None:
            raw = word.encode()
            ids = array("i", merge_word([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.merges)).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.known) >= CACHED_WORDS:
                self.before = self.known.copy()
                self.known.clear()
            self.known[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """The ids of what stands between two blanks. No word spans a blank, so chunks are encoded for themselves."""
        get = self.known.get
        if chunk[-1:] in self.stops and chunk[-2:-1].isalpha() and chunk[-2:-1].isascii() and (ids := get(chunk[:-1])):
            return ids + self.stops[chunk[-1]]  # a word that ends in a letter ends before these
        if chunk.isascii() or (stood := chunk.translate(self.standins)) == chunk:
            return b"".join([get(w) or self.word(w) for w in self.words.findall(chunk)])
        found = [chunk[m.start() : m.end()] for m in self.words.finditer(stood)]
        return b"".join([get(w) or self.word(w) for w in found])

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers of this machine, one after the other."""
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        out: list[bytes] = []
        for part in parts:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            # Lower case is taken letter by letter, so a final capital sigma is no special case.
            if not part.isascii() and self.newer(part):
                plain = self.normal(part)
            else:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            chunks = self.space.split(plain) if self.odd(plain) else plain.split()
            get = self.known.get
            for chunk, ids in zip(chunks, map(get, chunks), strict=True):
                out.append(ids if ids is not None else self.chunk(chunk))
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, keys: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, by merges picked from a segment tree.

    A null text is encoded as an empty one and has no ids. Each row is encoded for itself, so rows that share a
    doc_id, or have none, all appear. Other columns are not read. A text of any length is encoded whole.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(tokenizer)
        flat, ends = [], [0]
        for text in b.column(1).to_pylist():
            flat.append(bpe.encode(text) if text else b"")
            ends.append(ends[-1] + len(flat[-1]) // 4)
        values = np.frombuffer(b"".join(flat), dtype=np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["doc_id", "ids"])

    return arrow_map(docs.select(keys, "text"), batch, f"doc_id {docs.schema[keys].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded``: the tokens of ``ids`` joined by a space, special ones too. No ids give an empty text."""
    types = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens = pa.array(load(tokenizer).tokens, pa.string())
        ids = b.column(b.schema.get_field_index("ids"))
        ids = pc.if_else(pc.is_valid(ids), ids, pa.array([[]], ids.type)[0]) if ids.null_count else ids
        words = tokens.take(ids.flatten())
        counts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int32)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(counts), words), " ")
        return pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "decoded"])

    return arrow_map(encoded, batch, ", ".join(f"{k} {v}" for k, v in types.items()) + ", decoded string")
