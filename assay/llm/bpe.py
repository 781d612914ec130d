"""Byte-level BPE vocabulary: reading it, cutting text into pre-tokens, and merging in numpy."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: The public pattern of byte-level BPE. Fixed values; \s is spelt out since engines differ about U+001C-U+001F.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same cuts for texts of plain characters only, where the standard module's classes say the same.
PLAIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+| ?[0-9]+"
    r"| ?[^\sA-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+|\s+(?!\S)|\s+"
)
NOT_PLAIN = re.compile(r"[^\t-\r\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]")
NO_RANK = np.int32(2**31 - 1)
#: Pre-tokens taken from one text at a time, so that a very long text needs no list of all of them.
TOKENS_AT_ONCE = 200_000
_LOADED: dict[str, "Vocabulary"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks as sorted arrays, the bytes of every token, and the special strings of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        ids = model["vocab"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self._index(left << 32 | right)
        self.of_byte = np.zeros(256, np.int32)
        self.bytes: dict[int, bytes] = {}
        for token, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
            if len(self.bytes[i]) == 1:
                self.of_byte[self.bytes[i][0]] = i
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.never_adjacent = np.ones((256, 256), bool)
        for raw in self.bytes.values():
            if len(raw) > 1:
                b = np.frombuffer(raw, np.uint8)
                self.never_adjacent[b[:-1], b[1:]] = False
        self.bytes |= {i: s.encode() for s, i in self.special.items()}

    def _index(self, keys: np.ndarray) -> None:
        """A hash table of the pairs: one key a slot, and the keys whose slot was taken in sorted arrays."""
        self.shift = np.uint64(64 - max(10, int(len(keys) * 8).bit_length()))
        slots = self._slot(keys)
        _, placed = np.unique(slots, return_index=True)
        self.slot_key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot_rank = np.full(len(self.slot_key), NO_RANK, np.int32)
        self.slot_key[slots[placed]] = keys[placed]
        self.slot_rank[slots[placed]] = placed
        rest = np.setdiff1d(np.arange(len(keys)), placed)
        rest = rest[np.argsort(keys[rest])]
        self.crowded = np.zeros(len(self.slot_key), bool)
        self.crowded[slots[rest]] = True
        self.rest_key, self.rest_rank = np.r_[keys[rest], np.int64(-1)], np.r_[rest, NO_RANK].astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, symbols: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; NO_RANK for no merge or the end of a sequence."""
        rank = np.full(len(at), NO_RANK, np.int32)
        inner = np.flatnonzero(~last[at])
        left = at[inner]
        key = symbols[left].astype(np.int64) << 32 | symbols[left + 1]
        slot = self._slot(key)
        hit = self.slot_key[slot] == key
        rank[inner[hit]] = self.slot_rank[slot[hit]]
        if len(some := np.flatnonzero(~hit & self.crowded[slot])):
            found = np.searchsorted(self.rest_key[:-1], key[some])
            rank[inner[some]] = np.where(self.rest_key[found] == key[some], self.rest_rank[found], NO_RANK)
        return rank

    @staticmethod
    def of(text: str) -> "Vocabulary":
        """The vocabulary of a file's text, built once in each Python worker."""
        key = hashlib.sha256(text.encode()).hexdigest()
        if key not in _LOADED:
            _LOADED[key] = Vocabulary(text)
        return _LOADED[key]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and the special strings between them."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text, False
            return
        for k, piece in enumerate(self.split_special.split(text)):
            if piece:
                yield piece, k % 2 == 1


def cut(text: str) -> list[str]:
    """The pre-tokens of an ordinary text, in order."""
    return (PATTERN if NOT_PLAIN.search(text) else PLAIN).findall(text)


def pretokens(text: str) -> Iterator[list[str]]:
    """Lists of the pre-tokens of an ordinary text of any length, in order."""
    if len(text) < 4 * TOKENS_AT_ONCE:
        yield cut(text)
        return
    found = (m.group() for m in PATTERN.finditer(text))
    while some := list(itertools.islice(found, TOKENS_AT_ONCE)):
        yield some


def ragged(tokens: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, and the length of each."""
    tokens = list(tokens)
    return np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))


def merge_ragged(vocab: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences at once: in each round every sequence joins all places of its own lowest-ranked pair.

    A pair's merge makes only pairs of higher rank, so joining all its places in one round gives what
    one-at-a-time merging gives. Overlapping places (a a a) are taken from the left. Sequences without a
    mergeable pair leave the arrays. Returns the surviving symbols, sequence after sequence, and their counts.
    """
    counts = np.zeros(len(lengths), np.int64)
    owner = np.flatnonzero(lengths)
    size = lengths[owner]
    symbols = symbols.copy()
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(size) - 1] = True
    rank = vocab.ranks_of(symbols, np.arange(len(symbols)), last)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(owner):
        first = np.cumsum(size) - size
        best = np.minimum.reduceat(rank, first)
        going = best < NO_RANK
        if not going.all():
            of_symbol = np.repeat(going, size)
            done.append((owner[~going], symbols[~of_symbol]))
            counts[owner[~going]] = size[~going]
            owner, size, best = owner[going], size[going], best[going]
            if not len(owner):
                break
            symbols, rank, last = symbols[of_symbol], rank[of_symbol], last[of_symbol]
            first = np.cumsum(size) - size
        chosen = rank == np.repeat(best, size)
        if (chosen[1:] & chosen[:-1]).any():
            opens = chosen & ~np.r_[False, chosen[:-1]]
            place = np.arange(len(symbols))
            chosen &= (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0
        at = np.flatnonzero(chosen)
        symbols[at] = vocab.merged[rank[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        size = size - np.add.reduceat(chosen, first, dtype=np.int64)
        symbols, rank, last = symbols[keep], rank[keep], last[keep]
        now = at - np.arange(len(at))
        rank[now] = vocab.ranks_of(symbols, now, last)
        before = now[now > 0] - 1
        rank[before] = vocab.ranks_of(symbols, before, last)
    if not done:
        return np.zeros(0, np.int32), counts
    start = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for who, found in done:
        n = counts[who]
        out[np.repeat(start[who] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    return out, counts
