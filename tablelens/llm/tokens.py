"""Token ids of texts for a byte-level BPE with word ends.

The vocabulary's normaliser and pre-tokenizer never look across white space,
so the ids of a text are those of its blank-separated words, joined, and each
distinct word is tokenized once per worker.  New words of plain Latin letters,
digits and signs are merged together, one numpy step per merge round for all
of them; any other word goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

#: Entries of a worker's word cache before it starts afresh (about 90 MB).
CACHE_WORDS = 400_000
#: New words merged together.
BULK = 50_000
#: Bytes of text whose words are held at once; a word takes several times its length.
PORTION = 1 << 22

#: Words whose lower case is letter by letter, with no contraction to split:
#: visible ASCII but the apostrophe, and the letters U+00C0 to U+00FF.
_PLAIN = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, all other bytes follow in
    order from U+0100 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _classes() -> np.ndarray:
    """0 line end, 1 letter, 2 digit, 3 sign, by byte of a plain word."""
    kind = np.full(256, 3, dtype=np.int8)
    kind[ord("\n")] = 0
    kind[ord("a"):ord("z") + 1] = 1
    kind[0x80:] = 1
    kind[ord("0"):ord("9") + 1] = 2
    return kind


class BulkMerges:
    """The merge rules of a vocabulary, applied to many words at once."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self._size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        letters = byte_alphabet()
        self._inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self._last = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)
        self._kind = _classes()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids (4 bytes each) of plain words."""
        x = np.frombuffer(b"\n".join(words) + b"\n", dtype=np.uint8).copy()
        x[(x >= 65) & (x <= 90)] += 32
        accented = np.zeros(len(x), dtype=bool)
        accented[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
        x[accented] += 32
        kind = self._kind[x]
        turn = np.ones(len(x) + 1, dtype=bool)  # a piece starts here
        turn[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        text = kind > 0
        place = np.flatnonzero(text)
        symbol = np.where(turn[1:], self._last[x], self._inner[x])[text]
        piece = np.cumsum(turn[:-1])[text]
        out = np.full(len(x), -1, dtype=np.int64)
        rank = np.full(len(symbol), _NONE, dtype=np.int32)
        same = piece[1:] == piece[:-1]
        rank[:-1][same] = self._rank(symbol[:-1][same], symbol[1:][same])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbol)]))
            done = least == _NONE
            out[place[done]] = symbol[done]
            if done.all():
                break
            live = ~done
            symbol, piece, place, rank, least = symbol[live], piece[live], place[live], rank[live], least[live]
            at = np.flatnonzero(rank == least)
            # of overlapping places (as in aaa) every other one, from the left
            fresh = np.r_[True, (np.diff(at) > 1) | (piece[at[1:]] != piece[at[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self._merged[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, piece, place, rank = symbol[keep], piece[keep], place[keep], rank[keep]
            now = at - np.arange(len(at))  # merged symbols after compaction
            touched = np.zeros(len(symbol), dtype=bool)
            touched[now] = touched[np.maximum(now - 1, 0)] = True
            rank[touched] = _NONE
            touched[:-1] &= piece[:-1] == piece[1:]
            touched[-1] = False
            inner = np.flatnonzero(touched)
            rank[inner] = self._rank(symbol[inner], symbol[inner + 1])
        ids = out[out >= 0].astype("<u4").tobytes()
        ends = np.cumsum(out >= 0)[np.flatnonzero(~text)] * 4
        found, start = [], 0
        for end in ends.tolist():
            found.append(ids[start:end])
            start = end
        return found


class WordIds:
    """Word (bytes without blanks) to its ids as little-endian 32-bit values, cached."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex") == _SPLIT
        self._bulk = BulkMerges(spec) if known else None
        self._known: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        plain = [w for w in words if _PLAIN.fullmatch(w)] if self._bulk else []
        for at in range(0, len(plain), BULK):
            part = plain[at:at + BULK]
            self._known.update(zip(part, self._bulk.encode(part)))
        for w in words.difference(plain):
            found = self._tokenizer.encode(w.decode(), add_special_tokens=False).ids
            self._known[w] = np.array(found, dtype="<u4").tobytes()

    def encode_many(self, raws: list[bytes]) -> Iterator[bytes]:
        """Ids of whole texts, 4 bytes each.  Texts are taken apart a few megabytes at a time."""
        held: list[list[bytes]] = []
        size = 0
        for raw in raws:
            held.append(raw.split())
            size += len(raw)
            if size >= PORTION:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, split: list[list[bytes]]) -> list[bytes]:
        wanted = set().union(*split)
        new = wanted - self._known.keys()
        if len(self._known) + len(new) > CACHE_WORDS:
            self._known.clear()
            new = wanted
        if new:
            self._learn(new)
        look = self._known.__getitem__
        return [b"".join(map(look, words)) for words in split]


_open: dict[str, WordIds] = {}


def forget() -> None:
    """Drop the cache."""
    _open.clear()


def word_ids(path: str) -> WordIds:
    """The worker's cache for a vocabulary; at most one is kept."""
    if path not in _open:
        _open.clear()
        _open[path] = WordIds(path)
    return _open[path]
