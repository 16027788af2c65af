"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The tokens of the BPE encoding of a string are fixed pair by pair: a sequence
of tokens is an encoding exactly if every two neighbours are the encoding of
their own concatenation.  Reading bytes from the left, the encoder is in a set
of configurations (last finished token, partly read token); a partial token
that is complete may be finished if it may follow the token before it.  Of the
configurations that finish at one byte exactly one survives, since the
encoding of each prefix is unique.  ``Transducer`` turns such sets into
numbered states when they are first reached: a state is the list of live
configurations, and a step on a byte gives the next state and the tokens that
all live configurations have in common, which are then certain.  A partial
token is never longer than the longest vocabulary entry, which bounds how far
output lags behind input.

States are kept per worker and dropped when ``MAX_STATES`` is reached, so
memory does not grow with the text.

Edge cases: a NULL or empty text has no tokens and decodes to nothing;
repeated rows are encoded each for itself; an empty table gives an empty
result; other columns are ignored.  Ids are unsigned 32-bit values in the
digests and plain ints in ``encode_documents``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_columns, map_batches

MAX_STATES = 200_000
CACHE_CHUNKS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: token bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one pre-token at a time; equal to merging by lowest rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self._pairs: dict[int, bool] = {}
        self._made: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        # state: tuple of (chain of finished but not yet emitted tokens, partial bytes)
        self._states: list[tuple] = [(((), b"", -1),)]
        self._numbers: dict[tuple, int] = {self._states[0]: 0}
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._ends: dict[int, tuple[int, ...]] = {}

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """The definition: join the neighbours of lowest rank (under ``below``) until none can be joined."""
        limit = len(self.ranks) + 1 if below is None else below
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if self.ranks.get(a + b, limit) < limit]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._made:
            parts = self.merge(self.tokens[token], below=token)
            self._made[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._made[token]

    def _follows(self, left: int, right: int) -> bool:
        """May token ``right`` stand after token ``left``?

        Both were made by merges of rising rank.  Taking the later of the two
        last merges back, again and again, shows every pair of parts that ever
        met at the border; the border stands if none of those pairs would have
        been merged before the merge that hid it.  Of equal ranks the one
        further left comes first.
        """
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= 4 * MAX_STATES:
                self._pairs.clear()
            found = self._pairs[key] = self._stands(left, right)
        return found

    def _stands(self, left: int, right: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        hidden_by = (len(ranks) + 1, 0)  # the merge that ended the time of this pair: (rank, 1 if right of the border)
        while True:
            joint = ranks.get(tokens[left] + tokens[right])
            if joint is not None and (joint, 0.5) < hidden_by:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                hidden_by, left = (left, 0), a[1]
            else:
                hidden_by, right = (right, 1), b[0]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Advance every configuration by a byte; emit what all that live share."""
        one = bytes((byte,))
        live, closed = [], None
        for chain, part, last in self._states[state]:
            grown = part + one
            if closed is None:
                token = self.ranks.get(grown)
                if token is not None and (last < 0 or self._follows(last, token)):
                    closed = (chain + (token,), b"", token)
            if grown in self._prefixes:
                live.append((chain, grown, last))
        if closed is not None:
            live.append(closed)
        shared = 0
        chains = [c for c, _, _ in live]
        while all(len(c) > shared for c in chains) and len({c[shared] for c in chains}) == 1:
            shared += 1
        emitted = chains[0][:shared] if chains else ()
        key = tuple((c[shared:], p, t) for c, p, t in live)
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
        found = self._steps[state << 8 | byte] = (number, emitted)
        return found

    def _end(self, state: int) -> tuple[int, ...]:
        """The tokens still held when the piece ends here: those of the configuration with no partial token."""
        found = next(chain for chain, part, _ in self._states[state] if not part)
        self._ends[state] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a pre-token; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) >= MAX_STATES:
            self._reset()
        state, out, steps = 0, [], self._steps
        for byte in piece:
            state, emitted = steps.get(state << 8 | byte) or self._step(state, byte)
            if emitted:
                out += emitted
        out += self._ends.get(state) or self._end(state)
        return out


#: A blank before a character that is surely no white space always starts a pre-token.
_CUT = re.compile(" (?=[!-~¡-ᙿ])")


class TextEncoder:
    """Whole texts: pre-tokens by pattern, each through the transducer, repeated stretches from a cache."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self._find = regex.compile(pattern).findall
        self._chunks: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        encode = self.transducer.encode
        ids = [i for piece in self._find(text) for i in encode(piece.encode())]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit values."""
        first, *rest = _CUT.split(text)
        known, out = self._chunks, [self._encode(first)]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = self._encode(" " + chunk)
                if len(chunk) < 64:
                    if len(known) >= CACHE_CHUNKS:
                        known.clear()
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any portions, gives back the characters that are complete.

    The state is the incomplete character at the end (at most three bytes).
    Bytes that can never become a character turn into U+FFFD, as decoding the
    whole with replacement would.
    """

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """Length of the incomplete character at the end, 0 if there is none."""
        for n in range(1, min(3, len(data)) + 1):
            lead = data[-n]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                if need <= n:
                    return 0
                if n > 1:  # the second byte is limited after some leads
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                    if not low <= data[1 - n] <= high:
                        return 0
                return n
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        tail = self._open_tail(data)
        cut = len(data) - tail
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")

    def end(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", errors="replace")


def decode_stream(tokens: dict[int, bytes], portions: Iterable[Iterable[int]]) -> Iterator[str]:
    """Text of ids that arrive in portions; joined, the parts are the whole text."""
    machine = Utf8Machine()
    for ids in portions:
        yield machine.feed(b"".join(map(tokens.__getitem__, ids)))
    yield machine.end()


_open: dict[str, TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """The worker's encoder for a vocabulary; at most one is kept."""
    key = f"{path}\n{pattern}"
    if key not in _open:
        _open.clear()
        _open[key] = TextEncoder(path, pattern)
    return _open[key]


PORTION = 4096


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of every row; a NULL text has no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for b in batches:
            ids = [memoryview(encoder.encode(t or "")).cast("I") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(list, ids), pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    return map_batches(doc_columns(docs, "doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` back from ``ids``; NULL ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in read_ranks(path).items()}
        for b in batches:
            texts = ["".join(decode_stream(tokens, _portions(ids or []))) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(doc_columns(encoded, "doc_id", "ids"), run, "doc_id long, text string")


def _portions(ids) -> Iterator:
    return (ids[i:i + PORTION] for i in range(0, len(ids), PORTION))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Every text is encoded whole and decoded again from its ids in the same
    task, so neither ids nor texts are moved.  NULL texts count as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        tokens = encoder.transducer.tokens
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = encoder.encode(text or "")
                decoded = hashlib.sha256()
                for part in decode_stream(tokens, _portions(memoryview(raw).cast("I"))):
                    decoded.update(part.encode())
                rows.append((doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), decoded.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(doc_columns(docs, "doc_id", "text"), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
