"""Secret scans: base patterns, and a character network for what they do not know.

Every run without blanks that is no plain word is a candidate, and so is
whatever is assigned to a name such as "password".  A small convolutional
network over characters reads the whole candidate, in overlapping windows,
together with the text on both sides; the largest probability of its windows
is the candidate's.  The network is trained on labelled findings, its scores
are calibrated on findings held out from training (a quarter, by hash), and for
each shape of candidate the threshold is the highest one that still finds
``RECALL`` of the held-out secrets; secrets that never became candidates count
as missed.
Matches of the base patterns are always reported.  What is left of a candidate
beside them is read as a candidate of its own.

Labelled findings come from two sources: all candidates of all documents, whole
and labelled by the base patterns (equal ones count once), and findings built
here in the style of published credential formats, of passwords and of harmless
look-alikes, so that the network learns shapes the patterns miss.  However many
a label has, its findings in documents weigh ``LABEL_WEIGHT`` built ones
together at most.  The network starts from the built findings; then the
findings of the documents are dealt by hash to shards of about ``SHARD_BYTES``,
and in each of ``ROUNDS`` rounds every shard trains a copy of the network on its
share of the round, the built findings mixed in, and the copies are averaged.
Calibration and thresholds are sums and counts over all held-out findings.
Training is seeded and gives the same model for the same findings; the model is
a few thousand numbers, and only it, sums and counts come to the driver.

Edge cases: a NULL text is empty and has no findings; repeated rows are
scanned each for itself; an empty table gives an empty result, the network
being trained on the built findings alone; texts are scanned whole whatever
their length; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, give_back, map_batches, ship, store

# The base patterns, their kinds in order and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX_LEAST = 24
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)  # a run this long is a whole run of the characters

#: Kind of the spans the network adds.
LEARNED = "learned"
RECALL = 0.98
BUILT = 2_400
LABEL_WEIGHT = 1_500
SHARD_BYTES = 4 << 20
ROUNDS = 4
HELD = 4  # one finding in so many is held out

_HEX_HOME = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % HEX_LEAST)
LEAST, LEAST_NAMED = 8, 6
_PLAIN = r"[A-Za-z]?(?:[a-z]{0,14}|[A-Z]{0,14})"  # a word in one case or with a capital
_RUN = re.compile(r"""(?<![!-~])(?![\["'(<]*%s[])"'>.,;:!?]*(?![!-~]))[!-~]{%d,}""" % (_PLAIN, LEAST))
_NAMED = re.compile(r"""(?:passw(?:or)?d|passphrase|pass|pwd|secret|token|credential|key|auth)s?["']?"""
                    r"""\s{0,3}(?:[:=]>?|\sis\s)\s{0,3}([!-~]{%d,})""" % LEAST_NAMED, re.IGNORECASE | re.ASCII)
_PLAIN_WORD = re.compile(_PLAIN)
_EDGES = "\"'`()[]{}<>,;:.!?*"
_SOLID = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_SHAPES = 3

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for run in _HEX_HOME.finditer(text):  # a hexadecimal run lies within one of these
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text, run.start(), run.end())]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The run without quotes, brackets and punctuation at its ends."""
    run = text[start:end]
    left = len(run) - len(run.lstrip(_EDGES))
    return start + left, max(start + left, start + len(run.rstrip(_EDGES)))


def _open(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The trimmed run as a candidate, unless it is too short or a plain word."""
    start, end = _trimmed(text, start, end)
    return [(start, end)] if end - start >= LEAST and not _PLAIN_WORD.fullmatch(text, start, end) else []


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of ``LEAST`` or more without blanks that are no plain words, and what is assigned to a telling name."""
    found = [c for m in _RUN.finditer(text) for c in _open(text, *m.span())]
    if "=" in text or ":" in text or " is " in text:
        named = [_trimmed(text, *m.span(1)) for m in _NAMED.finditer(text)]
        starts = [s for s, _ in found]
        for s, e in named:
            at = bisect_right(starts, s)
            if e - s >= LEAST_NAMED and not (at and found[at - 1][1] > s) and not (at < len(found) and starts[at] < e):
                found.append((s, e))
    return sorted(set(found))


def beside(text: str, start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """What spans (by start) leave of a candidate: the whole, or parts that are candidates themselves."""
    if not _overlaps(spans, start, end):
        return [(start, end)]
    out = []
    for s, e, _ in spans:
        if s < end and e > start:
            out += _open(text, start, s) if s > start else []
            start = max(start, e)
    return out + (_open(text, start, end) if start < end else [])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _overlaps(spans: list[Span], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e, _ in spans)


# --- windows of characters ---------------------------------------------------------------------------------------

LEFT, INSIDE, RIGHT = 24, 56, 16
STEP = INSIDE // 2
BLOCK = 4096  # windows judged at once
RATE = 0.004
BATCH, MINGLED = 64, 48  # windows learned from at once, and how many of them come from documents
_ALPHABET = string.printable[:95]
_PAD, _OTHER = 0, len(_ALPHABET) + 1
_CODES = np.full(0x250, _OTHER, dtype=np.int16)
for _i, _c in enumerate(_ALPHABET):
    _CODES[ord(_c)] = _i + 1


def _codes(text: str, width: int, right: bool) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    found = np.where(x < len(_CODES), _CODES[np.minimum(x, len(_CODES) - 1)], _OTHER)
    room = np.zeros(width - len(found), dtype=np.int16)
    return np.concatenate([room, found] if right else [found, room])


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character codes left of a stretch, of its first ``INSIDE`` characters, and right of them."""
    end = min(end, start + INSIDE)
    return np.concatenate([_codes(text[max(0, start - LEFT):start], LEFT, True),
                           _codes(text[start:end], INSIDE, False),
                           _codes(text[end:end + RIGHT], RIGHT, False)])


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Windows over the whole candidate, each half over the next."""
    return [window(text, s, end) for s in range(start, max(start + 1, end - INSIDE + STEP), STEP)]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts in one array, with room around each, and where each text starts."""
    gap = np.zeros(LEFT, dtype=np.uint8)
    parts = [gap]
    for t in texts:
        x = np.frombuffer(t.encode("utf-32-le"), dtype="<u4")
        parts += [_CODES[np.minimum(x, len(_CODES) - 1)].astype(np.uint8), gap]
    starts = LEFT + np.cumsum([0] + [len(x) + LEFT for x in parts[1::2]])[:-1]
    return np.concatenate([*parts, np.zeros(INSIDE + RIGHT, dtype=np.uint8)]), starts.astype(np.int64)


def places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every window over candidates in an array of codes, and the candidate of each window."""
    n = np.maximum(1, -((ends - starts - STEP) // -STEP))
    bag = np.repeat(np.arange(len(starts)), n)
    first = starts[bag] + STEP * (np.arange(len(bag)) - np.repeat(np.cumsum(n) - n, n))
    return first, np.minimum(ends[bag], first + INSIDE), bag


def gathered(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The windows at these places, as ``window`` reads them."""
    at = first[:, None] + np.arange(-LEFT, INSIDE)
    return np.concatenate([codes[at] * (at < last[:, None]), codes[last[:, None] + np.arange(RIGHT)]], axis=1)


def shape(candidate: str) -> int:
    """0: hexadecimal or decimal digits, 1: a long run of letters, digits and ``+/_=-``, 2: anything else."""
    if re.fullmatch(r"[0-9a-fA-F]+", candidate):
        return 0
    return 1 if _SOLID.fullmatch(candidate) else 2


# --- network -----------------------------------------------------------------------------------------------------


@dataclass
class Network:
    """Embedding, one convolution, the maximum within and around the candidate, one output."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of the output
    thresholds: tuple[float, ...] = field(default_factory=lambda: (0.5,) * _SHAPES)

    WIDTH = 5

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    @classmethod
    def fresh(cls, rng: np.random.Generator, dims: int = 10, filters: int = 24) -> Network:
        f32 = np.float32
        return cls((rng.normal(size=(_OTHER + 1, dims)) * 0.3).astype(f32),
                   (rng.normal(size=(cls.WIDTH * dims, filters)) / np.sqrt(cls.WIDTH * dims)).astype(f32),
                   np.zeros(filters, f32), (rng.normal(size=2 * filters) * 0.1).astype(f32), np.zeros(1, f32))

    def _raw(self, x: np.ndarray) -> np.ndarray:
        """The filters at every place of every window but the last ones, which are too short."""
        n, wide = x.shape
        dims = self.embed.shape[1]
        rows = np.take(self.embed, x.reshape(-1), axis=0).reshape(-1)
        out = np.empty((n * wide, self.filters.shape[1]), dtype=self.filters.dtype)
        for r in range(self.WIDTH):  # every fifth place has its characters side by side: nothing is copied
            m = (n * wide - r) // self.WIDTH
            out[r:r + m * self.WIDTH:self.WIDTH] = \
                rows[r * dims:(r + m * self.WIDTH) * dims].reshape(m, -1) @ self.filters
        return out.reshape(n, wide, -1)[:, :wide - self.WIDTH + 1]

    def _pooled(self, x: np.ndarray):
        raw = self._raw(x)
        before, behind = LEFT - self.WIDTH // 2, LEFT + INSIDE - self.WIDTH // 2
        tops = [raw[:, :before].max(axis=1), raw[:, before:behind].max(axis=1), raw[:, behind:].max(axis=1)]
        values = np.concatenate([tops[1], np.maximum(tops[0], tops[2])], axis=1) + np.concatenate([self.bias] * 2)
        return raw, tops, values

    def _best(self, raw: np.ndarray, tops: list[np.ndarray]) -> np.ndarray:
        """The first place of each maximum, within and then around the candidate."""
        before, behind = LEFT - self.WIDTH // 2, LEFT + INSIDE - self.WIDTH // 2
        inside = (raw[:, before:behind] == tops[1][:, None]).argmax(axis=1) + before
        ahead = (raw[:, :before] == tops[0][:, None]).argmax(axis=1)
        after = (raw[:, behind:] == tops[2][:, None]).argmax(axis=1) + behind
        return np.concatenate([inside, np.where(tops[0] >= tops[2], ahead, after)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self._pooled(x[i:i + 128])[2], 0) @ self.out + self.shift[0] for i in range(0, len(x), 128)]
        return np.concatenate(out) if out else np.empty(0, dtype=np.float32)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * z.astype(np.float64) + b)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
        raw, tops, values = self._pooled(x)
        best = self._best(raw, tops)
        at = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1)
        active = np.maximum(values, 0)
        z = active @ self.out + self.shift[0]
        share = 1 / len(y) if weight is None else weight / weight.sum()
        error = ((1 / (1 + np.exp(-z)) - y) * share).astype(np.float32)
        back = error[:, None] * self.out * (values > 0)
        n, dims = self.filters.shape[1], self.embed.shape[1]
        codes = at[np.arange(len(x))[:, None], best]  # example, pooled filter, character
        seen = self.embed[codes].reshape(len(x), 2 * n, -1)
        by_pool = np.einsum("bf,bfd->df", back, seen)
        g_filters = by_pool[:, :n] + by_pool[:, n:]
        g_bias = back.sum(axis=0)
        weights = np.concatenate([self.filters, self.filters], axis=1).T.reshape(2 * n, self.WIDTH, dims)
        g_embed = np.zeros_like(self.embed)
        for k in range(self.WIDTH):  # by character and pooled filter first
            place = codes[:, :, k].astype(np.int64) * (2 * n) + np.arange(2 * n)
            by_code = np.bincount(place.reshape(-1), back.reshape(-1), len(g_embed) * 2 * n).reshape(-1, 2 * n)
            g_embed += by_code.astype(g_embed.dtype) @ weights[:, k]
        return [g_embed, g_filters, g_bias[:n] + g_bias[n:], active.T @ error, error.sum(keepdims=True)]


def best_of(values: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """The largest value of each candidate; ``bag`` numbers the candidate of each window, in ascending order."""
    return np.maximum.reduceat(values, np.flatnonzero(np.diff(bag, prepend=-1))) if len(values) else values


def train(x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, seed: int = 7,
          bag: np.ndarray | None = None) -> Network:
    """Fit by Adam on the logistic loss.

    ``x`` and ``y`` are windows and their labels.  Where ``bag`` says that several belong to one candidate, a secret
    is learned from its most telling window of the epoch (the secret need not be in the others), anything else from
    all of them.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    move = _adam(net)
    for _ in range(epochs):
        used = np.arange(len(x)) if bag is None else _telling(net.logits(x), y, bag)
        order = rng.permutation(used)
        for i in range(0, len(order), batch):
            at = order[i:i + batch]
            move(net.gradients(x[at], y[at]), RATE)
    return net


def _telling(z: np.ndarray, y: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """Numbers of the windows to learn from: of secrets the most telling one, of others all."""
    return np.flatnonzero((y == 0) | (z == np.repeat(best_of(z, bag), np.unique(bag, return_counts=True)[1])))


def _adam(net: Network) -> Callable[[list[np.ndarray], float], None]:
    """A function that moves the network by gradients."""
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0

    def move(gradients: list[np.ndarray], rate: float) -> None:
        nonlocal step
        step += 1
        for w, m, v, g in zip(weights, first, second, gradients):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(w.dtype)

    return move


def refine(net: Network, findings: list[bytes], labels: np.ndarray, built: tuple[np.ndarray, np.ndarray],
           masses: tuple[float, float], done: float, seed: int) -> int:
    """Train the network once over findings, built ones mixed in, and return the number of windows used.

    A finding is the codes of a candidate with ``LEFT`` before and ``RIGHT`` behind; ``built`` are windows and labels,
    ``masses`` what all findings of either label weigh, ``done`` the share of training that lies behind.
    """
    codes = np.frombuffer(b"".join(findings) + bytes(INSIDE), dtype=np.uint8)
    stops = np.cumsum([len(f) for f in findings])
    first, last, bag = places(stops - [len(f) for f in findings] + LEFT, stops - RIGHT)
    z = np.zeros(len(bag), dtype=np.float32)
    several = np.flatnonzero((labels[bag] > 0) & (np.bincount(bag)[bag] > 1))
    for i in range(0, len(several), BLOCK):
        at = several[i:i + BLOCK]
        z[at] = net.logits(gathered(codes, first[at], last[at]))
    used = _telling(z, labels[bag], bag)
    rng = np.random.default_rng(seed)
    groups = [rng.permutation(used[labels[bag[used]] == k]) for k in (0, 1)]
    mixed = [rng.permutation(np.flatnonzero(built[1] == k)) for k in (0, 1)]
    n = [len(g) for g in groups]
    secrets = int(np.clip(round(MINGLED * n[1] / len(used)), 4, MINGLED - 4))
    sizes = [MINGLED - secrets if n[0] else 0, secrets if n[1] else 0]
    half = (BATCH - MINGLED) // 2
    y = np.repeat([0, 1, 0, 1], [*sizes, half, half]).astype(np.float32)
    weight = np.repeat([m / max(1, k) for m, k in zip([*masses, BUILT, BUILT], [*sizes, half, half])],
                       [*sizes, half, half]).astype(np.float32)
    steps = max(-(-k // size) for k, size in zip(n, sizes) if size)
    move = _adam(net)
    for step in range(steps):
        at = np.concatenate([g.take(range(step * k, step * k + k), mode="wrap") for g, k in zip(groups, sizes) if k])
        near = np.concatenate([g.take(range(step * half, step * half + half), mode="wrap") for g in mixed])
        x = np.concatenate([gathered(codes, first[at], last[at]), built[0][near]])
        move(net.gradients(x, y, weight), RATE / 2 * (1 - done - step / steps / ROUNDS))
    return len(used)


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, shapes: np.ndarray, recall: float = RECALL,
              bag: np.ndarray | None = None, missed: int = 0) -> None:
    """Logistic calibration on held-out findings, then the highest threshold by shape that keeps ``recall``.

    ``y`` and ``shapes`` are by candidate, ``x`` by window; ``missed`` secrets, of any shape, were no candidates.
    """
    z = best_of(net.logits(x), np.arange(len(x)) if bag is None else bag).astype(np.float64)
    secrets = int((y > 0).sum())
    net.scale = _scale(lambda a, b, targets: _sums(z, np.where(y > 0, *targets), np.ones(len(z)), a, b),
                       secrets, len(y) - secrets)
    p = net.calibrated(z)
    wanted = _wanted(recall, missed, secrets)
    net.thresholds = tuple(_threshold(np.sort(p[(y > 0) & (shapes == k)]), wanted) for k in range(_SHAPES))


def _scale(sums: Callable[[float, float, tuple[float, float]], np.ndarray], secrets: float,
           others: float) -> tuple[float, float]:
    """Logistic calibration by Newton steps on two parameters, lightly damped, from sums over the findings."""
    a, b = 1.0, 0.0
    targets = ((secrets + 1) / (secrets + 2), 1 / (others + 2))
    for _ in range(50):
        ga, gb, haa, hab, hbb = sums(a, b, targets)
        h = np.array([[haa + 1e-2, hab], [hab, hbb + 1e-6]])
        move = np.clip(np.linalg.solve(h, [ga + 1e-2 * (a - 1), gb]), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(a), float(b)


def _sums(z: np.ndarray, target: np.ndarray, weight: np.ndarray, a: float, b: float) -> np.ndarray:
    p = 1 / (1 + np.exp(-(a * z + b)))
    e, w = weight * (p - target), weight * (p * (1 - p) + 1e-9)
    return np.array([(e * z).sum(), e.sum(), (w * z * z).sum(), (w * z).sum(), w.sum()])


def _wanted(recall: float, missed: float, secrets: float) -> float:
    """The recall among candidates that makes up for the secrets that are none."""
    lost = missed / max(1, missed + secrets)
    return recall / (1 - lost) if lost < 1 else 1.0


def _threshold(secrets: np.ndarray, recall: float) -> float:
    """The largest value that at least ``recall`` of the (sorted) scores reach; 0.5 without scores."""
    return float(secrets[int(max(0.0, 1 - recall) * len(secrets))]) if len(secrets) else 0.5


# --- labelled findings -------------------------------------------------------------------------------------------

_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
_ALNUM = _UPPER + _LOWER + _DIGITS


def built_findings(n: int = BUILT, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): ``n`` secrets and ``n`` look-alikes in short contexts."""
    rng = np.random.default_rng(seed)

    def some(letters: str, low: int, high: int | None = None) -> str:
        size = low if high is None else int(rng.integers(low, high + 1))
        return "".join(letters[i] for i in rng.integers(0, len(letters), size))

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def word(low: int = 2, high: int = 9) -> str:
        return some(_LOWER, low, high)

    def password() -> str:
        if rng.integers(3) == 0:
            return word(4, 9) + some(_DIGITS, 1, 4) + pick("", "!", "#") + word(0, 4)
        made = list(some(_ALNUM, 6, 14) + some("!$%.#@^&*-_", 1, 2) + some(_DIGITS, 1) + some(_UPPER, 1))
        return "".join(made[i] for i in rng.permutation(len(made)))

    secrets: list[Callable[[], str]] = [
        lambda: pick("ghp_", "gho_", "glpat-", "npm_", "hf_") + some(_ALNUM, 20, 36),
        lambda: pick("sk_live_", "rk_live_", "sk-", "pk_live_") + some(_ALNUM, 24, 40),
        lambda: f"xox{pick('b', 'p')}-{some(_DIGITS, 10, 12)}-{some(_ALNUM, 24)}",
        lambda: "eyJ" + some(_ALNUM + "_-", 30, 50),
        lambda: some(_ALNUM + "+/", 38, 64) + pick("", "=", "=="),
        lambda: some(_UPPER[:6] + _DIGITS, 32, 64),
        lambda: some("abcdef" + _DIGITS, 32, 64),
        lambda: "AIza" + some(_ALNUM + "_-", 35),
        lambda: some(_UPPER, 18, 32),
        lambda: ".".join(some(_ALNUM, 4, 6) for _ in range(int(rng.integers(3, 6)))),
        lambda: f"{word(4, 8)}://{word(3, 8)}:{password()}@{word(3, 8)}" + pick("", ".example", f":{some(_DIGITS, 4)}"),
        lambda: "/".join(word() for _ in range(int(rng.integers(2, 14)))) + "/" + pick("ghp_", "npm_", "", "sk-")
        + some(_ALNUM, 32, 40),
    ]
    harmless: list[Callable[[], str]] = [
        lambda: some(_DIGITS, 16, 20),
        lambda: f"20{some(_DIGITS, 2)}-{some(_DIGITS, 2)}-{some(_DIGITS, 2)}T{some(_DIGITS, 6)}",
        lambda: f"20{some(_DIGITS, 2)}{pick('-', '/')}{some(_DIGITS, 2)}-{some(_DIGITS, 2)}"
        + pick("", "T", "T") + f"{some(_DIGITS, 2)}:{some(_DIGITS, 2)}:{some(_DIGITS, 2)}" + pick("", "Z"),
        lambda: "-".join(word() for _ in range(int(rng.integers(3, 6)))),
        lambda: "/".join(word() for _ in range(int(rng.integers(3, 6)))),
        lambda: "_".join(word() for _ in range(int(rng.integers(3, 6)))),
        lambda: word(4, 9) + word(4, 9).capitalize() + word(4, 9).capitalize(),
        lambda: f"{word(8, 12)}-{some(_DIGITS, 4)}-{some(_DIGITS, 4)}",
        lambda: word(12, 20).upper() + some(_DIGITS, 0, 3),
        lambda: pick("=", "-", "_", "+") * int(rng.integers(16, 40)),
        lambda: "/".join(word() for _ in range(int(rng.integers(6, 16)))),
        lambda: f"http{pick('', 's')}://{word(3, 8)}.{pick('example', 'org', 'test')}/{word()}/{word()}"
        + pick("", ".html", f"?{word()}={some(_DIGITS, 1, 4)}", f"#{word()}"),
        lambda: f"{word(3, 8)}{pick('.', '_', '')}{word(2, 8)}@{word(3, 9)}.{pick('example', 'org', 'test')}",
        lambda: f"{some(_DIGITS, 1, 3)}.{some(_DIGITS, 1, 3)}.{some(_DIGITS, 1, 3)}.{some(_DIGITS, 1, 3)}",
        lambda: f"+{some(_DIGITS, 1, 2)}-{some(_DIGITS, 3)}-{some(_DIGITS, 3, 4)}-{some(_DIGITS, 4)}",
        lambda: f"{some(_DIGITS, 1, 3)},{some(_DIGITS, 3)},{some(_DIGITS, 3)}.{some(_DIGITS, 2)}",
        lambda: f"{word(4, 9)}{pick(',', ';', '...', '/', '--', '&')}{word(4, 9)}",
        lambda: f"{word(3, 8)}_{word(3, 8)}({word(1, 6)},{word(1, 6)})",
        lambda: f"{word(4, 10)}{some(_DIGITS, 1, 4)}.{pick('txt', 'html', 'csv', 'jpeg')}",
        lambda: f"<{word(1, 6)} {word(3, 6)}=\"{word(3, 8)}\">".replace(" ", ""),
        lambda: f"{word(4, 9).capitalize()}{word(4, 9).capitalize()}",
    ]
    out = []
    for i in range(2 * n):
        label = i % 2
        named = label == 1 and i % 10 == 1  # passwords are told by the name they are given to
        made = password() if named else (secrets if label else harmless)[
            rng.integers(len(secrets if label else harmless))]()
        made = made if len(made) >= LEAST else made + some(_DIGITS, LEAST - len(made))
        before = " ".join(word() for _ in range(int(rng.integers(1, 6))))
        quote = pick("", '"', "'", "", "")
        lead = pick(" ", " ", ": ", " = ", " ") + quote
        if label == 0 and i % 20 == 0:  # a plain word beside such a name is none
            made, lead = word(8, 12), f" {pick('my ', 'the ', '')}{pick('pass', 'pwd', 'token', 'key')}{pick(': ', ' is ')}"
        if named:
            lead = " " + pick("", "db_", "my ", "admin_") + pick("pass", "pwd", "passphrase", "auth", "credential") \
                + pick(": ", "=", " = ", " is ") + quote
        text = before + lead + made + quote + pick(" ", ". ", ", ", "\n") + " ".join(word() for _ in range(3))
        start = len(before) + len(lead)
        out.append((text, start, start + len(made), label))
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """The candidates of all documents: codes with ``LEFT`` before and ``RIGHT`` behind, shape, label, rank (a hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                met = candidates(text or "")
                known = base_spans(text) if met else []
                codes, (at,) = coded([text]) if met else (None, (0,))
                for s, e in met:
                    found = codes[at + s - LEFT:at + e + RIGHT].tobytes()
                    rank = int.from_bytes(hashlib.blake2b(found, digest_size=7).digest(), "little")
                    rows.append((found, shape(text[s:e]), int(_overlaps(known, s, e)), rank))
            types = [pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)],
                                             names=["codes", "shape", "label", "rank"])

    return map_batches(doc_columns(docs, "text"), run, "codes binary, shape int, label int, rank long")


def fit(docs: DataFrame) -> Network:
    """Train, calibrate and set thresholds on the findings of all documents and the built ones."""
    found = store(labelled(docs).distinct())
    counts = {r["label"]: r for r in found.groupBy("label").agg(F.count("*").alias("n"),
                                                                F.sum(F.length("codes")).alias("size")).collect()}
    n = [counts[k]["n"] if k in counts else 0 for k in (0, 1)]
    weighs = [min(1.0, LABEL_WEIGHT / max(1, k)) for k in n]
    shards = max(1, -(-sum(r["size"] for r in counts.values()) // (SHARD_BYTES * ROUNDS)))
    findings, missed = [], 0
    for text, start, end, label in built_findings():
        met = [(s, e) for s, e in candidates(text) if s < end and start < e]
        findings += [(np.stack(windows(text, s, e)).astype(np.uint8), label, shape(text[s:e])) for s, e in met[:1]]
        missed += label and not met
    order = np.random.default_rng(3).permutation(len(findings))
    held, rest = [findings[i] for i in order[::HELD]], [findings[i] for i in np.delete(order, np.s_[::HELD])]
    x, y, _, bag = _stacked(rest)
    net = train(x, y[bag], bag=bag)
    learned = found.filter(F.col("rank") % HELD != 0)
    for done in range(ROUNDS if sum(n) else 0):
        used = _telling(net.logits(x), y[bag], bag)
        now = learned.filter(F.shiftright("rank", 8) % ROUNDS == done).repartition(shards, "rank")
        net = averaged(net, now, (x[used], y[bag][used]), (weighs[0] * n[0], weighs[1] * n[1]), done / ROUNDS)
    _calibrate_all(net, found.filter(F.col("rank") % HELD == 0), weighs, held, missed / HELD)
    return net


def averaged(net: Network, findings: DataFrame, built: tuple[np.ndarray, np.ndarray], masses: tuple[float, float],
             done: float) -> Network:
    """A copy of the network refined in each partition of the findings; the mean of the copies, by windows used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r, c, k) for b in batches for r, c, k in zip(*(b.column(i).to_pylist() for i in range(3))))
        if rows:
            own = Network(*[w.copy() for w in net.weights()])
            used = refine(own, [c for _, c, _ in rows], np.array([k for *_, k in rows]), built, masses, done,
                          rows[0][0])
            values = np.concatenate([w.reshape(-1) for w in own.weights()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values),
                 pa.array(np.full(len(values), used, dtype=np.int64))], names=["place", "value", "used"])

    copies = map_batches(findings.select("rank", "codes", "label"), run, "place int, value double, used long")
    # decimals: a sum of doubles would depend on the order in which the copies come
    total = copies.groupBy("place").agg(F.sum((F.col("value") * F.col("used")).cast("decimal(38,12)")).alias("value"),
                                        F.sum("used").alias("used"))
    rows = total.orderBy("place").collect()
    if not rows:
        return net
    mean = np.array([float(r["value"]) / r["used"] for r in rows])
    parts = np.split(mean, np.cumsum([w.size for w in net.weights()])[:-1])
    return Network(*[m.reshape(w.shape).astype(w.dtype) for m, w in zip(parts, net.weights())])


def scored(net: Network, findings: DataFrame) -> DataFrame:
    """shape, label, logit z of every finding, and its place among all float numbers as an integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_pylist()
            codes = np.frombuffer(b"".join(found) + bytes(INSIDE), dtype=np.uint8)
            stops = np.cumsum([len(f) for f in found], dtype=np.int64)
            z = _largest(net, codes, stops - [len(f) for f in found] + LEFT, stops - RIGHT)
            bits = z.view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(z.astype(np.float64)),
                 pa.array(bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF)))], names=["shape", "label", "z", "key"])

    return map_batches(findings.select("codes", "shape", "label"), run, "shape int, label int, z double, key int")


def _largest(net: Network, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest logit of each candidate; a long one never has all its windows here at once."""
    first, last, bag = places(starts, ends)
    best = np.full(len(starts), -np.inf, dtype=np.float32)
    for i in range(0, len(bag), BLOCK):
        np.maximum.at(best, bag[i:i + BLOCK], net.logits(gathered(codes, first[i:i + BLOCK], last[i:i + BLOCK])))
    return best


def _calibrate_all(net: Network, findings: DataFrame, weighs: list[float], built: list, missed: float) -> None:
    """``calibrate`` on findings of documents, which weigh ``weighs`` by label, and built ones, which weigh 1."""
    x, y, shapes, bag = _stacked(built)
    own = best_of(net.logits(x), bag).astype(np.float64)
    rows = store(scored(net, findings))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    secrets = float((y > 0).sum()) + weighs[1] * n.get(1, 0)
    others = float((y == 0).sum()) + weighs[0] * n.get(0, 0)

    def sums(a: float, b: float, targets: tuple[float, float]) -> np.ndarray:
        found = np.zeros(5)
        if n:
            z = F.col("z")
            p = 1 / (1 + F.exp(-(a * z + b)))
            e = (p - F.when(F.col("label") > 0, targets[0]).otherwise(targets[1]))
            w = p * (1 - p) + 1e-9
            by_label = rows.groupBy("label").agg(*[F.sum(c) for c in (e * z, e, w * z * z, w * z, w)]).collect()
            found = sum(weighs[r[0]] * np.array(r[1:]) for r in by_label)
        return found + _sums(own, np.where(y > 0, *targets), np.ones(len(y)), a, b)

    a, b = _scale(sums, secrets, others)
    net.scale = (round(a, 6), round(b, 6))  # sums of doubles may come in any order
    least = _least(rows.filter(F.col("label") == 1), weighs[1], own[y > 0].astype(np.float32), shapes[y > 0],
                   max(0.0, 1 - _wanted(RECALL, missed, secrets)))
    net.thresholds = tuple(0.5 if z is None else float(net.calibrated(np.array(z, dtype=np.float32))) for z in least)


def _least(secrets: DataFrame, weigh: float, own: np.ndarray, shapes: np.ndarray, share: float) -> list[float | None]:
    """By shape, the largest logit with no more than ``share`` of the weight of all secrets below it.

    Exact: secrets are counted by the upper half of ``key``, then by the lower half where the limit lies.
    """
    bits = own.view(np.int32)
    keys = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)
    upper, lower = F.shiftright("key", 16), F.col("key").bitwiseAND(0xFFFF)

    def weights(rows: DataFrame, part, local: np.ndarray, of: np.ndarray) -> list[dict[int, float]]:
        out = [dict(zip(*(v.tolist() for v in np.unique(local[of == k], return_counts=True)))) for k in range(_SHAPES)]
        for r in rows.groupBy("shape", part.alias("part")).agg(F.count("*").alias("n")).collect():
            out[r["shape"]][r["part"]] = out[r["shape"]].get(r["part"], 0) + weigh * r["n"]
        return out

    def last(found: dict[int, float], below: float, limit: float) -> tuple[int, float]:
        at = None
        for k in sorted(found):
            if at is not None and below > limit:
                break
            at, before = k, below
            below += found[k]
        return at, before

    tops = weights(secrets, upper, keys >> 16, shapes)
    limits = [share * sum(t.values()) + 1e-9 for t in tops]
    ups = [last(t, 0.0, limit) if t else (None, 0.0) for t, limit in zip(tops, limits)]
    there = F.lit(False)
    for k, (up, _) in enumerate(ups):
        there = there | ((F.col("shape") == k) & (upper == up)) if up is not None else there
    near = np.array([u == ups[k][0] for u, k in zip(keys >> 16, shapes)], dtype=bool)
    ends = weights(secrets.filter(there), lower, keys[near] & 0xFFFF, shapes[near])
    out: list[float | None] = []
    for (up, below), end, limit in zip(ups, ends, limits):
        if up is None:
            out.append(None)
            continue
        key = np.array((up << 16) + last(end, below, limit)[0], dtype=np.int32)
        out.append(float((key ^ ((key >> 31) & np.int32(0x7FFFFFFF))).view(np.float32)))
    return out


def _stacked(findings: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows; labels and shapes by candidate; the candidate of each window."""
    return (np.concatenate([f[0] for f in findings]), np.array([f[1] for f in findings], dtype=np.float32),
            np.array([f[2] for f in findings]), np.repeat(np.arange(len(findings)), [len(f[0]) for f in findings]))


# --- scan --------------------------------------------------------------------------------------------------------


def find(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    added: dict[int, list[Span]] = {}
    open_ = [(i, *part) for i, t in enumerate(texts) for c in candidates(t) for part in beside(t, *c, base[i])]
    if open_:
        codes, starts = coded(texts)
        of, s, e = np.array(open_, dtype=np.int64).T
        best = net.calibrated(_largest(net, codes, starts[of] + s, starts[of] + e))
        for (i, s, e), value in zip(open_, best):
            if value >= net.thresholds[shape(texts[i][s:e])]:
                added.setdefault(i, []).append((s, e, LEARNED))
    return [(b, sorted(b + added[i], key=lambda x: x[0]) if i in added else b) for i, b in enumerate(base)]


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256 and all spans of every row."""
    net = net or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, (base, spans) in zip(b.column(0).to_pylist(), find(net, texts)):
                n = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(doc_columns(docs, "doc_id", "text"), run, "doc_id long, n_assign long, n_access long, "
                                                                 "n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by ``mark``."""
    out, at, reach = [], 0, -1
    for s, e, _ in spans:
        if s > reach or reach < 0:
            out += [text[at:s], mark]
        at = reach = max(reach, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced; NULL stays NULL, other columns stay."""
    net = net or fit(docs)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = find(net, [t or "" for t in texts])
            yield pd.Series([t if t is None or not spans else redacted(t, spans, mark)
                             for t, (_, spans) in zip(texts, found)], dtype=object)
        give_back()

    ship(docs.sparkSession)
    return docs.withColumn("text", F.pandas_udf(run, "string")("text"))
