"""Plain definitions of the digests, as brute force over a list of (doc_id, text)."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
import xxhash
from tokenizers import Tokenizer


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def secrets(text):
    """(start, kind number, end, kind) of the base patterns."""
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def pieces(doc_id, text, tokenizer, capacity):
    ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
    return [(doc_id, k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes()))
            for k, at in enumerate(range(0, len(ids), capacity))]


def word_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def byte_tokenizer(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def repeats(rows, length):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    last = (1 << 63) - 1
    keyed = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in keyed:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for (d, b), (doc_id, _) in zip(keyed, rows):
        gone = [False] * (len(b) + 1)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (d, p):
                gone[p:p + length] = [True] * length
        out.append((doc_id, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)),
                    sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(links, n):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    """(start, kind number, end, kind) of the base patterns."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def disclosing(rows, context, disclosure, support):
    """Spans of disclosing terms by row, from all pairs of a run and an entity."""
    places, n_term, n_entity, both, contexts = [], {}, {}, {}, {}
    total = max(2, sum(len(t or "") for _, t in rows))
    for i, (_, t) in enumerate(rows):
        t = t or ""
        base = personal(t)
        runs = [m for m in regex.finditer(r"[\p{L}\p{N}]+", t)
                if not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        for m in runs:
            n_term[m[0].lower()] = n_term.get(m[0].lower(), 0) + 1
        for s, _, e, kind in base:
            entity = f"{kind}:{t[s:e].lower()}"
            n_entity[entity] = n_entity.get(entity, 0) + 1
            for m in runs:
                if s - context <= m.start() and m.end() <= s or e <= m.start() and m.end() <= e + context:
                    pair = m[0].lower(), entity
                    both[pair] = both.get(pair, 0) + 1
                    contexts.setdefault(pair, set()).add((t[max(0, s - context):s], t[e:e + context]))
                    places.append((i, m.span(), pair))
    found = [set() for _ in rows]
    for i, span, pair in places:
        bits = math.log2(total / n_entity[pair[1]])
        told = bits - math.log2(max(n_term[pair[0]], both[pair]) / both[pair])
        if len(contexts[pair]) >= support and told > disclosure * bits:
            found[i].add(span)
    return found
