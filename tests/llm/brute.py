"""Plain counterparts of the operators' contracts, for small tables held in memory."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


def tiktoken_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def crc(ids) -> int:
    return zlib.crc32(packed(ids))


def shingles(text: str | None, size: int = 5) -> set:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs: list[tuple[int, str | None]]) -> dict:
    """doc_id -> (n_shingles, component_id); documents with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    links.append((a, b))
    of = components(ids, links)
    return {d: (len(sets[d]), of[d]) for d in ids}


def archive(pages: list[tuple[int, str | None]]) -> dict:
    payloads = {p: (h or "").encode() for p, h in pages}
    holder: dict[bytes, int] = {}
    for p, data in payloads.items():
        holder[data] = max(p, holder.get(data, p))
    return {
        p: (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if holder[data] == p else "revisit", None if holder[data] == p else holder[data])
        for p, data in payloads.items()
    }


def near(vectors: list[tuple[int, list | None]], cosine: float = 0.95) -> dict:
    good = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    links = []
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((a, b))
    of = components([i for i, _ in vectors], links)
    counts = dict.fromkeys(of, 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return {i: (counts[i], of[i], of[i] == i) for i in of}


PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def secrets(text: str | None) -> tuple[int, int, int, str, list[tuple]]:
    spans = []
    for rank, (kind, regex, group, least) in enumerate(PATTERNS):
        spans += [(m.start(), rank, m.end(), kind) for m in regex.finditer(text or "") if len(m[group]) >= least]
    spans.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return (*(sum(s[3] == k for s in spans) for k, *_ in PATTERNS), hashlib.sha256(joined.encode()).hexdigest(), spans)


def bm25(docs: list[tuple[int, str | None]], k: int = 10, k1: float = 1.2, b: float = 0.75) -> dict:
    """query_id -> [(doc_id, score)] over every document, scored in full."""
    from collections import Counter

    words = {d: Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in docs}
    length = {d: sum(c.values()) for d, c in words.items()}
    mean = sum(length.values()) / len(docs)
    df = Counter(w for c in words.values() for w in c)
    out = {}
    for q in (d for d in words if d % 20 == 0):
        scores = Counter()
        for w, n in words[q].items():
            idf = np.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
            for d, c in words.items():
                if w in c:
                    scores[d] += n * idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * length[d] / mean))
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out
