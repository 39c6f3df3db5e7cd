"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs: list[tuple], n: int = 35) -> list[tuple]:
    words = [WORD.findall((t or "").encode()) for _, t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(docs, words):
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                keep[i : i + n] = [False] * n
        out.append((d, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest()))
    return out


def fingerprint(text: str | None) -> int:
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs: list[tuple], radius: int = 4) -> list[tuple]:
    fps = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    array = np.array(fps, np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= radius):
            parent[root(i)] = root(i + 1 + int(j))
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, f"{fp:016x}", least[root(i)]) for i, ((d, _), fp) in enumerate(zip(docs, fps))]


def top_k(rows: list[tuple], every: int = 50, k: int = 5) -> list[tuple]:
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def token_store(docs: list[tuple], tok) -> list[tuple]:
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def bpe(docs: list[tuple], tok) -> list[tuple]:
    out = []
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return out


def shards(docs: list[tuple], n: int = 40, seed: int = 7) -> list[tuple]:
    rows = []
    for d, t, s in docs:
        b = (t or "").encode()
        rows.append((s is not None, s or "", hashlib.md5((f"{seed}:{d}" if d is not None else f"{seed}").encode()).hexdigest(), d is not None, d or 0, zlib.crc32(b), d, len(b) + 16))
    rows.sort()
    total = Counter((r[0], r[1]) for r in rows)
    seen: Counter = Counter()
    line = []
    for r in rows:
        key = (r[0], r[1])
        line.append(((seen[key] + 0.5) / total[key], r))
        seen[key] += 1
    line.sort()
    out, slots = [], Counter()
    for i, (_, r) in enumerate(line):
        shard = i * n // len(line)
        out.append((r[6], r[7], r[5], shard, slots[shard]))
        slots[shard] += 1
    return out


def leaks(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc, item) where the document holds 0.8 of the question's five-word runs
    and 0.6 of the answer's word pairs; the answer is an item's last sentence."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())

    def share(wanted: list[str], own: list[str], n: int) -> float:
        n = min(n, len(wanted))
        runs = {tuple(wanted[i : i + n]) for i in range(len(wanted) - n + 1)} if n else set()
        held = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        return sum(r in held for r in runs) / len(runs) if runs else 1.0

    out = set()
    for i, t in items:
        parts = re.split(r"(?<=[.?!])\s+", (t or "").strip())
        question, answer = (words(" ".join(parts[:-1])), words(parts[-1])) if len(parts) > 1 else (words(t), [])
        if i is not None and question + answer:
            out |= {(d, i) for d, t in docs if share(question, words(t), 5) >= 0.8 and share(answer, words(t), 2) >= 0.6}
    return out


def licences(words: list[str], templates: list[tuple[str, list[str]]], threshold: float) -> list[tuple[str, float, int, int]]:
    """(licence, Dice, first word, last word): every window of two words or more
    with every template, the closest first, none over another."""
    pairs = lambda w: Counter(zip(w, w[1:]))
    found = []
    for name, body in templates:
        own = pairs(body)
        for a in range(len(words)):
            for b in range(a + 1, len(words)):
                run = pairs(words[a : b + 1])
                d = 2 * sum((run & own).values()) / (sum(run.values()) + sum(own.values()))
                if d >= threshold - 1e-9 and (words[a], words[a + 1]) in own and (words[b - 1], words[b]) in own:
                    found.append((-d, a, b, name))
    taken, out = set(), []
    for d, a, b, name in sorted(found):
        if taken.isdisjoint(range(a, b + 1)):
            taken |= set(range(a, b + 1))
            out.append((a, name, -d, b))
    return [(name, d, a, b) for a, name, d, b in sorted(out)]


def template_classes(pages: list[list[int]], tags: set[int], support: float = 0.5, large: int = 2, share: float = 0.9) -> set[frozenset]:
    """Token sets of the valid classes of one host's pages: equal counts on every
    page; on `share` of the pages that have it a class's tokens come in one order
    again and again, and no run of it crosses one of another valid class."""
    vectors: dict[tuple, list[int]] = {}
    for t in tags:
        vectors.setdefault(tuple(p.count(t) for p in pages), []).append(t)
    out = set()
    for vector, own in vectors.items():
        if sum(n > 0 for n in vector) < support * len(pages) or len(own) < large:
            continue
        orders = Counter()
        for p in pages:
            seen = [t for t in p if t in own]
            if seen:
                k = len(own)
                runs = {tuple(seen[i : i + k]) for i in range(0, len(seen), k)}
                orders[runs.pop() if len(runs) == 1 else None] += 1
        best, n = orders.most_common(1)[0]
        if best is not None and n >= share * sum(orders.values()):
            out.add(frozenset(own))
    return out
