"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_base(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    signs = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), signs, len(lines) - len(set(lines)), len(covered), failed


def shingles(text: str | None, width: int) -> frozenset:
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(lower)
    if len(words) <= width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def jaccard_components(documents: list[tuple[int, str | None]], width: int = 3, percent: int = 90) -> dict:
    """doc_id to (set size, smallest document reachable)."""
    sets = {d: shingles(t, width) for d, t in documents}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = components(list(sets), links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def base_personal(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        (1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(x) <= 255 for x in m[0].split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(map(int, str(int(c) * (2 if i % 2 else 1)))) for i, c in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = rf"""({letters})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def repeated_lines(documents: list[tuple[int, str | None]], min_words: int = 5) -> dict[int, set[int]]:
    """doc_id to the numbers of the lines that go: runs of ``min_words`` words with an earlier copy."""
    texts = [(d, [(i, x, len(x.encode().split())) for i, x in enumerate((t or "").split("\n")) if x.encode().split()])
             for d, t in sorted(documents)]
    places = defaultdict(list)
    for a, (_, lines) in enumerate(texts):
        for i, x in enumerate(lines):
            places[x[1]].append((a, i))
    gone = defaultdict(set)
    for a, (d, lines) in enumerate(texts):
        for i in range(len(lines)):
            best = 0
            for b, j in places[lines[i][1]]:
                if (b, j) >= (a, i):
                    break
                other, n = texts[b][1], 0
                while i + n < len(lines) and j + n < len(other) and lines[i + n][1] == other[j + n][1]:
                    n += 1
                best = max(best, n)
            if best and sum(x[2] for x in lines[i : i + best]) >= min_words:
                gone[d] |= {x[0] for x in lines[i : i + best]}
    return gone


def repeated_bytes(texts: list[bytes], length: int = 200) -> list[tuple[int, int, int, str]]:
    """Per text: bytes, bytes removed, runs removed, digest of what is left."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mix(sizes: list[tuple[int, str | None, int]]) -> dict:
    """source to (source size, target) by repeated clamping and sharing."""
    totals = defaultdict(int)
    for _, source, size in sizes:
        totals[source] += size
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(totals.values()), {}, set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * totals[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= set(over)
    return {s: (totals[s], target[s]) for s in order}
