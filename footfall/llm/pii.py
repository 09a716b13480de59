"""Personal data found by patterns and by a skip-chain conditional random field.

Four patterns give the base spans, which always stay. The field labels pieces of the text (runs of letters and digits, single
signs) with the kind of data they belong to. Neighbours in a window are linked, and so is every long piece with digits to
the next piece of the same letters and digits in the document (skip edges; one per occurrence, never all pairs). Base spans are
observed labels. Loopy message passing carries them along both kinds of edges, so a number or name that the patterns
caught once is labelled alike where it stands without its telling signs. Runs of pieces of one kind in which every piece is
sure enough are added.

The weights are fitted by pseudo-likelihood on a bounded sample of documents (``TRAIN_DOCUMENTS``) of the whole table, with base spans and without.
Null and empty texts have no spans; with an empty sample the field adds nothing; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from footfall.llm.common import map_batches
from footfall.llm.crf import PIECE, TOKEN, TRAIN_PIECES, adam, labelled_sample, log_sum, stretch, windows

KINDS = ("email", "ip", "card", "phone")
OUT = len(KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SITE = re.compile(r"[0-9@]")
REACH = 3
STEPS = 150
PENALTY = 1e-3
ROUNDS = 40
SETTLED = 1e-4
SURE = 0.9
# Prior mean of the skip potential for equal labels; the sample moves it where it has repeated pieces.
CONSISTENCY = 4.0
LEAST_CHARS = 7

FEATURES = (
    "bias letters digits mixed sign len1 len2 len3 len4_6 len7_12 len13 at_good at_bad quad_good quad_bad "
    "run_luhn run_not_luhn run_short plus_here plus_before bracket dashes dots only_digits first last is_at is_dot is_plus"
).split()
_ID = {name: k for k, name in enumerate(FEATURES)}
_QUAD = re.compile(r"(?<![0-9.])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)(?![0-9])")
_DIGIT_WORD = re.compile(r"[0-9-]+")


def small(part: str) -> bool:
    """Whether a run of digits is at most 255, whatever its length."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, looked for at each ``@`` so that long runs cost no backtracking."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind number, start, end`` by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if SITE.search(text):
        if "." in text:
            found += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m.groups()))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def _word_features(words: list[str]) -> list[list[str]]:
    """Names of the features that all pieces of a blank-separated word share."""
    names: list[list[str]] = []
    for w in words:
        own = []
        if "@" in w:
            left, _, right = w.partition("@")
            own.append("at_good" if left and DOMAIN.match(right) else "at_bad")
        quad = _QUAD.search(w) if w.count(".") >= 3 else None
        if quad:
            own.append("quad_good" if all(map(small, quad.groups())) else "quad_bad")
        own += [n for n, c in (("plus_here", "+"), ("bracket", "("), ("dashes", "-"), ("dots", ".")) if c in w]
        if w.isascii() and w.isdigit():
            own.append("only_digits")
        names.append(own)
    for i in range(len(words)):
        if any("plus_here" in n for n in names[max(0, i - 2) : i]):
            names[i].append("plus_before")
    i = 0
    while i < len(words):
        if not _DIGIT_WORD.fullmatch(words[i].rstrip(".,;:!?")):
            i += 1
            continue
        j = i
        while j < len(words) and _DIGIT_WORD.fullmatch(words[j].rstrip(".,;:!?")):
            j += 1
        digits = "".join(c for w in words[i:j] for c in w if c.isdigit())
        kind = "run_short" if not 16 <= len(digits) <= 19 else "run_luhn" if luhn(digits) else "run_not_luhn"
        for k in range(i, j):
            names[k].append(kind)
        i = j
    return names


def pieces_of(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[int]]:
    """Places, active features and window numbers of all pieces in a text's windows."""
    places, features, numbers = [], [], []
    for number, (start, end) in enumerate(windows(text, SITE, REACH)):
        tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        shared = _word_features([text[a:b] for a, b in tokens])
        for (a, b), names in zip(tokens, shared, strict=True):
            inside = [m.span() for m in PIECE.finditer(text, a, b)]
            for k, (u, v) in enumerate(inside):
                w = text[u:v]
                own = ["bias"]
                if w.isascii() and w.isalnum():
                    letters, digits = not w.isdigit(), any(c.isdigit() for c in w)
                    own.append("mixed" if letters and digits else "letters" if letters else "digits")
                    n = len(w)
                    own.append("len1" if n == 1 else "len2" if n == 2 else "len3" if n == 3 else "len4_6" if n < 7 else "len7_12" if n < 13 else "len13")
                else:
                    own.append("sign")
                    own += [n for n, c in (("is_at", "@"), ("is_dot", "."), ("is_plus", "+")) if w == c]
                own += ["first"] * (k == 0) + ["last"] * (k == len(inside) - 1)
                places.append((u, v))
                features.append([_ID[n] for n in {*own, *names}])
                numbers.append(number)
    return places, features, numbers


def edges_of(text: str, places: list[tuple[int, int]], numbers: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges inside windows and skip edges from each telling piece to its next occurrence in the text."""
    chain = [(i, i + 1) for i in range(len(places) - 1) if numbers[i] == numbers[i + 1]]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b) in enumerate(places):
        word = text[a:b]
        if b - a >= 3 and any(c in "0123456789" for c in word):
            word = word.lower()
            if word in last:
                skip.append((last[word], i))
            last[word] = i
    return chain, skip


def observed(places: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """The kind of the base span that a piece lies in, or ``OUT``; of two kinds the first listed."""
    tags = [OUT] * len(places)
    starts = [a for a, _ in places]
    for kind, u, v in sorted(base, reverse=True):
        for i in range(int(np.searchsorted(starts, u)), len(places)):
            if places[i][0] >= v:
                break
            tags[i] = kind
    return tags


def labelled(text: str) -> tuple | None:
    """One document of the sample: features, tags and edges of at most ``TRAIN_PIECES`` pieces."""
    places, features, numbers = pieces_of(text)
    if not places:
        return None
    tags = observed(places, base_spans(text))
    part = stretch(tags, OUT, TRAIN_PIECES)
    places, numbers = places[part], numbers[part]
    return features[part], tags[part], *edges_of(text, places, numbers)


def sort_of(text: str) -> int:
    """2 for a text with base spans, 1 for another one with pieces to label, else 0."""
    return 2 if base_spans(text) else 1 if SITE.search(text) else 0


class Field:
    """Weights: ``emit`` by feature and kind, ``chain`` and ``skip`` by the kinds at both ends of an edge."""

    def __init__(self, emit: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.emit, self.chain, self.skip = emit, chain, skip

    def marginals(self, score: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Beliefs of all nodes by loopy message passing, every message of a round at once, damped by half.

        Messages settle after as many rounds as the longest loop-free stretch has pieces, or stop after ``ROUNDS``.
        """
        source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        c, s = len(chain), len(skip)
        reverse = np.concatenate([np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(s, 2 * s), 2 * c + np.arange(s)])
        table = np.concatenate([
            np.broadcast_to(self.chain, (c, *self.chain.shape)),
            np.broadcast_to(self.chain.T, (c, *self.chain.shape)),
            np.broadcast_to(self.skip, (s, *self.skip.shape)),
            np.broadcast_to(self.skip.T, (s, *self.skip.shape)),
        ])
        kinds = score.shape[1]
        message = np.zeros((len(source), kinds))
        belief = score
        for _ in range(ROUNDS if len(source) else 0):
            away = belief[source] - message[reverse]
            new = log_sum(away[:, :, None] + table, 1)
            new = 0.5 * message + 0.5 * (new - log_sum(new, 1)[:, None])
            moved = np.abs(new - message).max()
            message = new
            belief = score + np.stack(
                [np.bincount(target, weights=message[:, k], minlength=len(score)) for k in range(kinds)], axis=1
            )
            if moved < SETTLED:
                break
        return np.exp(belief - log_sum(belief, 1)[:, None])


def fit(sample: list[tuple]) -> Field | None:
    """Pseudo-likelihood: each piece is predicted from its features and the labels at the other ends of its edges."""
    if not any(tag != OUT for _, tags, _, _ in sample for tag in tags):
        return None
    kinds, size = OUT + 1, len(FEATURES)
    x = np.zeros((sum(len(t) for _, t, _, _ in sample), size), np.float32)
    tags = np.concatenate([np.array(t) for _, t, _, _ in sample])
    gold = np.eye(kinds)[tags]
    chains, skips, base = [], [], 0
    for features, own, chain, skip in sample:
        for k, active in enumerate(features):
            x[base + k, active] = 1
        chains += [(a + base, b + base) for a, b in chain]
        skips += [(a + base, b + base) for a, b in skip]
        base += len(own)

    def neighbours(edges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """How many neighbours of each kind a node has to its left and to its right."""
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        left, right = np.zeros((base, kinds)), np.zeros((base, kinds))
        np.add.at(left, pairs[:, 1], gold[pairs[:, 0]])
        np.add.at(right, pairs[:, 0], gold[pairs[:, 1]])
        return left, right

    (chain_left, chain_right), (skip_left, skip_right) = neighbours(chains), neighbours(skips)
    square = kinds * kinds
    prior = np.zeros((size + 2 * kinds) * kinds)
    prior[-square:] = CONSISTENCY * np.eye(kinds).ravel()

    def gradient(value: np.ndarray) -> np.ndarray:
        emit = value[: size * kinds].reshape(size, kinds)
        chain = value[size * kinds : -square].reshape(kinds, kinds)
        skip = value[-square:].reshape(kinds, kinds)
        score = x @ emit + chain_left @ chain + chain_right @ chain.T + skip_left @ skip + skip_right @ skip.T
        miss = np.exp(score - log_sum(score, 1)[:, None]) - gold
        slopes = (
            (x.T @ miss).ravel(),
            (chain_left.T @ miss + (chain_right.T @ miss).T).ravel(),
            (skip_left.T @ miss + (skip_right.T @ miss).T).ravel(),
        )
        return np.concatenate(slopes) / base + PENALTY * (value - prior)

    value = adam(gradient, prior.copy(), STEPS)
    return Field(
        value[: size * kinds].reshape(size, kinds),
        value[size * kinds : -square].reshape(kinds, kinds),
        value[-square:].reshape(kinds, kinds),
    )


def spans_of(texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    """Base spans and all spans of each text; the texts' graphs are passed through together."""
    bases = [base_spans(t) for t in texts]
    if field is None:
        return [(base, base) for base in bases]
    graphs, chains, skips, total = [], [], [], 0
    for number, text in enumerate(texts):
        if not SITE.search(text):
            continue
        places, features, numbers = pieces_of(text)
        chain, skip = edges_of(text, places, numbers)
        chains += [(a + total, b + total) for a, b in chain]
        skips += [(a + total, b + total) for a, b in skip]
        graphs.append((number, total, places, numbers, features, observed(places, bases[number])))
        total += len(places)
    added: dict[int, list] = {}
    if total:
        score = np.concatenate([[field.emit[f].sum(axis=0) for f in g[4]] for g in graphs if g[4]])
        tags = np.concatenate([np.array(g[5], np.int64) for g in graphs])
        # A piece of a base span is observed: no other label has any weight there.
        fixed = tags != OUT
        score[fixed] = np.where(np.arange(OUT + 1)[None, :] == tags[fixed][:, None], 0.0, -50.0)
        edges = [np.array(e, np.int64).reshape(-1, 2) for e in (chains, skips)]
        belief = field.marginals(score, *edges)
        for number, first, places, numbers, _, own in graphs:
            found = _sure_runs(places, numbers, own, belief[first : first + len(places)])
            added[number] = [s for s in found if any(c.isdigit() or c == "@" for c in texts[number][s[1] : s[2]])]
    return [(base, sorted([*base, *added.get(k, [])])) for k, base in enumerate(bases)]


def _sure_runs(places: list, numbers: list[int], own: list[int], belief: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs of unobserved pieces that are surely of one kind, from the first to the last of letters or digits."""
    best, sure = belief.argmax(axis=1).tolist(), (belief.max(axis=1) >= SURE).tolist()
    free = [sure[i] and best[i] != OUT and own[i] == OUT for i in range(len(places))]
    found = []
    i = 0
    while i < len(places):
        if not free[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(places) and free[j + 1] and best[j + 1] == best[i] and numbers[j + 1] == numbers[i]:
            j += 1
        if places[j][1] - places[i][0] >= LEAST_CHARS:
            found.append((best[i], places[i][0], places[j][1]))
        i = j + 1
    return found


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in found)


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans``: one row per row of ``df``.

    The counts are those of the base spans.
    """
    field = fit(labelled_sample(df, key, text, labelled, sort_of))

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            found = spans_of([t or "" for t in texts], field)
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in range(4)]
            more = [len(every) - len(base) for base, every in found]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield [keys, *counts, more, digests, [_joined(every) for _, every in found]]

    schema = (
        f"`{key}` bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, "
        "base_sha256 string, spans string"
    )
    return map_batches(df, [key, text], run, schema)
