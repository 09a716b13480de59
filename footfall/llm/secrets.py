"""Secrets found by patterns and by a linear-chain conditional random field.

Three patterns give the base spans, which always stay. The field tags the pieces of the text (runs of letters and digits,
single signs) as secret begin, inside or outside, from their shape, the words near them and features of the whole file; Viterbi
decodes the best tagging. It is fitted by maximum likelihood on a bounded sample of documents (``TRAIN_DOCUMENTS``) of the whole
table, with base spans and without; its chains there are the stretches round digits and ``=`` (``crf.windows``). Tagged is every document
whole: each line is one chain, of all its pieces. What is found beside the base spans is added under the kind ``secret``.

Features and scores are computed for all pieces of a batch by arrays. Where a bound on all tags of the neighbours shows that every best tagging
has the outside label, the chain falls apart; the stretches between are decoded in step. The tagging is that of the whole chains.

Null and empty texts have no spans. Without any sample (empty table, or nothing labelled) the field adds nothing. Repeated
rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from footfall.llm.common import map_batches
from footfall.llm.crf import PIECE, TRAIN_PIECES, adam, labelled_sample, log_sum, stretch, windows

KINDS = ("assign", "access", "hex", "secret")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_TO_HEX = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
_RUN = b"1" * 24

SITE = re.compile(r"[0-9=]")
REACH = 3
OUT, BEGIN, INSIDE = 0, 1, 2
KEYWORD = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|key|credential|auth|bearer", re.IGNORECASE | re.ASCII)
STEPS = 120
# Pieces of one window that the field is fitted on.
LONGEST = 64
PENALTY = 1e-3
# How much surer than its runner-up (all outside) a found stretch has to be, in log odds.
MARGIN = 2.0

FEATURES = (
    "bias letters digits mixed sign quote assigns upper lower hex akia len1_5 len6_11 len12_19 len20_31 len32 "
    "turns4 turns8 keyword_near keyword_here assigns_before quote_before quote_after dots_near digit_neighbour "
    "file_assigns file_keyword file_braces first_in_window alone"
).split()
_ID = {name: k for k, name in enumerate(FEATURES)}
KEYWORDS = ("pass", "password", "passwd", "passphrase", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
# Characters of texts whose pieces are looked at together; a longer text is a batch of its own.
BATCH_CHARS = 1 << 20
# Bits of the kinds of a character.
_LETTER, _UPPER, _DIGIT, _HEX, _SPACE, _DIGIT_LIKE = 1, 2, 4, 8, 16, 32


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` of the pattern matches, sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_TO_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _turns(piece: str) -> int:
    """Changes between letters and digits, a cheap measure of randomness."""
    kinds = [c.isdigit() for c in piece]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def file_features(text: str) -> list[int]:
    names = []
    if "=" in text:
        names.append("file_assigns")
        if KEYWORD.search(text):
            names.append("file_keyword")
    if "{" in text or ";" in text:
        names.append("file_braces")
    return [_ID[n] for n in names]


def window_pieces(text: str, start: int, end: int, file: list[int]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Places and active features of the pieces of one window."""
    places = [m.span() for m in PIECE.finditer(text, start, end)]
    words = [text[a:b] for a, b in places]
    features = []
    for i, w in enumerate(words):
        names = ["bias"]
        if w[0].isascii() and w[0].isalnum():
            letters, digits = any(c.isalpha() for c in w), any(c.isdigit() for c in w)
            names.append("mixed" if letters and digits else "letters" if letters else "digits")
            n = len(w)
            names.append("len1_5" if n < 6 else "len6_11" if n < 12 else "len12_19" if n < 20 else "len20_31" if n < 32 else "len32")
            if w.startswith("AKIA"):
                names.append("akia")
            if letters and digits:
                names.append("upper" if w.upper() == w else "lower" if w.lower() == w else "mixed")
                if n >= 12 and all(c in "0123456789abcdefABCDEF" for c in w):
                    names.append("hex")
                turns = _turns(w)
                names += [name for name, least in (("turns4", 4), ("turns8", 8)) if turns >= least]
            if KEYWORD.fullmatch(w):
                names.append("keyword_here")
        else:
            names.append("quote" if w in "\"'" else "assigns" if w in "=:" else "sign")
        before = words[max(0, i - 4) : i]
        if any(KEYWORD.fullmatch(x) for x in before):
            names.append("keyword_near")
        if any(x in ("=", ":") for x in before[-2:]):
            names.append("assigns_before")
        if before and before[-1] in ("'", '"'):
            names.append("quote_before")
        if i + 1 < len(words) and words[i + 1] in ("'", '"'):
            names.append("quote_after")
        if "." in before[-1:] or "." in words[i + 1 : i + 2]:
            names.append("dots_near")
        if any(x.isdigit() for x in before[-1:] + words[i + 1 : i + 2]):
            names.append("digit_neighbour")
        if i == 0:
            names.append("first_in_window")
        a, b = places[i]
        if (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace()):
            names.append("alone")
        features.append(sorted({_ID[n] for n in names} | set(file)))
    return places, features


class Pieces(NamedTuple):
    """All pieces of some texts: places in their texts, active features (a bit for each), number of the text, and the first of each line."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    text: np.ndarray
    first: np.ndarray


@cache
def _kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for at in range(0x110000):
        c = chr(at)
        if at < 128:
            kinds[at] = _LETTER * c.isalpha() + _UPPER * c.isupper() + _DIGIT * c.isdigit() + _HEX * (c in "0123456789abcdefABCDEF")
        kinds[at] += _SPACE * c.isspace() + _DIGIT_LIKE * c.isdigit()
    return kinds


@cache
def _keyword_shapes() -> np.ndarray:
    """Whether a keyword has this length, first and last character."""
    shapes = np.zeros((16, 128, 128), bool)
    for word in KEYWORDS:
        for a in (word[0], word[0].upper()):
            for b in (word[-1], word[-1].upper()):
                shapes[len(word), ord(a), ord(b)] = True
    return shapes


def _shifted(marks: np.ndarray, by: int, same: np.ndarray) -> np.ndarray:
    """The marks of the pieces ``by`` places before (after, if negative), false where those are of another line."""
    out = np.zeros_like(marks)
    if by > 0:
        out[by:] = marks[:-by] & (same[by:] == same[:-by])
    else:
        out[:by] = marks[-by:] & (same[:by] == same[-by:])
    return out


def pieces_of(texts: list[str]) -> Pieces:
    """What ``window_pieces`` finds in every line of every text, by arrays."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    word = (kinds & (_LETTER | _DIGIT)) > 0
    after_word = np.append(False, word[:-1]) if len(word) else word
    start = np.flatnonzero(((kinds & _SPACE) == 0) & ~(word & after_word))
    is_word = word[start]
    breaks = np.flatnonzero(~word)
    end = start + 1
    if is_word.any():
        stops = np.append(breaks, len(codes))
        end = np.where(is_word, stops[np.searchsorted(stops, start)], end)

    def held(marks: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(marks))
        return upto[end] - upto[start]

    n = end - start
    digits, letters = held((kinds & _DIGIT) > 0), held((kinds & _LETTER) > 0)
    upper, hexes = held((kinds & _UPPER) > 0), held((kinds & _HEX) > 0)
    is_digit = (kinds & _DIGIT) > 0
    changes = np.append(0, np.cumsum(is_digit[1:] != is_digit[:-1])) if len(codes) else np.zeros(0, np.int64)
    turns = changes[end - 1] - changes[start] if len(start) else start
    mixed = is_word & (digits > 0) & (letters > 0)
    line = np.append(0, np.cumsum(codes == 10))[start]
    sign = np.where(is_word, 0, codes[start]) if len(start) else start
    quote, assigns, dot = (sign == 34) | (sign == 39), (sign == 61) | (sign == 58), sign == 46
    all_digits = np.where(is_word, digits == n, (kinds[start] & _DIGIT_LIKE) > 0)
    shaped = is_word & (n < 16)
    shaped[shaped] = _keyword_shapes()[n[shaped], codes[start[shaped]], codes[end[shaped] - 1]]
    keyword = shaped
    for k in np.flatnonzero(shaped):
        keyword[k] = joined[start[k] : end[k]].lower() in KEYWORDS
    akia = is_word & (n >= 4) & (codes[start] == 65)
    for k in np.flatnonzero(akia):
        akia[k] = joined.startswith("AKIA", start[k])
    blank = np.append((kinds & _SPACE) > 0, True)
    first = np.append(True, line[1:] != line[:-1]) if len(line) else np.zeros(0, bool)
    own = {
        "bias": np.ones(len(start), bool), "letters": is_word & (digits == 0), "digits": is_word & (letters == 0),
        "sign": ~is_word & ~quote & ~assigns, "quote": quote, "assigns": assigns,
        "upper": mixed & (upper == letters), "lower": mixed & (upper == 0), "mixed": mixed, "hex": mixed & (n >= 12) & (hexes == n),
        "akia": akia, "len1_5": is_word & (n < 6), "len6_11": is_word & (n >= 6) & (n < 12), "len12_19": is_word & (n >= 12) & (n < 20),
        "len20_31": is_word & (n >= 20) & (n < 32), "len32": is_word & (n >= 32), "turns4": mixed & (turns >= 4), "turns8": mixed & (turns >= 8),
        "keyword_near": np.logical_or.reduce([_shifted(keyword, by, line) for by in (1, 2, 3, 4)]), "keyword_here": keyword,
        "assigns_before": _shifted(assigns, 1, line) | _shifted(assigns, 2, line),
        "quote_before": _shifted(quote, 1, line), "quote_after": _shifted(quote, -1, line),
        "dots_near": _shifted(dot, 1, line) | _shifted(dot, -1, line),
        "digit_neighbour": _shifted(all_digits, 1, line) | _shifted(all_digits, -1, line),
        "first_in_window": first, "alone": blank[start - 1] & blank[end],
    }
    features = np.zeros(len(start), np.int32)
    for name, marks in own.items():
        features |= marks.astype(np.int32) << _ID[name]
    lengths = np.array([len(t) + 1 for t in texts])
    borders = np.cumsum(lengths)
    text = np.searchsorted(borders, start, "right")
    features |= np.array([sum(1 << f for f in file_features(t)) for t in texts], np.int32)[text]
    begins = borders - lengths
    return Pieces(start - begins[text], end - begins[text], features, text, first)


def labelled(text: str) -> list[tuple[list[list[int]], list[int]]] | None:
    """Windows of a text with the tags that its base spans give; the value of an assignment counts, not its keyword."""
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    values += [(a, b) for a, kind, b in base_spans(text) if kind]
    made = []
    for start, end in windows(text, SITE, REACH):
        places, features = window_pieces(text, start, end, file_features(text))
        tags = [OUT] * len(places)
        for i, (a, b) in enumerate(places):
            for u, v in values:
                if u <= a and b <= v:
                    tags[i] = BEGIN if a == u or i == 0 or tags[i - 1] == OUT else INSIDE
        if features:
            part = stretch(tags, OUT, LONGEST)
            made.append((features[part], tags[part]))
    # Windows with a secret come first into the bound.
    made.sort(key=lambda m: not any(m[1]))
    return made[:TRAIN_PIECES] or None


def sort_of(text: str) -> int:
    """2 for a text with base spans inside its windows, 1 for another one with windows, else 0."""
    if not SITE.search(text):
        return 0
    return 2 if any(SITE.search(text, a, b) for a, _, b in base_spans(text)) else 1


class Chain:
    """Weights of the linear chain: ``emit`` by feature and tag, ``move`` by tag and next tag, ``start`` by first tag."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start
        self.move[OUT, INSIDE] = self.start[INSIDE] = -1e6

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in features])

    def best(self, features: list[list[int]]) -> tuple[list[int], np.ndarray]:
        """The best tagging by Viterbi and the emission scores."""
        scores = self.scores(features)
        best, back = self.start + scores[0], []
        for row in scores[1:]:
            total = best[:, None] + self.move
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        tags = [int(best.argmax())]
        for choice in reversed(back):
            tags.append(int(choice[tags[-1]]))
        return tags[::-1], scores

    def scores_of(self, features: np.ndarray) -> np.ndarray:
        """The same of features held as bits, by sums for all values of half of the bits."""
        half = (len(self.emit) + 1) // 2
        total = 0.0
        for emit, bits in ((self.emit[:half], features & ((1 << half) - 1)), (self.emit[half:], features >> half)):
            sums = np.zeros((1, 3))
            for row in emit:
                sums = np.concatenate([sums, sums + row])
            total = total + sums[bits]
        return total

    def open(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pieces for which it is not certain that every best tagging of their lines has the outside label.

        Certain is where any other label, whatever its neighbours' labels, loses against the outside one; a piece inside that follows
        then becomes a begin.
        """
        if not len(scores):
            return first
        last = np.append(first[1:], True)
        to_begin = np.append(scores[1:, BEGIN] - scores[1:, INSIDE], 0.0)
        begun = min(0.0, (self.move[BEGIN] - self.move[INSIDE]).min())
        uncertain = np.zeros(len(scores), bool)
        for tag in (BEGIN, INSIDE):
            before = np.where(first, self.start[OUT] - self.start[tag], (self.move[:, OUT] - self.move[:, tag]).min())
            plain = min(self.move[OUT, OUT] - self.move[tag, OUT], self.move[OUT, BEGIN] - self.move[tag, BEGIN])
            moved = to_begin + self.move[OUT, BEGIN] - self.move[tag, INSIDE] + begun
            after = np.where(last, 0.0, np.minimum(plain, moved))
            uncertain |= scores[:, OUT] - scores[:, tag] + before + after <= 1e-6
        return uncertain

    def tag_lines(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of the pieces of many lines; ``first`` marks where one begins. Open stretches are decoded in step."""
        tags = np.full(len(scores), OUT, np.int8)
        held = self.open(scores, first)
        begins = np.flatnonzero(held & (first | ~np.append(False, held[:-1])))
        if not len(begins):
            return tags
        ends = np.flatnonzero(held & np.append(first[1:] | ~held[1:], True)) + 1
        order = np.argsort(begins - ends, kind="stable")
        begins, sizes = begins[order], (ends - begins)[order]
        best = np.where(first[begins][:, None], self.start, self.move[OUT]) + scores[begins]
        back = np.zeros((len(scores), 3), np.int8)
        # Stretches by falling length: those that go on at a step are the first ones.
        going = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        for step in range(1, sizes[0]):
            k = going[step]
            total = best[:k, :, None] + self.move
            at = begins[:k] + step
            back[at] = total.argmax(axis=1)
            best[:k] = total.max(axis=1) + scores[at]
        follows = np.append(~first[1:], False)[begins + sizes - 1]
        best += np.where(follows[:, None], self.move[:, OUT], 0.0)
        tags[begins + sizes - 1] = best.argmax(axis=1)
        for step in range(sizes[0] - 1, 0, -1):
            at = begins[: going[step]] + step
            tags[at - 1] = back[at, tags[at]]
        return tags


def fit(windows_of: list[tuple[list[list[int]], list[int]]], longest: int = LONGEST) -> Chain | None:
    """Maximum likelihood with a square penalty; forward and backward sums run over all windows in step."""
    rows = [(f[:longest], t[:longest]) for f, t in windows_of if f]
    if not rows or not any(BEGIN in t for _, t in rows):
        return None
    n, longest, size = len(rows), max(len(f) for f, _ in rows), len(FEATURES)
    x = np.zeros((n, longest, size), np.float32)
    y = np.zeros((n, longest), np.int64)
    there = np.zeros((n, longest), bool)
    for i, (features, tags) in enumerate(rows):
        for k, active in enumerate(features):
            x[i, k, active] = 1
        y[i, : len(tags)], there[i, : len(tags)] = tags, True
    gold = np.eye(3)[y] * there[:, :, None]
    both = there[:, 1:]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1] * both[:, :, None], gold[:, 1:])
    gold_emit = np.einsum("ntf,nta->fa", x, gold)

    def gradient(value: np.ndarray) -> np.ndarray:
        chain = Chain(value[: 3 * size].reshape(size, 3), value[3 * size : -3].reshape(3, 3).copy(), value[-3:].copy())
        score = x @ chain.emit
        forward = np.zeros((n, longest, 3))
        backward = np.zeros((n, longest, 3))
        forward[:, 0] = chain.start + score[:, 0]
        for k in range(1, longest):
            step = log_sum(forward[:, k - 1, :, None] + chain.move, 1) + score[:, k]
            forward[:, k] = np.where(there[:, k, None], step, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = log_sum(chain.move + (score[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(there[:, k + 1, None], step, 0.0)
        total = log_sum(forward[:, -1], 1)
        one = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        two = np.exp(
            forward[:, :-1, :, None] + chain.move + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * both[:, :, None, None]
        parts = (
            (np.einsum("ntf,nta->fa", x, one) - gold_emit).ravel(),
            (two.sum(axis=(0, 1)) - gold_moves).ravel(),
            (one[:, 0] - gold[:, 0]).sum(axis=0),
        )
        return np.concatenate(parts) / n + PENALTY * value

    value = adam(gradient, np.zeros(3 * size + 12), STEPS)
    return Chain(value[: 3 * size].reshape(size, 3), value[3 * size : -3].reshape(3, 3), value[-3:])


def spans(text: str, chain: Chain | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text as ``start, kind number, end``."""
    return spans_of([text], chain)[0]


def spans_of(texts: list[str], chain: Chain | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """The same of many texts, all pieces of which are tagged together."""
    bases = [base_spans(text) for text in texts]
    if chain is None:
        return [(base, base) for base in bases]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces = pieces_of(texts)
    scores = chain.scores_of(pieces.features)
    tags = chain.tag_lines(scores, pieces.first)
    for i in np.flatnonzero(tags == BEGIN).tolist():
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE:
            j += 1
        a, b, text = int(pieces.start[i]), int(pieces.end[j - 1]), pieces.text[i]
        sure = sum(scores[k, tags[k]] - scores[k, OUT] for k in range(i, j))
        if b - a >= 8 and sure >= MARGIN and not any(u < b and a < v for u, _, v in bases[text]):
            added[text].append((a, 3, b))
    return [(base, sorted(base + more)) for base, more in zip(bases, added, strict=True)]


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, n_added, base_sha256, spans``: one row per row of ``df``."""
    chain = fit([w for made in labelled_sample(df, key, text, labelled, sort_of) for w in made])

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            found = [f for part in _batches([t or "" for t in texts]) for f in spans_of(part, chain)]
            counts = [[sum(s[1] == kind for s in every) for _, every in found] for kind in range(4)]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield [keys, *counts, digests, [_joined(every) for _, every in found]]

    schema = (
        f"`{key}` bigint, n_assign bigint, n_access bigint, n_hex bigint, n_added bigint, base_sha256 string, spans string"
    )
    return map_batches(df, [key, text], run, schema)
