"""Sampled suffixes of byte strings: the same ones in equal stretches, wherever these stand.

A window of ``LENGTH`` bytes is anchored at the place inside it whose next ``GRAM`` bytes have the smallest digest (leftmost
of equals). Equal windows have the same anchor, so two suffix arrays over anchors alone meet in every pair of equal windows.
"""

from __future__ import annotations

import numpy as np

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1
# Places inside a piece take the low bits of a key; longer texts are cut into overlapping pieces.
PLACE_BITS = 22
PIECE = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_SHIFT = np.uint64(29)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digest of two neighbouring stretches from their digests."""
    out = a * _ODD[0]
    out += b * _ODD[1]
    out ^= out >> _SHIFT
    out *= _ODD[2]
    return out


def gram_digests(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the ``GRAM`` and of the ``2 * GRAM`` bytes from every place on, by doubling."""
    level = (raw.astype(np.uint64) + np.uint64(1)) * _ODD[3]
    level ^= level >> _SHIFT
    size = 1
    gram = level
    while size < 2 * GRAM:
        level = _join(level[:-size], level[size:]) if len(level) > size else level[:0]
        size *= 2
        if size == GRAM:
            gram = level
    return gram, level


def _span_minimum(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbouring keys, from minima towards both ends of blocks of ``span``."""
    n = len(keys) - span + 1
    blocks = -(-len(keys) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


class Pieces:
    """Several texts laid end to end, with the starts of all windows that lie inside one text."""

    def __init__(self, parts: list[bytes]):
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        self.gram, self.double = gram_digests(self.raw)
        lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - LENGTH + 1, 0)
        self.part = np.repeat(np.arange(len(parts)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.window = self.starts[self.part] + within

    def window_digests(self, at: np.ndarray) -> np.ndarray:
        """Digests of the windows that start at the places ``at``."""
        return _join(self.double[at], self.double[at + (LENGTH - 2 * GRAM)])

    def anchored(self) -> dict[str, np.ndarray]:
        """One entry per run of windows with one anchor: ``part``, ``at`` (first start in the text), ``n`` (starts), ``off``
        (anchor behind the first start), ``gram`` (digest of the anchor's bytes), ``context`` (digest of all bytes of the
        run's windows and of where the anchor stands in them)."""
        if not len(self.window):
            none = np.zeros(0, np.int64)
            return dict.fromkeys(("part", "at", "n", "off", "start"), none) | dict.fromkeys(("gram", "context"), none.astype(np.uint64))
        low = np.uint64((1 << PLACE_BITS) - 1)
        keys = (self.gram & ~low) | np.arange(len(self.gram), dtype=np.uint64)
        anchor = (_span_minimum(keys, SPAN)[self.window] & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (self.part[1:] != self.part[:-1])))
        n = np.diff(np.append(first, len(anchor)))
        start, place, part = self.window[first], anchor[first], self.part[first]
        end = start + n + LENGTH - 1
        middle = (start + end) // 2 - GRAM
        context = _join(_join(self.double[start], self.double[middle]), self.double[end - 2 * GRAM])
        context = _join(context, (n * 1024 + place - start).astype(np.uint64))
        return {
            "part": part, "at": start - self.starts[part], "n": n, "off": place - start, "start": start,
            "gram": self.gram[place], "context": context,
        }


def cut(text: bytes) -> list[tuple[int, bytes]]:
    """``first byte, bytes`` of the pieces of a text; neighbours overlap so that each window lies in exactly one."""
    if len(text) <= PIECE + LENGTH - 1:
        return [(0, text)]
    return [(a, text[a : a + PIECE + LENGTH - 1]) for a in range(0, len(text) - LENGTH + 1, PIECE)]
