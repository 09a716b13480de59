"""What the two random-field taggers share: windows of a text, pieces, gradient steps, the bounded training sample."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_batches

PIECE = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
TOKEN = re.compile(r"\S+")
# Documents that a tagger is fitted on, and pieces of one of them: bounds of the labelled sample only.
TRAIN_DOCUMENTS = 2_000
TRAIN_PIECES = 400
# Ranges of key digests by which the documents are counted, and digests in one.
RANGES = 1 << 14
RANGE = 1 << 16


def windows(text: str, site: re.Pattern, reach: int) -> list[tuple[int, int]]:
    """Stretches of ``reach`` blank-separated words to both sides of every match of ``site``, inside its line.

    All pieces outside hold the outside label for certain (a hard potential), so a chain falls apart there and labelling
    the stretches is labelling the whole text.
    """
    found: list[tuple[int, int]] = []
    done = 0
    while match := site.search(text, done):
        at = match.start()
        start, end = at, match.end()
        for _ in range(reach + 1):
            start = text.rfind(" ", done, start)
            if start < 0:
                break
        start = done if start < 0 else start + 1
        start = max(start, text.rfind("\n", start, at) + 1)
        end -= 1
        for _ in range(reach + 1):
            end = text.find(" ", end + 1)
            if end < 0:
                break
        end = len(text) if end < 0 else end
        line = text.find("\n", at, end)
        end = max(match.end(), end if line < 0 else line)
        if found and start <= found[-1][1] + 1 and "\n" not in text[found[-1][1] : start]:
            found[-1] = (found[-1][0], end)
        else:
            found.append((start, end))
        done = end
    return found


def adam(gradient: Callable[[np.ndarray], np.ndarray], value: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Minimiser by Adam steps from ``value``; ``gradient`` gives the slope at a parameter vector."""
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        slope = gradient(value)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        value = value - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return value


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def share(positive: int, negative: int, documents: int) -> tuple[int, int]:
    """How many of each sort a sample takes: as they stand in the table, but a quarter with spans as far as there are so many."""
    natural = round(documents * positive / max(1, positive + negative))
    own = min(positive, max(documents // 4, natural, documents - negative))
    return own, min(negative, documents - own)


def labelled_sample(
    df: DataFrame, key: str, text: str, label: Callable[[str], object | None], sort: Callable[[str], int], documents: int = TRAIN_DOCUMENTS
) -> list:
    """What ``label`` makes of at most ``documents`` documents of the whole table, those with the smallest digests of their keys.

    ``sort`` tells of a text whether it has a span to learn from (2), only places where one could be (1), or neither (0). A first pass
    counts both sorts by ranges of digests; the second one labels only documents of the ranges that fill the sample.
    """
    digest = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`"), F.lit(-1))), F.lit(RANGES * RANGE))
    docs = df.select(digest.alias("digest"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for digests, texts in batches:
            yield [[sort(t or "") for t in texts], [d // RANGE for d in digests]]

    counted = map_batches(docs, ["digest", "text"], count, "sort int, part bigint").where("sort > 0")
    sizes = sorted((r["sort"], r["part"], r["n"]) for r in counted.groupBy("sort", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    wanted = dict(zip((2, 1), share(*(sum(n for s, _, n in sizes if s == k) for k in (2, 1)), documents), strict=True))
    bounds = {1: 0, 2: 0}
    found = {1: 0, 2: 0}
    for kind, part, n in sizes:
        if found[kind] < wanted[kind]:
            found[kind] += n
            bounds[kind] = (part + 1) * RANGE

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for digests, keys, texts in batches:
            rows = []
            for d, k, t in zip(digests, keys, texts, strict=True):
                kind = sort(t or "")
                if kind and d < bounds[kind]:
                    rows.append((kind, d, k, pickle.dumps(label(t or ""))))
            yield [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

    near = docs.where(F.col("digest") < max(bounds.values()))
    labelled = map_batches(near, ["digest", "key", "text"], run, "kind int, digest bigint, key bigint, made binary")
    taken = []
    for kind, most in wanted.items():
        if most:
            taken += labelled.where(F.col("kind") == kind).orderBy("digest", "key", "made").limit(most).collect()
    made = [pickle.loads(r["made"]) for r in sorted(taken, key=lambda r: (r["digest"], r["key"] is not None, r["key"] or 0, bytes(r["made"])))]
    return [m for m in made if m is not None]


def stretch(tags: list[int], out: int, most: int) -> slice:
    """At most ``most`` pieces, from the first or, where the first labelled one lies further on, from half as many before that."""
    first = next((i for i, tag in enumerate(tags) if tag != out), 0)
    start = 0 if first < most else first - most // 2
    return slice(start, start + most)
