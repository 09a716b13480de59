"""Line-first cleaning: every line passes or fails on its own, and a document that loses too much text is rejected.

A line is what stands between ``\\n``; lines without a word are neither judged nor counted. A line fails by the first rule
that holds:

* ``symbols``: many of its characters are signs of markup or noise,
* ``shouting``: nearly all of its letters are capitals,
* ``navigation``: it is a row of items between separators,
* ``boilerplate``: it has a phrase of notices and licences,
* ``repetition``: it is one word over and over,
* ``punctuation``: it is long and holds no end of a sentence.

The document is kept when the base counts are in order and, boilerplate lines left aside, something is left and the failing
lines hold at most ``MOST_LOST`` of the word bytes: a notice says nothing against the text beside it. Null and empty texts have no words and are not kept; repeated rows are judged each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import WHITE, map_batches

SIGNS = b"#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
WINDOW = 5

MOST_LOST = 0.5
MOST_SIGNS = 0.1
MOST_CAPITALS = 0.6
SEPARATORS = frozenset(map(str.encode, "| › » · • > / — –".split()))
# Own list of phrases that notices use.
BOILERPLATE = tuple(
    phrase.encode()
    for phrase in (
        "all rights reserved",
        "licensed under",
        "released under the",
        "terms of use",
        "terms of service",
        "privacy policy",
        "accept cookies",
        "accept all cookies",
        "uses cookies",
        "use cookies",
        "enable javascript",
        "subscribe to our",
        "click here",
    )
)
SENTENCE_END = re.compile(r"""[.!?…。！？][)\]"'”’»]*(?:[\x20\x09-\x0D]|$)""")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALLS = CAPITALS.lower()
RULES = ("symbols", "shouting", "navigation", "boilerplate", "repetition", "punctuation")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Windows whose hashes all differ all differ; only other texts need the exact comparison below.
    mixed = ids[:n].astype(np.uint64)
    for k in range(1, window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():
        return 0
    # Each window gets an exact number, one word more at a time.
    name = ids[:n]
    for k in range(1, window):
        _, name = np.unique(name * len(number) + ids[k : k + n], return_inverse=True)
    twice = np.bincount(name)[name] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def failing_rule(line: str, raw: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with at least one word fails, or none."""
    size = sum(map(len, words))
    if len(raw) - len(raw.translate(None, SIGNS)) > MOST_SIGNS * size:
        return "navigation" if sum(w in SEPARATORS for w in words) * 5 > len(words) else "symbols"
    if len(words) >= 4:
        capitals, smalls = len(raw) - len(raw.translate(None, CAPITALS)), len(raw) - len(raw.translate(None, SMALLS))
        if capitals > MOST_CAPITALS * (capitals + smalls):
            return "shouting"
        if sum(w in SEPARATORS for w in words) * 5 > len(words):
            return "navigation"
    lower = raw.lower()
    if any(phrase in lower for phrase in BOILERPLATE):
        return "boilerplate"
    if len(words) >= 10 and sum(a == b for a, b in pairwise(words)) * 2 > len(words):
        return "repetition"
    if len(words) >= 10 and not SENTENCE_END.search(line):
        return "punctuation"
    return None


def judge(text: str | None) -> tuple:
    """All figures of one text; the last is the text that remains."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    total = lost = notices = failed = counted = 0
    seen: set[str] = set()
    duplicates = 0
    left = []
    for line in lines:
        line_raw = line.encode("utf-8", "surrogatepass")
        line_words = line_raw.split()
        if not line_words:
            left.append(line)
            continue
        counted += 1
        duplicates += line in seen
        seen.add(line)
        size = sum(map(len, line_words))
        total += size
        rule = failing_rule(line, line_raw, line_words)
        if rule:
            failed += 1
            lost += size
            notices += size if rule == "boilerplate" else 0
        else:
            left.append(line)
    blanks = len(raw) - len(raw.translate(None, WHITE))
    repeated = repeated_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    kept = not base_failed and lost < total and lost - notices <= MOST_LOST * (total - notices)
    return (
        len(words),
        len(text) - blanks,
        len(raw) - len(raw.translate(None, SIGNS)),
        duplicates,
        repeated,
        base_failed,
        kept,
        counted,
        failed,
        lost,
        total,
        "\n".join(left),
    )


_FIGURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, n_failed_lines bigint, lost_bytes bigint, word_bytes bigint"
)


def line_first(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``df``: its key, the figures of ``judge`` and, if asked for, ``clean_text``."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            columns = list(zip(*map(judge, texts), strict=True)) or [[] for _ in range(12)]
            yield [keys, *map(list, columns[: 12 if with_text else 11])]

    schema = f"`{key}` bigint, {_FIGURES}" + (", clean_text string" if with_text else "")
    return map_batches(df, [key, text], run, schema)


def keep_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns and whole texts."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(t)[6] for t in texts], dtype=bool)

    return df.where(kept(F.col(f"`{text}`")))
