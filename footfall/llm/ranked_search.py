"""Ranked lexical search: item vocabulary tiles times document impact tiles, multiplied as dense float64 matrices.

1. Items become rows of term counts. They are dealt to vocabularies of bounded size (``VOCABULARY_BYTES`` of text each, the bound is
   checked), so a large query set is several rounds over the documents; the texts are split into terms once per round.
2. Every document becomes the sparse counts of its terms that a vocabulary knows, written once. Document frequencies, the number of
   documents and of terms are aggregations of that table.
3. ``ITEMS`` items and the terms of theirs that any document holds make one compact matrix of weights. Its columns are cut into tiles
   so that no sum of a tile can reach 2**53: products of whole numbers are then exact in float64, whatever order BLAS adds
   them in. Tiles are added up as 64-bit integers.
4. A tile of ``DOCUMENTS`` documents is a dense matrix of impacts. From each product the rows' k-th best scores are taken with all their
   ties; only the exact order by score, then key, cuts. A task keeps k rows of each item; the tasks' rows are merged in two steps.

A term is a longest run of ASCII letters and digits and of any other characters beyond ASCII; only A-Z are lower-cased. Texts may be null,
empty or very long. Null and repeated document keys count as documents of their own; at equal scores a null key comes last. Of several
rows of one item the one of the least text counts, items without a key do not take part, nor do those without terms. Fewer than k
documents with a score above zero are returned as they are; empty tables give no rows. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.llm.common import map_batches, written

ITEMS = 64
DOCUMENTS = 256
EXACT = 1 << 53
# No impact reaches it: 10**9 tf / (1000 tf + 12 m) with m above zero.
IMPACT = 1_000_000
# Bytes of item text whose terms form one vocabulary, held by every worker; and of the vocabularies that were really made.
VOCABULARY_BYTES = 8 << 20
# First-step groups of one item's rows when tasks are merged.
MERGED = 64

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    # In UTF-8 every byte of a character beyond ASCII is 128 or more, so bytes can be judged one by one.
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split(b" ") if text else []


def term_counts(text: str | None) -> Counter:
    counts = Counter(terms(text))
    counts.pop(b"", None)
    return counts


class Vocabulary:
    """Terms of one round of items, numbered."""

    def __init__(self, items: list[tuple[int, bytes, int]]):
        self.terms = sorted({term for _, term, _ in items})
        if sum(map(len, self.terms)) > 4 * VOCABULARY_BYTES:
            raise ValueError("a round of items exceeds its bound; one item is too long")
        self.number = {term: n for n, term in enumerate(self.terms)}

    def sparse(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """Number of all terms, then numbers and counts of the known ones."""
        counts = term_counts(text)
        known = [(self.number[t], c) for t, c in counts.items() if t in self.number]
        return counts.total(), [n for n, _ in known], [c for _, c in known]


class ItemTile:
    """Up to ``ITEMS`` items as a matrix of weights over the terms that they use, cut into exact column tiles."""

    def __init__(self, items: list[tuple[int, dict[int, int]]], weights: np.ndarray):
        self.keys = [key for key, _ in items]
        used = sorted({n for _, counts in items for n in counts if weights[n] > 0})
        self.column = {n: at for at, n in enumerate(used)}
        # Column of every term of the vocabulary, -1 for those of other items.
        self.places = np.full(len(weights), -1)
        self.places[used] = np.arange(len(used))
        matrix = np.zeros((len(items), len(used)), np.int64)
        for row, (_, counts) in enumerate(items):
            for n, times in counts.items():
                if n in self.column:
                    matrix[row, self.column[n]] = times * int(weights[n])
        self.matrix = matrix.astype(np.float64)
        self.cuts = [0]
        room = np.zeros(len(items), np.int64)
        for at in range(len(used)):
            more = room + matrix[:, at] * IMPACT
            if more.max(initial=0) >= EXACT and at > self.cuts[-1]:
                self.cuts.append(at)
                more = matrix[:, at] * IMPACT
            if more.max(initial=0) >= EXACT:
                raise ValueError("one term of an item outweighs what float64 holds exactly")
            room = more
        self.cuts.append(len(used))

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """Exact scores, items by documents."""
        total = np.zeros((len(self.keys), impacts.shape[1]), np.int64)
        for start, end in zip(self.cuts, self.cuts[1:]):
            total += (self.matrix[:, start:end] @ impacts[start:end]).astype(np.int64)
        return total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class TopRows:
    """The ``k`` best documents of each item of a tile so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def add(self, scores: np.ndarray, keys: list[int | None]) -> None:
        k = self.k
        for item, row in enumerate(scores):
            held = self.rows[item]
            # A score equal to the last one held may still win by its key.
            least = max(1, -held[-1][0] if len(held) == k else 1)
            if len(row) > k:
                least = max(least, int(np.partition(row, len(row) - k)[len(row) - k]))
            new = np.flatnonzero(row >= least)
            if len(new):
                both = held + [(-int(row[at]), keys[at] is None, keys[at] or 0) for at in new]
                both.sort()
                self.rows[item] = both[:k]

    def out(self, keys: list[int]) -> Iterator[tuple[int, int | None, int]]:
        for key, rows in zip(keys, self.rows, strict=True):
            for score, missing, doc in rows:
                yield key, None if missing else doc, -score


def _item_terms(items: DataFrame, key: str, text: str, rounds: int) -> DataFrame:
    """``round, item, term, times``."""
    one = (
        items.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").cast("bigint").alias("item")).agg(F.min(F.col(f"`{text}`")).alias("text"))
    )

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            rows = [(k, t, n) for k, text_ in zip(keys, texts, strict=True) for t, n in term_counts(text_).items()]
            yield [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]

    return map_batches(one, ["item", "text"], run, "item bigint, term binary, times bigint").withColumn(
        "round", F.pmod(F.xxhash64("item"), F.lit(rounds)).cast("int")
    )


def _sparse(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """``doc, n, numbers, counts`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        known = shared.value
        for keys, texts in batches:
            found = [known.sparse(t) for t in texts]
            yield [keys, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    return written(
        map_batches(named, ["doc", "text"], run, "doc bigint, n bigint, numbers array<int>, counts array<int>"), "counts"
    )


def _best_of_tasks(counted: DataFrame, tiles: list[ItemTile], docs: int, all_terms: int, k: int) -> DataFrame:
    """``task, item, doc, score``: each task's ``k`` best documents of every item."""
    shared = counted.sparkSession.sparkContext.broadcast(tiles)
    schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        top = [TopRows(len(tile.keys), k) for tile in items]
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                keys = part["doc"].to_pylist()
                # Python's integers: the product may pass 64 bits where terms and documents are many.
                m = np.array([75 + 25 * n * docs // all_terms for n in part["n"].to_pylist()], np.int64)
                lengths = part["numbers"].value_lengths().to_numpy()
                doc = np.repeat(np.arange(len(keys)), lengths)
                numbers = part["numbers"].flatten().to_numpy()
                values = impact(part["counts"].flatten().to_numpy().astype(np.int64), m[doc]).astype(np.float64)
                for tile, best in zip(items, top, strict=True):
                    column = tile.places[numbers]
                    there = column >= 0
                    dense = np.zeros((len(tile.column), len(keys)))
                    dense[column[there], doc[there]] = values[there]
                    best.add(tile.scores(dense), keys)
        rows = [row for tile, best in zip(items, top, strict=True) for row in best.out(tile.keys)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, type=f.type) for v, f in zip(zip(*rows, strict=True) if rows else [[], [], []], schema, strict=True)],
            schema=schema,
        )

    return (
        counted.where("size(numbers) > 0").select("doc", "n", "numbers", "counts")
        .mapInArrow(run, "item bigint, doc bigint, score bigint").withColumn("task", F.spark_partition_id())
    )


def _ranked(rows: DataFrame, k: int, *also: str) -> DataFrame:
    order = W.partitionBy("item", *also).orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """``item_key, rank, doc_key, score``: the ``k`` best documents of each item."""
    n_bytes = items.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    rounds = 1 + n_bytes // VOCABULARY_BYTES
    asked = written(_item_terms(items, item_key, text, rounds), "items")
    found = None
    for number in range(rounds):
        wanted = [(r.item, bytes(r.term), r.times) for r in asked.where(F.col("round") == number).toLocalIterator()]
        vocabulary = Vocabulary(wanted)
        counted = _sparse(docs, doc_key, text, vocabulary)
        with_terms, all_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(vocabulary.terms), np.int64)
        for row in counted.select(F.explode("numbers").alias("term")).groupBy("term").count().toLocalIterator():
            frequency[row.term] = row["count"]
        weights = np.array(
            [math.floor(1000 * math.log((2 * with_terms + 2) / (2 * int(f) + 1))) if f else 0 for f in frequency], np.int64
        )
        rows: dict[int, dict[int, int]] = {}
        for item, term, times in wanted:
            rows.setdefault(item, {})[vocabulary.number[term]] = times
        listed = sorted(rows.items())
        tiles = [ItemTile(listed[at : at + ITEMS], weights) for at in range(0, len(listed), ITEMS)]
        part = _best_of_tasks(counted, tiles, with_terms, all_terms, k)
        found = part if found is None else found.unionByName(part)
    merged = _ranked(found.withColumn("part", F.pmod("task", F.lit(MERGED))), k, "part").drop("rank", "part", "task")
    return _ranked(merged, k).select(
        F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_key), "score"
    )
