"""Hard negatives of anchors by inner product, found by vertical scans with branch and bound.

Vectors are cut into integers (``floor(SCALE * x)``) and dealt by a digest to blocks of about ``BLOCK_BYTES``, each stored by columns:
one array for each dimension, with its least and greatest value. An anchor reads the columns of a block in the order of
its own descending magnitudes. After every ``STEP`` columns the rest of each row's score lies between the sums of the remaining
least and greatest contributions; rows whose bounds cannot reach the result leave the candidate bitmap, and only what remains is
read on until the scores are exact.

Two scans: the first finds an anchor's best rows of its own label, the positives (a row goes when as many others surely beat it). Each
positive's score opens a window for negatives; in the second scan a row of another label goes when it cannot fall into any
window, or when in each that it may reach enough rows surely stand higher. Blocks answer by themselves and their few best rows are merged.

The anchors are a stated query set: groups of ``GROUP`` of them meet every block, so work grows with anchors times rows, and
a task holds one block and one group at a time.

Rows with a null key, label or vector, or with a null or non-finite component, take no part; zero and empty vectors do. Vectors
of different lengths never meet. Of several rows of one key the least (label, then vector) counts. Integers beyond ``LIMIT`` either way are
set to it, so that scores of up to 2,048 dimensions fit 64 bits. Ties go to the smaller key. An anchor with fewer positives uses
all it has, a positive without negatives gives no row, and an empty table gives none. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.llm.common import written

SCALE = 256
LIMIT = 1 << 26
BLOCK_BYTES = 1 << 20
GROUP = 256
STEP = 8

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def vertical_scan(
    columns: np.ndarray, least: np.ndarray, greatest: np.ndarray, anchor: np.ndarray, bitmap: np.ndarray, keep: Keep
) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``bitmap`` that ``keep`` leaves and their exact scores.

    ``keep`` gets lower and upper bounds of the scores of the rows left and says which may still be in the result. ``bitmap`` shrinks.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    ends = np.sort(np.stack([weights * least[order], weights * greatest[order]]), axis=0)
    # Sums of what the columns from each place on can add at least and at most.
    rest = np.zeros((2, len(order) + 1), np.int64)
    rest[:, :-1] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
    rows = np.flatnonzero(bitmap)
    scores = np.zeros(len(rows), np.int64)
    for at in range(0, len(order), STEP):
        if not len(rows):
            break
        part = columns[order[at : at + STEP]]
        scores += weights[at : at + STEP] @ (part if len(rows) == part.shape[1] else part[:, rows]).astype(np.int64)
        read = min(at + STEP, len(order))
        alive = keep(scores + rest[0, read], scores + rest[1, read])
        if not alive.all():
            bitmap[rows[~alive]] = False
            rows, scores = rows[alive], scores[alive]
    return rows, scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by id."""
    return np.lexsort((ids, -scores))[:k]


def _kth(values: np.ndarray, k: int) -> np.int64:
    return np.partition(values, len(values) - k)[len(values) - k]


def beaten(k: int) -> Keep:
    """Drops rows that ``k`` others surely beat."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= _kth(low, k) if len(low) > k else np.ones(len(low), bool)

    return keep


def outside(windows: list[tuple[int, int]], k: int) -> Keep:
    """Drops rows that reach no window, or only windows where ``k`` rows surely stand higher."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(low), bool)
        for least, most in windows:
            possible = (high >= least) & (low <= most)
            sure = (low >= least) & (high <= most)
            if np.count_nonzero(sure) >= k:
                possible &= high >= _kth(low[sure], k)
            alive |= possible
        return alive

    return keep


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores from ``low`` to ``high`` percent of ``score``."""
    return -(-low * score // 100), high * score // 100


class Block:
    """A written block: ids, labels, and the vectors by columns."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, columns: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.labels = np.frombuffer(labels, np.int64)
        self.columns = np.frombuffer(columns, np.int32).reshape(dim, len(self.ids))
        self.least = self.columns.min(axis=1).astype(np.int64)
        self.greatest = self.columns.max(axis=1).astype(np.int64)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
        return vertical_scan(self.columns, self.least, self.greatest, anchor, bitmap, keep)

    def positives(self, anchor: dict, k: int) -> Iterator[tuple[int, int, int]]:
        """``anchor, id, score`` of the best rows of the anchor's label."""
        bitmap = (self.labels == anchor["label"]) & (self.ids != anchor["id"])
        rows, scores = self.scan(np.array(anchor["v"], np.int64), bitmap, beaten(k))
        for at in best(scores, self.ids[rows], k):
            yield anchor["id"], int(self.ids[rows[at]]), int(scores[at])

    def negatives(self, anchor: dict, k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int]]:
        """``anchor, positive, positive score, id, score`` of the best rows of other labels in each positive's window."""
        windows = [window(p["score"], low, high) for p in anchor["positives"]]
        bitmap = self.labels != anchor["label"]
        rows, scores = self.scan(np.array(anchor["v"], np.int64), bitmap, outside(windows, k))
        for positive, (least, most) in zip(anchor["positives"], windows, strict=True):
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for at in inside[best(scores[inside], self.ids[rows[inside]], k)]:
                yield anchor["id"], positive["id"], positive["score"], int(self.ids[rows[at]]), int(scores[at])


def _clean(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, v``: one row for each key that takes part, in integers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(
        x, lambda e: F.least(F.greatest(F.floor(e * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    )
    rows = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & finite).select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), whole.alias("v")
    )
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``dim, block, ids, labels, columns``: one row for each block."""

    def build(table: pa.Table) -> pa.Table:
        n, dim = len(table), table["dim"][0].as_py()
        vectors = table["v"].combine_chunks().flatten().to_numpy().reshape(n, dim)
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        order = np.lexsort((ids, labels))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int32()),
            "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()),
            "labels": pa.array([labels[order].astype(np.int64).tobytes()], pa.binary()),
            "columns": pa.array([np.ascontiguousarray(vectors[order].T, np.int32).tobytes()], pa.binary()),
        })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(
        build, "dim int, block int, ids binary, labels binary, columns binary"
    )


def _scanned(anchors: DataFrame, blocks: DataFrame, n_blocks: int, groups: int, scan: Callable, schema: str) -> DataFrame:
    """Runs ``scan`` for every group of anchors in every block of their dimension."""
    held = [c for c in anchors.columns if c != "dim"]
    met = (
        anchors.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"))
        .agg(F.collect_list(F.struct(*held)).alias("anchors"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    # A number of partitions of one's own: small tables still spread, as the work is in the scans, not in the bytes.
    pairs = met.repartition(n_blocks, "dim", "block").join(blocks.repartition(n_blocks, "dim", "block"), ["dim", "block"])
    arrow = {"bigint": pa.int64()}
    fields = [(f.split()[0], arrow[f.split()[1]]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                dim, ids, labels, columns, group = (batch.column(c)[at].as_py() for c in range(5))
                block = Block(dim, ids, labels, columns)
                out = [row for anchor in group for row in scan(block, anchor)]
                values = list(zip(*out, strict=True)) if out else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t) for v, (_, t) in zip(values, fields, strict=True)], schema=pa.schema(fields)
                )

    return pairs.select("dim", "ids", "labels", "columns", "anchors").mapInArrow(run, schema)


def hard_negatives(
    df: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on the column ``id``, the key; the negatives' scores lie between ``low`` and ``high`` percent of the
    positive's. ``label`` is a column of integers.
    """
    rows = written(_clean(df, key, vector, label).withColumn("dim", F.size("v")), "rows")
    n, widest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(0))).first()
    n_blocks = max(1, -(-n * 4 * max(widest, 1) // BLOCK_BYTES))
    blocks = written(_blocks(rows, n_blocks), "blocks")
    asked = rows.where(anchors)
    groups = max(1, -(-asked.count() // GROUP))

    found = _scanned(
        asked, blocks, n_blocks, groups, lambda block, anchor: block.positives(anchor, positives),
        "anchor_id bigint, id bigint, score bigint",
    )
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    top = (
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
        .groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    )
    opened = written(asked.join(top, "id"), "windows")
    hits = _scanned(
        opened, blocks, n_blocks, groups, lambda block, anchor: block.negatives(anchor, negatives, low, high),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
            "negative_score",
        )
    )
