"""Documents linked by the Jaccard similarity of their n-gram sets, found by rare-first prefix filtering.

1. Every text becomes a set of n-gram numbers (``shingles``). All n-grams are counted in ``BUCKETS`` buckets of their numbers; the
   order of all n-grams is by the count of the bucket, then the number. It is the same everywhere and rare first: what thousands
   of documents share stands out of its bucket, whatever else falls into it. Equal sets collapse to one node, its smallest
   document, so copies never meet each other.
2. A set of ``n`` n-grams misses at most ``m = n // 10`` of a partner's at similarity 0.9 (in general ``slack(n)``). The
   ``m + k`` first n-grams of each set are its extended prefix: partners share at least ``k`` of them. N-grams in
   one prefix only cannot be shared; nodes with fewer than ``k`` others have no partner and go.
3. Inside the extended prefix n-grams are ordered by how many prefixes hold them. Leaving out the ``k - 1`` most frequent ones
   still leaves every pair of partners one in common; these are the inverted lists.
4. The first node of each list is compared with the others, which joins most of each group of near copies. Then every list
   yields all pairs from different components that pass the length filter, the positional filter and the
   suffix filter (a lower bound of the sets' difference from their counts, modulo four, in 512 ranges of numbers). Long lists are
   cut into blocks and go out as pairs of blocks, so no task holds a whole one.
5. Each remaining pair that has not been tested is verified once, on the whole sets. Components of the verified links are the result: pairs skipped in
   4 lie inside one component, so none is lost.

Texts without words (null, empty, blank) have no n-grams and are linked with nothing. Rows with the same key count as the same
document. A null key takes part only through a row of the same set. N-grams are compared as 64-bit numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_batches, remove_written, spare, written, written_to
from footfall.llm.components import components
from footfall.llm.shingles import shingle_set

BLOCK = 2_048
# Ranges of numbers in which a set's n-grams are counted, a power of two, and 64-bit words that hold the counts.
RANGES = 512
WORDS = 2 * RANGES // 64
# Buckets in which n-grams are counted: one array of this length in every task, whatever the size of the corpus.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
# Nodes to verify up to which their table is broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_NODES = 500_000


def _ceil(a, b):
    return -(-a // b)


def overlap(x, y, percent: int):
    """The least common n-grams of sets of sizes x and y with at least ``percent`` similarity."""
    return _ceil(percent * (x + y), 100 + percent)


def slack(n, percent: int):
    """How many n-grams of a set of size n a partner may lack."""
    return n - _ceil(percent * n, 100)


def shared_least(n, percent: int):
    """``k``: how many n-grams of the extended prefixes partners share at least (the smaller partner's count)."""
    return np.maximum(1, _ceil(_ceil(percent * n, 100), 40))


def _bucket(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(df: DataFrame, text: str, width: int) -> np.ndarray:
    """How many n-grams of all documents fall into each bucket, every document's n-grams once."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        total = np.zeros(BUCKETS, np.int64)
        for (texts,) in batches:
            found = [_bucket(shingle_set(t, width)) for t in texts]
            if found:
                total += np.bincount(np.concatenate(found), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield [used.astype(np.int32), total[used]]

    parts = map_batches(df.select(F.col(f"`{text}`").alias("text")), ["text"], run, "bucket int, n bigint")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return counts


def extended_prefix(numbers: np.ndarray, percent: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The first n-grams of a sorted set, rare ones first by the counts of their buckets."""
    n = len(numbers)
    size = min(n, slack(n, percent) + _ceil(n, 40))
    if counts is not None:
        numbers = numbers[np.lexsort((numbers, counts[_bucket(numbers)]))]
    return numbers[:size]


def _signed(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.uint64).view(np.int64)


def _histogram(numbers: np.ndarray) -> bytes:
    """Counts in the ranges of numbers, modulo four, as two bits each that differ in one place between neighbours (0, 1, 3, 2)."""
    ranges = (numbers >> np.uint64(64 - (RANGES - 1).bit_length())).astype(np.int64)
    counts = np.bincount(ranges, minlength=RANGES) & 3
    code = counts ^ (counts >> 1)
    return np.packbits(np.concatenate([code & 1, code >> 1]).astype(np.uint8)).tobytes()


def _shapes(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint64).reshape(-1, WORDS)


def shape_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of histograms the circular differences of their counts, added up: never more than the sets differ by."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def document_sets(df: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``doc_id, n, sig, shape, prefix`` per row: set size, digest of the set, histogram and extended prefix."""
    shared = df.sparkSession.sparkContext.broadcast(bucket_counts(df, text, width))

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        counts = shared.value
        for keys, texts in batches:
            sets = [shingle_set(t, width) for t in texts]
            yield [
                keys,
                [len(s) for s in sets],
                [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                [_histogram(s) for s in sets],
                [_signed(extended_prefix(s, percent, counts)) for s in sets],
            ]

    plain = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id bigint, n bigint, sig binary, shape binary, prefix array<bigint>"
    return map_batches(plain, ["doc_id", "text"], run, schema)


def inverted_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """``token, freq, node, n, place, size, least, shape``: the rare-first lists; ``place`` counts in a node's order."""
    tokens = nodes.select("node", "n", F.explode("prefix").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    shared = tokens.join(frequent, "token")
    ordered = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"))
    # Smallest count that a partner's prefix may rest on, as in shared_least.
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.lit(percent) * F.col("n") / 100) / 40)).cast("bigint")
    ordered = nodes.select("node", "n", "shape", F.size("prefix").alias("size")).join(ordered, ["node", "n"])
    ordered = ordered.withColumn("least", F.least(least, F.col("size").cast("bigint")))
    # N-grams of one prefix only come first in the order: they take places but have no list.
    alone = F.col("size") - F.size("tokens")
    used = F.col("size") - F.col("least") + 1 - alone
    kept = ordered.where(F.size("tokens") >= F.col("least")).where(used > 0)
    return kept.select(
        "node", "n", "size", "least", "shape", alone.alias("alone"),
        F.posexplode(F.slice("tokens", 1, used.cast("int"))).alias("at", "entry"),
    ).select(
        "entry.token", "entry.freq", "node", "n", "size", "least", "shape", (F.col("alone") + F.col("at")).alias("place")
    )


def _close(a: dict, b: dict, percent: int) -> np.ndarray:
    """Which pairs of rows pass the length, positional and suffix filters."""
    small, large = np.minimum(a["n"], b["n"]), np.maximum(a["n"], b["n"])
    good = 100 * small >= percent * large
    # Positional: what both prefixes still hold after this n-gram has to reach the shared least.
    left = np.minimum(a["size"] - a["place"], b["size"] - b["place"])
    before = np.minimum(a["place"], b["place"])
    good &= left + before >= np.minimum(a["least"], b["least"])
    at = np.flatnonzero(good)
    gap = shape_gap(a["shape"][at], b["shape"][at])
    sizes = a["n"][at] + b["n"][at]
    good[at] = gap <= sizes - 2 * overlap(a["n"][at], b["n"][at], percent)
    return good


def block_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of one list and different components that pass the filters, from pairs of blocks of the lists."""
    parts = F.ceil(F.col("freq") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), parts).cast("int")
    rows = lists.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    keyed = rows.select(
        "token",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        *("block", "node", "component", "n", "size", "least", "place", "shape"),
    )
    columns = keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows are sorted by key: all but the last key of what is held are complete.
            table = pa.Table.from_batches([*held, batch])
            keys = [table.column(k).to_numpy() for k in range(3)]
            last = [k[-1] for k in keys]
            same = (keys[0] == last[0]) & (keys[1] == last[1]) & (keys[2] == last[2])
            cut = int(np.argmax(same))
            if cut:
                yield _pairs(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield _pairs(pa.Table.from_batches(held))

    def _pairs(table: pa.Table) -> pa.RecordBatch:
        names = dict(zip(columns, table.columns, strict=True))
        rows = {c: names[c].to_numpy() for c in columns if c != "shape"}
        rows["shape"] = _shapes(names["shape"].to_pylist())
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here = np.arange(table.num_rows)
        step = 1
        while len(here := here[here + step < table.num_rows]):
            there = here + step
            same = np.ones(len(here), bool)
            for c in ("token", "i", "j"):
                same &= rows[c][here] == rows[c][there]
            # Sorted by size inside a key: once a partner is too large, so are all later ones.
            same &= percent * rows["n"][there] <= 100 * rows["n"][here]
            here, there = here[same], there[same]
            test = rows["component"][here] != rows["component"][there]
            cross = rows["i"][here] != rows["j"][here]
            test &= ~cross | (rows["block"][here] != rows["block"][there])
            a, b = here[test], there[test]
            if len(a):
                pick = [{c: rows[c][k] for c in ("n", "size", "least", "place", "shape")} for k in (a, b)]
                good = _close(*pick, percent)
                found_a.append(rows["node"][a[good]])
                found_b.append(rows["node"][b[good]])
            step += 1
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    # Rows are small here, so batches may hold more of them.
    lists.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
    dealt = keyed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def first_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each list's first node with its other nodes, where lengths and suffixes allow a link."""
    heads = lists.groupBy("token").agg(F.min(F.struct("node", "n", "shape")).alias("head"))
    pairs = lists.join(heads, "token").where("node <> head.node").where(
        (F.col("n") * 100 >= F.col("head.n") * percent) & (F.col("head.n") * 100 >= F.col("n") * percent)
    )
    distinct = pairs.groupBy(F.col("head.node").alias("a"), F.col("node").alias("b")).agg(
        F.first(F.struct("head.n", "head.shape")).alias("x"), F.first(F.struct("n", "shape")).alias("y")
    )

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for a, b, x, y in batches:
            if not a:
                continue
            n = [np.array([r["n"] for r in side], np.int64) for side in (x, y)]
            gap = shape_gap(*(_shapes([r["shape"] for r in side]) for side in (x, y)))
            good = np.flatnonzero(gap <= n[0] + n[1] - 2 * overlap(n[0], n[1], percent)).tolist()
            yield [[a[k] for k in good], [b[k] for k in good]]

    return map_batches(distinct, ["a", "b", "x", "y"], run, "a bigint, b bigint")


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough, as a written table. ``pairs`` is one, too."""
    wanted, wanted_at = written_to(
        pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted"
    )
    few = wanted.count() <= BROADCAST_NODES
    plain = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    plain = plain.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")

    def run_sets(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            yield [keys, [shingle_set(t, width).tobytes() for t in texts]]

    found = map_batches(plain, ["doc_id", "text"], run_sets, "doc_id bigint, numbers binary")
    sets, sets_at = written_to(found.dropDuplicates(["doc_id", "numbers"]), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("numbers").alias("left")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("numbers").alias("right")), "b")

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for a, b, left, right in batches:
            good = []
            for k in range(len(a)):
                x, y = np.frombuffer(left[k], np.uint64), np.frombuffer(right[k], np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(k)
            yield [[a[k] for k in good], [b[k] for k in good]]

    links = written(map_batches(both, ["a", "b", "left", "right"], run, "a bigint, b bigint"), "links")
    for path in (wanted_at, sets_at):
        remove_written(df.sparkSession, path)
    return links


def linked_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``df``: the smallest document reachable by links."""
    spark = df.sparkSession
    sets, sets_at = written_to(document_sets(df, key, text, width, percent), "sets")
    # Equal sets are one node, named by its smallest document.
    nodes, nodes_at = written_to(
        sets.where("n > 0").groupBy("sig").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("shape").alias("shape"),
            F.first("prefix").alias("prefix"),
        ),
        "nodes",
    )
    # Tables go after their last reader; what the result needs of them is narrow.
    rows = written(sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig")), "rows")
    remove_written(spark, sets_at)
    lists, lists_at = written_to(inverted_lists(nodes.where("node is not null"), percent), "lists")
    names = written(nodes.select("sig", "node"), "names")
    remove_written(spark, nodes_at)
    candidates = written(first_pairs(lists, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    links = verified(candidates, df, key, text, width, percent)
    known = written(components(links), "components")
    rest = lists.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    others = written(block_pairs(rest, percent).join(candidates, ["a", "b"], "left_anti"), "pairs")
    remove_written(spark, lists_at)
    more = verified(others, df, key, text, width, percent)
    final = components(links.unionByName(more))
    named = names.join(final, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "sig", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that no earlier document of their component stands for, with all their columns.

    The document with the smallest key stays, repeated rows of it included; rows with a null key stay when nothing but
    such rows has their set.
    """
    gone = linked_components(df, key, text, width, percent).where("component_id < doc_id or doc_id is null and component_id is not null")
    (name,) = spare(df, "_gone")
    gone = gone.select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(name)), "left_anti")
