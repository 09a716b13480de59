"""Long byte matches across a corpus by a logarithmic family of sampled suffix arrays.

Removed is every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else in the corpus, in the same document
or another; matches never cross documents, and strings are judged on the input.

1. Each text gives its sampled suffixes (``anchors``): equal windows of ``LENGTH`` bytes have equal ones. A suffix array holds them
   in the order of the digests of their first ``GRAM`` bytes, cut into ranges of that order.
2. Batches of documents arrive one after the other. The array of a batch is scanned against itself and against the arrays
   of all levels, range by range, for suffixes that were there before. Then it becomes level 0; while a level of its size is
   there, the two merge into the next one, so a family over ``n`` batches has at most log n levels and each suffix is merged
   log n times.
3. Suffixes that were met twice are candidates. Those that agree in the whole stretch their windows span (``context``) are
   removed as they are. Stretches that share the suffix and differ around it are compared window by window; suffixes with
   many such stretches are dealt out by window digests, so equal windows still meet.
4. The removed windows of each document are merged into runs.

Null and empty texts have no bytes. Documents are told apart by key and text digest: repeated rows match each other, so what
they hold is removed from all of them. Digests have 64 bits, and windows are compared inside groups of one suffix digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.anchors import LENGTH, Pieces, cut
from footfall.llm.common import map_batches, remove_written, written, written_to
from footfall.session import release

BATCHES = 4
# Text bytes whose suffixes one range of the arrays holds, about.
RANGE_BYTES = 1 << 25
# Bytes of text laid end to end at once.
GATHER = 1 << 19
# Documents of one batch where each comes with a list of its stretches or ranges.
LISTED_ROWS = 24
# Stretches of one suffix that one group compares, about.
GROUP = 4_096
DOC = ["doc", "digest"]


def keyed(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """``doc, digest, text`` and ``more``; the keys without nulls."""
    unknown = F.col(f"`{key}`").isNull()
    return df.select(
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)).alias("doc"),
        F.xxhash64(F.col(f"`{text}`"), unknown).alias("digest"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        *more,
    )


def _gathered(batches: Iterator[list[list]]) -> Iterator[tuple[list[tuple[int, int, int]], dict[str, np.ndarray]]]:
    """Owners (doc, digest, first byte) of pieces of text and the sampled suffixes of the pieces, some megabytes at a time."""
    owners: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    size = 0
    for docs, digests, texts in batches:
        for doc, digest, text in zip(docs, digests, texts, strict=True):
            for first, part in cut(text.encode("utf-8", "surrogatepass")):
                if len(part) < LENGTH:
                    continue
                owners.append((doc, digest, first))
                parts.append(part)
                size += len(part)
                if size >= GATHER:
                    yield owners, Pieces(parts).anchored()
                    owners, parts, size = [], [], 0
    if parts:
        yield owners, Pieces(parts).anchored()


def batch_arrays(docs: DataFrame, batches: int, bits: int) -> DataFrame:
    """``batch, part, grams``: the suffixes of each batch of documents, as packed digests by range."""

    def run(rows: Iterator[list[list]]) -> Iterator[list[list]]:
        for owners, found in _gathered(rows):
            batch = np.array([digest % batches for _, digest, _ in owners], np.int64)[found["part"]]
            group = batch << bits | (found["gram"] >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            names, starts = np.unique(group[order], return_index=True)
            pieces = np.split(found["gram"][order], starts[1:])
            yield [names >> bits, names & ((1 << bits) - 1), [p.tobytes() for p in pieces]]

    return map_batches(docs, ["doc", "digest", "text"], run, "batch bigint, part bigint, grams binary")


class SuffixLevels:
    """The family of suffix arrays. ``levels`` maps a level to its table ``part, grams`` and folder."""

    def __init__(self, spark):
        self.spark = spark
        self.levels: dict[int, tuple[DataFrame, str]] = {}

    def add(self, arrays: DataFrame) -> DataFrame:
        """Takes in a batch (``part, grams``); gives ``part, grams``, the suffixes of it or of a level that were met again."""
        top = 0
        while top in self.levels:
            top += 1
        rows = arrays.select("part", F.lit(-1).alias("level"), "grams")
        for level, (table, _) in self.levels.items():
            rows = rows.unionByName(table.select("part", F.lit(level).alias("level"), "grams"))

        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            arriving = np.frombuffer(b"".join(pdf["grams"][pdf["level"] < 0]), np.uint64)
            arriving, counts = np.unique(arriving, return_counts=True)
            met, merged = [arriving[counts > 1]], [arriving]
            for level, grams in zip(pdf["level"], pdf["grams"], strict=True):
                if level >= 0:
                    array = np.frombuffer(grams, np.uint64)
                    at = np.minimum(np.searchsorted(array, arriving), len(array) - 1)
                    met.append(arriving[array[at] == arriving] if len(array) else array)
                    if level < top:
                        merged.append(array)
            both = np.unique(np.concatenate(merged))
            again = np.unique(np.concatenate(met))
            part = int(pdf["part"].iloc[0])
            return pd.DataFrame({"part": [part, part], "met": [False, True], "grams": [both.tobytes(), again.tobytes()]})

        done, folder = written_to(rows.groupBy("part").applyInPandas(scan, "part bigint, met boolean, grams binary"), "levels")
        for level in range(top):
            remove_written(self.spark, self.levels.pop(level)[1])
        self.levels[top] = (done.where("not met").select("part", "grams"), folder)
        return done.where("met").select("part", "grams")


def met_suffixes(docs: DataFrame, batches: int) -> DataFrame:
    """``gram``: digests of the suffixes that occur more than once, from a family fed batch by batch."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // RANGE_BYTES).bit_length())
    arrays, folder = written_to(batch_arrays(docs, batches, bits), "arrays")
    family = SuffixLevels(spark)
    met = None
    for batch in range(batches):
        found = family.add(arrays.where(F.col("batch") == batch).select("part", "grams"))
        # A merge deletes the folders of the levels it takes in, so what was met goes to a folder of its own.
        found = written(found, "met")
        met = found if met is None else met.unionByName(found)

    def run(rows: Iterator[list[list]]) -> Iterator[list[list]]:
        for (blobs,) in rows:
            yield [np.frombuffer(b"".join(blobs), np.int64)]

    grams = written(map_batches(met, ["grams"], run, "gram bigint", rows=8).distinct(), "grams")
    for _, path in family.levels.values():
        remove_written(spark, path)
    remove_written(spark, folder)
    return grams


def suffixes(docs: DataFrame) -> DataFrame:
    """``gram, context, doc, digest, at, n``: all sampled suffixes; windows ``at`` to ``at + n - 1`` hang on each."""

    def run(rows: Iterator[list[list]]) -> Iterator[list[list]]:
        for owners, found in _gathered(rows):
            own = np.array(owners, np.int64)[found["part"]]
            yield [found["gram"].view(np.int64), found["context"].view(np.int64), own[:, 0], own[:, 1], found["at"] + own[:, 2], found["n"]]

    schema = "gram bigint, context bigint, doc bigint, digest bigint, at bigint, n bigint"
    return map_batches(docs, ["doc", "digest", "text"], run, schema)


def window_rows(stretches: DataFrame, docs: DataFrame) -> DataFrame:
    """``gram, salt, alone, doc, digest, windows, digests``: the windows of stretches that differ around one suffix."""
    by_doc = stretches.groupBy(*DOC).agg(F.collect_list(F.struct("gram", "at", "n", "salts", "alone")).alias("parts"))

    def run(rows: Iterator[list[list]]) -> Iterator[list[list]]:
        for documents, digests, texts, lists in rows:
            out: list[list] = [[] for _ in range(7)]
            owners, slices = [], []
            for doc, digest, text, parts in zip(documents, digests, texts, lists, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for p in parts:
                    owners.append((p["gram"], p["salts"], p["alone"], doc, digest, p["at"]))
                    slices.append(raw[p["at"] : p["at"] + p["n"] + LENGTH - 1])
            for k in range(0, len(slices), 4096):
                pieces = Pieces(slices[k : k + 4096])
                found = pieces.window_digests(pieces.window)
                ends = np.cumsum(np.bincount(pieces.part, minlength=len(slices[k : k + 4096])))
                for owner, values in zip(owners[k : k + 4096], np.split(found, ends[:-1]), strict=True):
                    gram, salts, alone, doc, digest, at = owner
                    places = np.arange(at, at + len(values))
                    side = values % np.uint64(salts)
                    for salt in range(salts) if salts > 1 else [0]:
                        here = side == salt
                        if here.any():
                            row = (gram, salt, alone, doc, digest, places[here].tobytes(), values[here].tobytes())
                            for column, value in zip(out, row, strict=True):
                                column.append(value)
            yield out

    joined = docs.join(by_doc, DOC)
    schema = "gram bigint, salt bigint, alone boolean, doc bigint, digest bigint, windows binary, digests binary"
    return map_batches(joined, [*DOC, "text", "parts"], run, schema, rows=LISTED_ROWS)


def equal_windows(rows: DataFrame) -> DataFrame:
    """``doc, digest, first, last``: runs of windows of lone stretches that another stretch has too."""
    names = ["gram", "salt", "alone", "doc", "digest", "windows", "digests"]

    def compare(held: list[pa.RecordBatch]) -> tuple[list, ...]:
        table = pa.Table.from_batches(held)
        columns = {n: table.column(n).to_pylist() for n in names}
        values = [np.frombuffer(v, np.uint64) for v in columns["digests"]]
        sizes = np.array([len(v) for v in values])
        gram, salt = np.array(columns["gram"]), np.array(columns["salt"])
        group = np.cumsum(np.append(0, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])))
        # Windows are equal when their digests and their groups are.
        everything = np.concatenate(values)
        owner = np.repeat(np.arange(len(values)), sizes)
        order = np.lexsort((everything, group[owner]))
        v, g = everything[order], group[owner][order]
        same = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
        twice = np.zeros(len(v), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(v), bool)
        hit[order] = twice
        hit &= np.array(columns["alone"])[owner]
        places = np.concatenate([np.frombuffer(w, np.int64) for w in columns["windows"]])[hit]
        owner = owner[hit]
        new = np.append(True, (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1]))[: len(places)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(places)) - 1
        docs, digests = np.array(columns["doc"]), np.array(columns["digest"])
        return docs[owner[first]], digests[owner[first]], places[first], places[last[: len(first)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            gram, salt = table.column("gram").to_numpy(), table.column("salt").to_numpy()
            start = int(np.argmax((gram == gram[-1]) & (salt == salt[-1])))
            if start:
                yield _ranges(compare(table.slice(0, start).to_batches()))
            held = table.slice(start).combine_chunks().to_batches()
        if held:
            yield _ranges(compare(held))

    def _ranges(columns: tuple) -> pa.RecordBatch:
        arrays = [pa.array(np.asarray(c, np.int64)) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "digest", "first", "last"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    dealt = rows.select(*names).repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    return dealt.mapInArrow(run, "doc bigint, digest bigint, first bigint, last bigint")


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``doc, digest, ranges``: for each document with repeats its repeated windows, as sorted ranges of first bytes."""
    docs = keyed(df, key, text)
    spark = df.sparkSession
    grams = met_suffixes(docs, batches)
    release(spark)
    candidates = written(suffixes(docs).join(grams, "gram", "left_semi"), "candidates")
    release(spark)
    stretches = written(
        candidates.groupBy("gram", "context").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct(*DOC, "at", "n")).alias("one")
        ),
        "stretches",
    )
    many = stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    differing = stretches.join(many, "gram").select(
        "gram", "one.*", (F.col("copies") == 1).alias("alone"), F.ceil(F.col("kinds") / GROUP).cast("bigint").alias("salts")
    )
    windows = written(window_rows(differing, docs), "windows")
    release(spark)
    partly = written(equal_windows(windows), "ranges").select(*DOC, F.struct("first", "last").alias("range"))
    whole = candidates.join(stretches.where("copies > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    whole = whole.select(*DOC, F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last")).alias("range"))
    ranges = whole.unionByName(partly).groupBy(*DOC).agg(F.array_sort(F.collect_set("range")).alias("ranges"))
    return ranges


def kept_bytes(raw: bytes, ranges: list) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the runs they form; windows ``first`` to ``last`` cover ``LENGTH`` more."""
    runs: list[list[int]] = []
    for r in ranges:
        first, end = r["first"], r["last"] + LENGTH
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    kept, at = [], 0
    for first, end in runs:
        kept.append(raw[at:first])
        at = end
    kept.append(raw[at:])
    return b"".join(kept), sum(end - first for first, end in runs), len(runs)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of ``df``: key, ``n_bytes, n_removed, n_spans, kept_sha256``."""
    docs = keyed(df, key, text)
    ranges = repeated_windows(df, key, text, batches)

    def run(rows: Iterator[list[list]]) -> Iterator[list[list]]:
        for documents, digests, texts, lists in rows:
            out: list[list] = [documents, digests, [], [], []]
            for content, found in zip(texts, lists, strict=True):
                kept, removed, spans = kept_bytes(content.encode("utf-8", "surrogatepass"), found)
                for column, value in zip(out[2:], (removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield out

    schema = "doc bigint, digest bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    changed = map_batches(docs.join(ranges, DOC).dropDuplicates(DOC), [*DOC, "text", "ranges"], run, schema, rows=LISTED_ROWS)
    release(df.sparkSession)
    plain = keyed(df, key, text, F.col(f"`{key}`").cast("bigint").alias("given"))
    facts = plain.select(
        *DOC, "given", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    )
    return facts.join(changed, DOC, "left").select(
        F.col("given").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
