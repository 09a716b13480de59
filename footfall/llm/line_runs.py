"""Repeated runs of lines, found on a suffix array over line numbers, and deleted but for their first copy.

The sequence of a document are its lines that hold a word; blank lines are kept and not counted. A run of lines is deleted when
it has at least ``min_words`` words and the same lines stand at an earlier place (by document key, then line). Runs never
cross documents.

1. Lines get numbers in the order of their digests; lines that occur once are in no run and leave.
2. Prefix doubling: the rank of a suffix by its first ``2h`` lines comes from its rank by ``h`` lines and that of the suffix ``h`` lines
   on. A new rank is the old one plus the suffixes of the same old rank that sort before, so each step sorts inside old ranks
   only. Suffixes whose pair occurs once leave. As every line has a word, ``min_words`` lines are deep enough.
3. Suffixes that share ``l`` lines form an interval of common prefixes at least ``l`` long; its name is the ranks of the two
   stretches of ``2^k`` lines that cover it. The interval's smallest place is the first copy.
4. Of a run with at least ``min_words`` words every line lies in a stretch inside the run that has just enough words counted
   from its first or from its last line. So looking up these stretches finds the lines of all maximal runs.

Null texts have no lines. Rows with one key and text count as one document; with one key and different texts they are
ordered by a digest of the text; null keys come last. Hot lines, hot intervals and long documents are split by Spark's skewed
joins; the ranks of one old rank are counted before they are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.llm.common import map_batches, spare, written

MIN_WORDS = 5
# Top bits of a line's digest that cut the order of lines into buckets.
BUCKET_BITS = 12
DOC = ["doc", "digest"]


def line_rows(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """``doc, digest, seq, line, words, h1, h2``: the lines with words; ``seq`` counts them, ``line`` counts all."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, digests, texts in batches:
            out: list[list] = [[] for _ in range(6)]
            parts = []
            for key_, digest, text_ in zip(keys, digests, texts, strict=True):
                seq = 0
                for number, line in enumerate((text_ or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    words = len(line.split(None, min_words))
                    if words:
                        parts.append(hashlib.blake2b(line, digest_size=16).digest())
                        row = (key_, digest, seq, number, min(words, min_words))
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                        seq += 1
            halves = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
            yield [*out[:5], halves[:, 0], halves[:, 1]]

    plain = df.select(
        F.col(f"`{key}`").cast("bigint").alias("doc"), F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{text}`").alias("text")
    )
    schema = "doc bigint, digest bigint, seq bigint, line bigint, words bigint, h1 bigint, h2 bigint"
    return map_batches(plain, ["doc", "digest", "text"], run, schema)


def first_ranks(lines: DataFrame) -> DataFrame:
    """``h1, h2, r1``: for lines that occur more than once, how many of their occurrences sort before."""
    counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = counts.withColumn("bucket", F.shiftright("h1", 64 - BUCKET_BITS))
    before = W.partitionBy("bucket").orderBy("h1", "h2").rowsBetween(W.unboundedPreceding, -1)
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most 4,096 rows.
    offsets = totals.select("bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return ranked.join(F.broadcast(offsets), "bucket").select("h1", "h2", (F.col("offset") + F.col("before")).alias("r1"))


def doubled(suffixes: DataFrame, h: int) -> DataFrame:
    """Adds ``r{2h}``, the rank by ``2h`` lines, null where no other suffix shares them."""
    old, new = f"r{h}", f"r{2 * h}"
    ahead = W.partitionBy(*DOC).orderBy("seq").rangeBetween(h, h)
    pairs = suffixes.withColumn("_next", F.max(old).over(ahead))
    counts = pairs.where(f"{old} is not null and _next is not null").groupBy(old, "_next").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(old).orderBy("_next").rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.where("n > 1").select(old, "_next", (F.col(old) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias(new))
    return pairs.join(ranks, [old, "_next"], "left").drop("_next")


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, digest, lines array<bigint>, n_runs``: numbers (from 0) of the lines to delete, for texts that have any."""
    lines = written(line_rows(df, key, text, min_words).distinct(), "lines")
    suffixes = lines.join(first_ranks(lines), ["h1", "h2"]).drop("h1", "h2")
    depths = [1]
    while 2 * depths[-1] <= min_words:
        suffixes = written(suffixes, "suffixes")
        suffixes = doubled(suffixes, depths[-1])
        depths.append(2 * depths[-1])
    ranks = [f"r{d}" for d in depths]
    # The lines from here on, as far as they follow each other without a gap.
    ahead = W.partitionBy(*DOC).orderBy("seq").rangeBetween(0, min_words - 1)
    view = suffixes.withColumn("ahead", F.collect_list(F.struct("seq", "line", "words", *ranks)).over(ahead))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("ahead")),
        lambda n: F.struct(
            n.alias("l"), F.aggregate(F.slice("ahead", 1, n), F.lit(0).cast("bigint"), lambda s, e: s + e["words"]).alias("sum")
        ),
    )
    enough = F.filter(
        sums,
        lambda s: (s["sum"] >= min_words)
        & (
            (s["sum"] - F.element_at("ahead", s["l"])["words"] < min_words)
            | (s["sum"] - F.col("words") < min_words)
        )
        & (F.element_at("ahead", s["l"])["seq"] == F.col("seq") + s["l"] - 1),
    )
    stretches = view.withColumn("l", F.explode(F.transform(enough, lambda s: s["l"])))
    first = last = F.lit(None).cast("bigint")
    for d, rank in zip(depths, ranks, strict=True):
        here = (F.col("l") >= d) & (F.col("l") < 2 * d)
        first = F.when(here, F.col(rank)).otherwise(first)
        last = F.when(here, F.element_at("ahead", F.col("l") - d + 1)[rank]).otherwise(last)
    place = F.struct(F.col("doc").isNull().alias("unknown"), *DOC, "seq")
    stretches = stretches.select(
        *DOC, "seq", "l", first.alias("first"), last.alias("last"), place.alias("place"),
        F.transform(F.slice("ahead", 1, F.col("l")), lambda e: F.struct(e["seq"], e["line"])).alias("covered"),
    ).where("first is not null and last is not null")
    stretches = written(stretches, "stretches")
    leaders = stretches.groupBy("l", "first", "last").agg(F.min("place").alias("leader"), F.count(F.lit(1)).alias("n"))
    later = stretches.join(leaders.where("n > 1"), ["l", "first", "last"]).where(~F.col("place").eqNullSafe(F.col("leader")))
    gone = later.select(*DOC, F.explode("covered").alias("e")).distinct()
    whole = gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("e")).alias("e"))
    seqs = F.transform("e", lambda e: e["seq"])
    starts = F.size(F.array_except(seqs, F.transform(seqs, lambda s: s + 1)))
    return whole.select(*DOC, F.transform("e", lambda e: e["line"]).alias("lines"), starts.alias("n_runs"))


def without_repeats(
    df: DataFrame, out: str, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``df`` with shortened texts and a struct ``out``: ``n_removed, n_runs``. Every row stays; null texts stay null."""
    if out in df.columns:
        raise ValueError(f"the input has a column {out}")
    doc, digest, found = spare(df.withColumn(out, F.lit(0)), "_gone_doc", "_gone_digest", "_gone")
    gone = removed_lines(df, key, text, min_words).select(
        F.col("doc").alias(doc), F.col("digest").alias(digest), F.struct("lines", "n_runs").alias(found)
    )
    column = F.col(f"`{text}`")
    joined = df.join(
        gone, F.col(f"`{key}`").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(column) == F.col(digest)), "left"
    )
    parts = F.split(column, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1).cast("array<bigint>"), F.col(f"{found}.lines"))
    shorter = F.array_join(F.transform(left, lambda i: F.get(parts, i.cast("int"))), "\n")
    figures = F.struct(
        F.coalesce(F.size(f"{found}.lines"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(f"{found}.n_runs", F.lit(0)).cast("bigint").alias("n_runs"),
    )
    figures = F.when(F.col(found).isNotNull(), figures).otherwise(
        F.struct(F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_runs"))
    )
    return (
        joined.withColumn(text, F.when(F.col(found).isNotNull(), shorter).otherwise(column))
        .withColumn(out, figures)
        .drop(found, doc, digest)
    )


def keep_first_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``df`` with their texts shortened; rows of which no word is left go, those that had none stay."""
    (out,) = spare(df, "_line_runs")
    rows = without_repeats(df, out, key, text, min_words)
    empty = (F.col(f"{out}.n_removed") > 0) & ~F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]")
    return rows.where(~empty).drop(out)
