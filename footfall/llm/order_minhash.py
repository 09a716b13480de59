"""Order MinHash fingerprints: sketches of texts that see the order of their k-mers, hence their edit distance.

All of it is DataFrame functions; no Python code runs on the executors.

1. A text's k-mers are its stretches of ``K`` units of UTF-16 (code points, but for those beyond the first 65,536, which have two); one
   that comes again is another k-mer, told apart by its occurrence number.
2. Every numbered k-mer gets one place on a ring of 36-bit numbers, a digest of the k-mer and of its occurrence.
3. ``SLOTS`` rotations of the ring are the permutations: rotation ``j`` starts at ``j / SLOTS`` of it, and the ``TUPLE`` k-mers that
   follow are the smallest under it. They are put back in the order of the text, and the digest of that tuple is the slot.

The likeness of two fingerprints is the share of equal slots. A text of fewer than ``K`` units, the empty one too, is one k-mer
as a whole; with fewer than ``TUPLE`` k-mers all of them form the tuple. Work on a text grows with its length times the logarithm of it;
texts may have up to 2**27 units.

``with_next`` pairs every row with the row that follows by descending key, the first after the last. Rows are dealt to ranges of keys;
the first rows of a range go to the preceding one as well, so that one shuffle of the texts and a window inside each range are
enough. Null texts count as empty; null keys come last; rows of one key follow each other by the digest of their texts, so repeated
rows are each other's neighbours; all rows of one key stay in one range and are sorted there, on disk if they have to be. An empty table
gives no rows. Columns other than key and text do not take part and are not returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 8
SLOTS = 64
TUPLE = 2
# Low bits of a packed number: the place of the k-mer in the text. The others are its place on the ring.
PLACE_BITS = 28
# Bytes of one unit of a text, and the encoding that has them.
WIDTH, CHARSET = 2, "UTF-16BE"
PLACE = (1 << PLACE_BITS) - 1
# Rows of a range of keys, and the most ranges: their borders are one small row.
RANGE_ROWS = 1_024
MAX_RANGES = 16_384
# Bits of the distances to a k-mer's first occurrence that are searched before all of them.
NEAR_BITS = (3, 7)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where ``body`` reads it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _leading(numbers: Column, steps: Column, test: Callable[[Column], Column]) -> Column:
    """How many leading elements of ``numbers`` pass ``test``, which no later one does.

    ``steps`` are falling powers of two. What lies behind the end is null and passes no test.
    """
    last = F.aggregate(
        steps, F.lit(-1), lambda at, step: F.when(test(F.get(numbers, at + step)), at + step).otherwise(at)
    )
    return last + 1


def _powers(n: Column) -> Column:
    """Powers of two up to ``n``, the largest first."""
    top = F.floor(F.log2(F.greatest(n, F.lit(1)) + 0.5)).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda bit: F.pow(F.lit(2), bit).cast("int"))


def _kmers(text: Column, k: int) -> Column:
    """Packed digest and place of every k-mer, in text order; a place is where its first byte stands, from 1 on."""

    def of(wide: Column) -> Column:
        last = F.greatest(F.octet_length(wide) - WIDTH * k + 1, F.lit(1))
        return F.transform(
            F.sequence(F.lit(1), last, F.lit(WIDTH)),
            lambda at: F.xxhash64(F.substring(wide, at, F.lit(WIDTH * k))).bitwiseAND(F.lit(~PLACE)).bitwiseOR(at),
        )

    # The same number of bytes for each unit: every stretch can be cut out without walking the text.
    return _let(F.encode(text, CHARSET), of)


def _numbered(sorted_kmers: Column) -> Column:
    """The k-mers with the second, third, ... occurrence of one moved to a place on the ring of its own."""
    # Read through a variable: a column read inside a lambda is looked up in the row again for every element.
    return _let(sorted_kmers, lambda held: F.transform(sorted_kmers, _moved(held)))


def _moved(by_digest: Column) -> Callable[[Column, Column], Column]:
    def same(x: Column, at: Column) -> Column:
        # No element behind is smaller, so the digests are equal unless ``x`` lies beyond all places of that one; null before the first.
        return x <= F.get(by_digest, at).bitwiseOR(F.lit(PLACE))

    def moved(x: Column, number: Column) -> Column:
        return (
            F.xxhash64(F.shiftright(x, PLACE_BITS), number)
            .bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))
        )

    def far(x: Column, i: Column, steps: Column) -> Column:
        # Equal k-mers stand side by side, so the first of them is found by halving steps, from the third one back.
        first = F.aggregate(
            steps, i - 3, lambda found, step: F.when(same(x, found - step), found - step).otherwise(found)
        )
        return i - first

    def number(x: Column, i: Column) -> Column:
        # Steps enough for the distance are tried in turn, as most k-mers come a few times only.
        searched = far(x, i, _powers(i))
        for bits in reversed(NEAR_BITS):
            reach = 3 + (1 << bits)
            searched = F.when(same(x, i - reach), searched).otherwise(
                far(x, i, F.array(*[F.lit(1 << b) for b in reversed(range(bits))]))
            )
        return F.when(same(x, i - 2), F.when(same(x, i - 3), searched).otherwise(F.lit(2))).otherwise(F.lit(1))

    return lambda x, i: F.when(same(x, i - 1), moved(x, number(x, i))).otherwise(x)


def _slot(start: Column, held: Column) -> Column:
    """Digest of the k-mers from ``start`` on, in text order; the ring's first ones follow its last."""
    first = _leading(held["ring"], held["steps"], lambda x: x < start)
    places = _let(
        first,
        lambda at: F.transform(
            held["offsets"], lambda k: F.get(held["ring"], (at + k) % held["size"]).bitwiseAND(F.lit(PLACE)).cast("int")
        ),
    )
    ordered = F.transform(
        F.sort_array(places),
        lambda at: F.shiftright(F.get(held["kmers"], F.shiftright(at, WIDTH.bit_length() - 1)), PLACE_BITS),
    )
    return F.xxhash64(ordered).bitwiseAND(F.lit(0xFFFFFFFF))


def with_slots(df: DataFrame, text: str, slots: str, k: int = K, n_slots: int = SLOTS, size: int = TUPLE) -> DataFrame:
    """Adds the column ``slots``: the numbers of the fingerprint of ``text``. ``_omh_*`` are names used on the way."""
    starts = F.array(*[F.lit(-(1 << 63) + j * (1 << 64) // n_slots) for j in range(n_slots)])
    kept = [F.col(f"`{c}`") for c in df.columns]
    kmers, by_digest, ring = F.col("_omh_kmers"), F.col("_omh_by_digest"), F.col("_omh_ring")
    # One projection for each array that the next one reads more than once: arrays of numbers are sorted in compiled code.
    return (
        df.select(*kept, _kmers(F.coalesce(F.col(f"`{text}`"), F.lit("")), k).alias("_omh_kmers"))
        .select(*kept, kmers, F.sort_array(kmers).alias("_omh_by_digest"))
        .select(*kept, kmers, F.sort_array(_numbered(by_digest)).alias("_omh_ring"))
        .select(
            *kept,
            F.struct(
                ring.alias("ring"), kmers.alias("kmers"), _powers(F.size(ring)).alias("steps"), F.size(ring).alias("size"),
                F.sequence(F.lit(0), F.least(F.size(ring), F.lit(size)) - 1).alias("offsets"),
            ).alias("_omh_held"),
        )
        .select(*kept, _let(F.col("_omh_held"), lambda held: F.transform(starts, lambda s: _slot(s, held))).alias(slots))
    )


def written_out(slots: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each slot."""
    return F.lower(F.array_join(F.transform(slots, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def with_next(df: DataFrame, key: str, columns: list[str], digest: Column) -> DataFrame:
    """Adds ``next``, the named columns of the row that follows by descending ``key``; after the last comes the first."""
    # The complement falls as the key rises and, unlike the negative, exists for every key.
    order = F.coalesce(F.bitwise_not(F.col(f"`{key}`").cast("bigint")), F.lit((1 << 63) - 1))
    rows = df.count()
    if not rows:
        return df.withColumn("next", F.struct(*[F.col(f"`{c}`") for c in columns]))
    ranges = min(MAX_RANGES, -(-rows // RANGE_ROWS))
    cuts = F.percentile_approx("o", [j / ranges for j in range(1, ranges)] or [1.0], max(10_000, 4 * ranges))
    low, found = df.select(order.alias("o")).agg(F.min("o"), cuts).first()
    # Borders are values of the table, so each is the first of its own range.
    borders = sorted({low, *(found if ranges > 1 else [])})
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(borders).bit_length()))])
    own = F.array(*[F.lit(b) for b in borders])
    placed = (
        df.withColumn("_o", order).withColumn("_range", _leading(own, steps, lambda b: b <= F.col("_o")))
        .withColumn("_first", F.get(own, F.col("_range") - 1) == F.col("_o"))
    )
    before = F.when(F.col("_range") > 1, F.col("_range") - 1).otherwise(F.lit(len(borders)))
    homes = F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy")))
    copied = F.concat(homes, F.array(F.struct(before.alias("range"), F.lit(True).alias("copy"))))
    spread = placed.withColumn("_home", F.explode(F.when(F.col("_first"), copied).otherwise(homes)))
    follows = W.partitionBy("_home.range").orderBy("_home.copy", "_o", F.col(f"`{key}`").isNull(), digest)
    return (
        spread.withColumn("next", F.lead(F.struct(*[F.col(f"`{c}`") for c in columns])).over(follows))
        .where(~F.col("_home.copy")).drop("_o", "_range", "_first", "_home")
    )


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, fingerprint`` of every row."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return with_slots(rows, "text", "slots").select(
        F.col("key").alias(key), F.char_length("text").cast("bigint").alias("n_chars"),
        written_out(F.col("slots")).alias("fingerprint"),
    )


def edit_comparison(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text whose last half is replaced by the start of the next row's, and their likeness."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    placed = rows.withColumn("digest", F.xxhash64("text"))
    signed = with_slots(placed, "text", "slots")
    half = F.floor(F.char_length("text") / 2).cast("int")
    paired = with_next(signed, "key", ["text", "slots"], F.col("digest")).select(
        "key", F.char_length("text").cast("bigint").alias("n_chars"), "slots", F.col("next.slots").alias("next_slots"),
        F.concat(
            F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next.text", F.lit(1), half)
        ).alias("edited"),
    )
    return with_slots(paired, "edited", "edited_slots").select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written_out(F.col("slots")).alias("fingerprint"), written_out(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )
