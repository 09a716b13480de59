"""The driver tables seen as check-ins, vectors, prompts, losses and runs. Every adapter reads whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.geo import plus_code_region
from footfall.operators import cleaning, encoding, quantizer, sequences, splits
from footfall.operators.ordering import integer_block
from footfall.operators.prompts import NOTIME_MODELS
from footfall.session import staged

ORDERS_PER_BLOCK = 100_000

# Thresholds under which the filter has something to do on these tables.
EV_PLACE_MIN, EV_USER_MIN = 95, 62
LI_PLACE_MIN, LI_USER_MIN = 25, 30

CODEWORDS_PER_LEVEL = 16
REGION_CELLS = 25
# Run names that some of the orders take: the models with tables without times, and one that only looks like them.
KNOWN_RUNS = [*NOTIME_MODELS, "rqvae-nyc-div0.25-commit0.5-lr5e-5-without_L_quant"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hex_digit(column: Column, position: int) -> Column:
    """One hex character of the key's digest: a repeatable way to pick rows for odd values."""
    return F.substring(F.md5(column.cast("string")), position, 1)


def checkins_ev(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    zone = F.col("user_id") % 4
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        integer_block(F.col("event_id")).alias("row_block"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        F.concat(F.lit("v"), k.cast("string")).alias("pid"),
        F.col("event_type").alias("catname"),
        (F.lit(40.513) + F.lit(0.05) * (k % 10)).alias("lat"),
        (F.lit(-74.187) + F.lit(0.05) * F.floor(k / 10)).alias("lon"),
        F.when(zone == 0, -300).when(zone == 1, -240).when(zone == 2, 0).otherwise(540).alias("tz_offset"),
        F.col("ts").alias("utc_time"),
    )


def raw_checkins_ev(spark: SparkSession, sf: str) -> DataFrame:
    """The events as text rows, with unusable numbers, border coordinates, bad times and other zones mixed in.

    Written first, as raw rows are read from files: making the odd values is not part of cleaning them.
    """
    return staged(_raw_rows(spark, sf), "raw")


def _raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    event = F.col("event_id")
    zone = F.col("user_id") % 4
    # The fifth digit makes some offsets fractions of a minute, which are none.
    offset = F.when(hex_digit(event, 5) == "0", "330.5").when(zone == 0, "-300").when(zone == 1, "-240").when(zone == 2, "0").otherwise("540")
    lat = (F.lit(40513) + F.lit(50) * (k % 10)).cast("string")
    lon = (F.lit(74187) - F.lit(50) * F.floor(k / 10).cast("int")).cast("string")

    def thousandths(digits: Column) -> Column:
        return F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3))

    a, b, c, d = (hex_digit(event, i) for i in (1, 2, 3, 4))
    stamp = F.concat(
        F.date_format("ts", "EEE MMM dd HH:mm:ss"),
        F.when(d == "1", " +0130 ").otherwise(" +0000 "),
        F.date_format("ts", "yyyy"),
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        F.concat(F.lit("v"), k.cast("string")).alias("pid"),
        F.concat(F.lit("c-"), F.col("event_type")).alias("cat_id"),
        F.concat(F.lit("Café, "), F.col("event_type")).alias("catname"),
        F.when(a == "0", "abc").when(a == "1", "").when(a == "2", "90").when(a == "3", "-90").when(a == "4", "90.0001")
        .otherwise(thousandths(lat)).alias("lat"),
        F.when(b == "0", "180").when(b == "1", "-180").when(b == "2", "181").when(b == "3", "1e2")
        .otherwise(F.concat(F.lit("-"), thousandths(lon))).alias("lon"),
        F.when(c == "0", "").when(c == "1", "n/a").otherwise(offset).alias("tz_offset"),
        F.when(d == "0", "bad").otherwise(stamp).alias("utc_time"),
        event.alias("row_id"),
        integer_block(event).alias("row_block"),
    )


def checkins_li(spark: SparkSession, sf: str, numbers: bool = False) -> DataFrame:
    """``row_id`` is a text of 38 digits; with ``numbers`` it is their number, of the same order in less than half the bytes."""
    joined = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    row_id = F.concat(
        *(F.lpad(F.col(c).cast("string"), n, "0") for c, n in
          (("l_orderkey", 10), ("l_linenumber", 2), ("l_partkey", 10), ("l_suppkey", 8))),
        # The four keys together occur twice now and then.
        F.date_format("l_shipdate", "yyyyMMdd"),
    )
    if numbers:
        row_id = row_id.try_cast("decimal(38,0)")
    part = F.col("l_partkey")
    hours = F.pmod(part * 7 + F.col("l_linenumber"), F.lit(24)).cast("int")
    return joined.select(
        row_id.alias("row_id"),
        integer_block(F.col("l_orderkey"), ORDERS_PER_BLOCK).alias("row_block"),
        F.col("o_custkey").alias("uid"),
        part.alias("pid"),
        F.col("p_type").alias("catname"),
        (F.lit(-59.987) + part % 120).alias("lat"),
        (F.lit(-119.987) + F.floor((part % 2400) / 10)).alias("lon"),
        (60 * (F.col("o_custkey") % 5) - 120).cast("int").alias("tz_offset"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), hours)).alias("utc_time"),
    )


def clean_li(spark: SparkSession, sf: str, recency: bool = False, numbers: bool = False) -> DataFrame:
    located = cleaning.with_region(cleaning.valid_coords(checkins_li(spark, sf, numbers)))
    if recency:
        located = cleaning.visit_recency(located)
    return cleaning.project_rename(cleaning.local_time(located), [*cleaning.CLEAN_COLUMNS, *(["recency"] if recency else [])])


def visits_li(
    spark: SparkSession, sf: str, recency: bool = False, columns: Sequence[str] | None = None, numbers: bool = False
) -> DataFrame:
    # The filter reads its input four times, twice for counts: the three-table join behind it is done once.
    rows = clean_li(spark, sf, recency, numbers)
    return cleaning.frequency_filter(staged(rows.select(*(columns or rows.columns)), "clean"), LI_PLACE_MIN, LI_USER_MIN)


def staged_visits_li(spark: SparkSession, sf: str, columns: Sequence[str] | None = None, recency: bool = False) -> DataFrame:
    """The same as a written table, for queries that read it more than once and show no row ids."""
    return staged(visits_li(spark, sf, recency, columns, numbers=True), "visits")


def encoded_li(spark: SparkSession, sf: str, recency: bool = False, numbers: bool = False) -> DataFrame:
    visits = staged(visits_li(spark, sf, recency, numbers=numbers), "visits")
    dictionaries = encoding.build_dictionaries(visits)
    return encoding.apply_dictionary(visits, {name: staged(d, f"dictionary-{name}") for name, d in dictionaries.items()})


def staged_encoded_li(spark: SparkSession, sf: str, recency: bool = False) -> DataFrame:
    return staged(encoded_li(spark, sf, recency, numbers=True), "encoded-visits")


def split_li(spark: SparkSession, sf: str, numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, read back from one written table: every example set reads both.

    With ``numbers`` they have numbers as row ids, and neither category nor region, which no sequence needs.
    """
    rows = clean_li(spark, sf, numbers=numbers)
    train, test = splits.split_data(staged(rows.drop("catname", "region") if numbers else rows, "clean"))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    split = staged(both, "split", partition_by="part")
    return split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part")


def train_li(spark: SparkSession, sf: str) -> DataFrame:
    """The train rows alone, where no test row is needed."""
    rows = staged(clean_li(spark, sf, numbers=True).select("uid", "pid", "time", *cleaning.ORDER_COLUMNS), "clean")
    return splits.time_split(rows).where("is_train").drop("is_train")


def unwritten_split_li(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same as filters of the clean rows, for queries that read the test rows once: the train rows take no shuffle to read again."""
    rows = clean_li(spark, sf, numbers=True).select("uid", "pid", "time", *cleaning.ORDER_COLUMNS)
    return splits.split_data(staged(rows, "clean"))


def sequences_li(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of all splits; either part is read once for them, so the split itself is not written."""
    return sequences.generate_sequences(*unwritten_split_li(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One place per embedding with a category and one of 25 regions."""
    cell = F.col("vec_id") % REGION_CELLS
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).alias("pid"),
        F.col("embedding").cast("array<double>").alias("vector"),
        (F.col("label") + 1).alias("cat_id"),
        F.concat(F.lit("category "), F.col("label").cast("string")).alias("catname"),
        cell.alias("region_id"),
        plus_code_region(
            F.lit(40.513) + F.lit(0.05) * (cell % 5), F.lit(-74.187) + F.lit(0.05) * F.floor(cell / 5)
        ).alias("region"),
    )


def codewords(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels of 16 codewords: per level and residue class the embedding with the smallest digest, scaled down by level."""
    rows = table(spark, sf, "embeddings")
    parts = []
    for level, scale in enumerate((1.0, 0.5, 0.25)):
        draw = F.md5(F.concat(F.lit(f"{level}|"), F.col("vec_id").cast("string")))
        part = rows.groupBy((F.col("vec_id") % CODEWORDS_PER_LEVEL).cast("int").alias("code")).agg(
            F.min_by(F.col("embedding").cast("array<double>"), draw).alias("word")
        )
        # The scale is a column: a second lambda parameter would be the element's index.
        scaled = F.transform("word", lambda x: x * F.col("scale"))
        parts.append(
            part.withColumn("scale", F.lit(scale)).select(F.lit(level).alias("level"), "code", scaled.alias("centroid"))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def encoded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return quantizer.encode_places(vectors(spark, sf), codewords(spark, sf))


def staged_codes(spark: SparkSession, sf: str) -> DataFrame:
    """``pid, codes`` of the embeddings as a written codebook."""
    return staged(encoded_vectors(spark, sf).select("pid", "codes"), "codes")


def codebook(spark: SparkSession, sf: str) -> DataFrame:
    """The codebook of the embeddings with category and region attached."""
    info = vectors(spark, sf).select("pid", "cat_id", "catname", "region_id", "region")
    label = F.concat("catname", F.lit(" @ Region "), F.col("region_id").cast("string"))
    rows = encoded_vectors(spark, sf).join(info, "pid").withColumn("cat_and_region", label)
    return staged(rows, "codebook")


def place_codebook(spark: SparkSession, sf: str, codes: DataFrame | None = None) -> DataFrame:
    """Codes for every part: each takes those of the embedding its key falls on."""
    codes = (staged_codes(spark, sf) if codes is None else codes).select(F.col("pid").alias("_vec"), "codes")
    total = table(spark, sf, "embeddings").select(F.count(F.lit(1)).alias("n")).scalar()
    places = table(spark, sf, "part").select(F.col("p_partkey").alias("pid"))
    return places.withColumn("_vec", F.pmod("pid", total) + 1).join(codes, "_vec").select("pid", "codes")


def enriched_place_codebook(spark: SparkSession, sf: str) -> DataFrame:
    """``pid, codes, vector, catname, region_id`` for every part, from the embedding its key falls on."""
    book = codebook(spark, sf).select(F.col("pid").alias("_vec"), "codes", "vector", "catname", "region_id")
    total = table(spark, sf, "embeddings").select(F.count(F.lit(1)).alias("n")).scalar()
    places = table(spark, sf, "part").select(F.col("p_partkey").alias("pid"))
    return staged(places.withColumn("_vec", F.pmod("pid", total) + 1).join(book, "_vec").drop("_vec"), "place-codebook")


def dialogue_examples(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn with the assistant turn that follows it, as instruction records."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.lit("Answer the user.").alias("instruction"), "input", "output"
    )


def loss_log(spark: SparkSession, sf: str) -> DataFrame:
    """A loss history per order priority: the mean price of each month, scaled."""
    month = F.month("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run"), month.alias("epoch")).agg(
        F.round(F.avg("o_totalprice") / 100000.0, 6).alias("eval_loss")
    )


def run_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A run id per order, covering every part a name may have or lack."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    dataset = F.element_at(
        F.array(*(F.lit(x) for x in ("nyc", "tky", "NYC_Exploration", "TKY_Exploration", "NYC", "none"))), (order % 6 + 1).cast("int")
    )
    kind = F.element_at(F.array(*(F.lit(x) for x in ("rqvae", "llama3", "Nrqvae-withKL", "baseline"))), (cust % 4 + 1).cast("int"))
    div = F.concat(F.lit("-div0."), F.lpad((order % 4 * 25).cast("string"), 2, "0"))
    commit = F.when(cust % 3 == 0, "").otherwise(F.concat(F.lit("-commit0."), (cust % 10).cast("string")))
    rate = F.when(order % 5 == 0, "").otherwise(F.concat(F.lit("-lr"), (order % 9 + 1).cast("string"), F.lit("e-"), (cust % 4 + 2).cast("string")))
    flag = F.when(order % 7 == 0, "-without_L_quant").when(order % 7 == 1, "-without_L_reconstruction").otherwise("")
    made = F.concat(kind, F.lit("-"), dataset, F.when(order % 11 == 0, "").otherwise(div), commit, rate, flag)
    known = F.element_at(F.array(*map(F.lit, KNOWN_RUNS)), (F.floor(order / 13) % len(KNOWN_RUNS) + 1).cast("int"))
    run = F.concat(F.lit("org/"), F.when(order % 13 == 0, known).otherwise(made))
    return table(spark, sf, "orders").select(order.alias("order_key"), run.alias("run_id"))
