"""One query per operator over the driver tables: ``CATALOG[key](spark, sf_dir) -> DataFrame``.

Lists are shown as joined text, doubles rounded to six places and times as text, so that results compare by value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.seeded import digest
from footfall.functions.text import TIME_FORMAT, parse_list, sid_text
from footfall.operators import (
    cleaning,
    encoding,
    evaluation,
    features,
    graph,
    profiles,
    prompts,
    quantizer,
    regions,
    runs,
    scoring,
    sequences,
    sid_report,
    splits,
    training,
)
from footfall.plans import adapters as A
from footfall.plans import dataset
from footfall.plans.dataset import process_clean
from footfall.session import release, scratch, scratch_folder, staged
from footfall.sources import checkins, codebooks, instructions, tables

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    CATALOG[fn.__name__] = fn
    return fn


def joined(column: str, sep: str = ",") -> Column:
    return F.array_join(F.col(column).cast("array<string>"), sep).alias(column)


def stamp(column: str, name: str | None = None) -> Column:
    return F.date_format(column, TIME_FORMAT).alias(name or column)


def r6(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, 6)
    return out.alias(name or column) if name or isinstance(column, str) else out


# ---- sources and sinks ----


@query
def read_checkins(spark, sf):
    path = scratch_folder(spark, "raw-checkins")
    A.raw_checkins_ev(spark, sf).write.option("encoding", "ISO-8859-1").option("escape", '"').csv(path, header=True)
    rows = checkins.read_checkins(spark, path, extra="row_id bigint, row_block bigint")
    return rows.select("row_id", *(F.coalesce(c, F.lit("")).alias(c) for c in checkins.RAW_COLUMNS))


@query
def read_checkins_in_order(spark, sf):
    """Files in an order of their own, with line breaks and quotes in half of the category names: the places of each user as they stand there."""
    path = scratch_folder(spark, "ordered-checkins")
    broken = F.concat("catname", F.lit(",\r\n\"second\" line\n"), "cat_id")
    rows = A.raw_checkins_ev(spark, sf).withColumn("_place", F.md5(F.col("row_id").cast("string")))
    rows = rows.withColumn("catname", F.when(F.substring("_place", 32, 1) < "8", broken).otherwise(F.col("catname")))
    files = rows.repartitionByRange(3, "_place").sortWithinPartitions("_place").select(*checkins.RAW_COLUMNS)
    files.write.option("encoding", checkins.CHARSET).option("escape", '"').csv(path, header=True)
    read = staged(checkins.read_checkins_in_order(spark, path), "ordered")
    return graph.user_place_sequence(read).select("uid", "segment", joined("pids"), joined("catnames", "|"))


@query
def parse_list_column(spark, sf):
    """List literals made from the orders: numbers, words, empty, null, and a literal that no list parser takes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    numbers = F.concat(F.lit("["), c, F.lit(", "), k.cast("string"), F.lit("]"))
    text = (
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 1, "[]")
        .when(k % 5 == 2, F.concat(F.lit("[Timestamp('"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("')]")))
        .otherwise(numbers)
    )
    words = F.concat(F.lit("['"), F.col("o_orderpriority"), F.lit("', '"), F.col("o_orderstatus"), F.lit("']"))
    rows = A.table(spark, sf, "orders").select("o_orderkey", parse_list(text).alias("ints"), parse_list(words, "string").alias("words"))
    return rows.select("o_orderkey", F.size("ints").cast("bigint").alias("n"), joined("ints"), joined("words", "|"))


@query
def read_instructions(spark, sf):
    folder = scratch_folder(spark, "instructions")
    path = instructions.write_instructions(A.dialogue_examples(spark, sf), folder, "train", "codebook")
    return instructions.read_instructions(spark, path, lines=True)


def _instruction_array(spark, sf):
    folder = scratch_folder(spark, "instruction-array")
    return instructions.write_instruction_array(
        A.dialogue_examples(spark, sf), folder, "train", "codebook", order=["conv_id", "turn"]
    )


@query
def read_instruction_array(spark, sf):
    """Round trip through one JSON array."""
    return instructions.read_instructions(spark, _instruction_array(spark, sf))


@query
def first_instructions(spark, sf):
    """The first fifty records of an array, in its order."""
    return instructions.read_instructions(spark, _instruction_array(spark, sf), max_examples=50)


@query
def write_instructions(spark, sf):
    """Round trip by split: what was written under each file name comes back."""
    folder = scratch_folder(spark, "instructions")
    examples = staged(A.dialogue_examples(spark, sf), "examples")
    for i, mode in enumerate(("train", "val", "test")):
        instructions.write_instructions(examples.where(F.col("conv_id") % 3 == i), folder, mode, "id", with_time=False)
    back = instructions.read_instruction_folder(spark, folder)
    return back.select("file_name", "instruction", "input", "output")


@query
def split_from_filename(spark, sf):
    folder = scratch_folder(spark, "split-files")
    examples = staged(A.dialogue_examples(spark, sf), "examples")
    for i, mode in enumerate(prompts.MODES):
        instructions.write_instructions(examples.where(F.col("conv_id") % 4 == i), folder, mode, "codebook")
    back = instructions.read_instruction_folder(spark, folder)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.sum(F.length("output")).alias("chars"))


@query
def read_codebook(spark, sf):
    path = scratch_folder(spark, "codebook")
    codebooks.write_codebook_csv(A.encoded_vectors(spark, sf), path)
    back = codebooks.read_codebook_csv(spark, path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return back.select(F.col("pid").cast("bigint").alias("pid"), joined("codes"), r6(total, "vector_sum"))


@query
def write_tables(spark, sf):
    """All tables of a processed data set, written and read back: rows and weighted sums of each table and split."""
    clean = A.clean_li(spark, sf, numbers=True)
    data = process_clean(clean, A.LI_PLACE_MIN, A.LI_USER_MIN)
    paths = tables.write_tables(data.tables(), scratch_folder(spark, "tables"), partition_by={"sequences": "split"})
    back = {p.rsplit("/", 1)[1]: spark.read.parquet(p) for p in paths}
    sums = {name: F.col("mapped") for name in back if name.startswith("dictionary_")}
    sums |= dict.fromkeys(("train", "test"), F.col("uid") + 3 * F.col("pid"))
    sums["visits"] = F.col("uid") + 3 * F.col("pid") + 5 * F.col("catname") + 7 * F.col("region")
    sums["profile"] = F.size("uids") + 3 * F.size("times") + 5 * F.size("neighbors") + 7 * F.size("forward_neighbors")
    sums["sequences"] = F.col("target") + 3 * F.size("pids") + 5 * F.element_at("pids", 1)
    sums["metadata"] = F.col("total_dim")
    sums["features"] = F.col("idx")
    parts = []
    for name, value in sums.items():
        table_name = F.concat(F.lit(f"{name}_"), "split") if name == "sequences" else F.lit(name)
        rows = back[name].select(table_name.alias("table_name"), value.cast("bigint").alias("v"))
        parts.append(rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _run_metrics(spark, sf):
    order = A.table(spark, sf, "orders")
    return order.groupBy(F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_name")).agg(
        r6(F.avg((F.col("o_orderstatus") == "F").cast("int")), "train_acc"),
        r6(F.avg((F.col("o_orderstatus") == "O").cast("int")), "val_acc"),
        r6(F.avg((F.col("o_orderstatus") == "P").cast("int")), "test_all_acc"),
        r6(F.avg((F.col("o_orderpriority") == "5-LOW").cast("int")), "test_acc"),
    )


@query
def append_new_runs(spark, sf):
    """A table of some runs, then all runs offered twice: each name is there once, the older row stays."""
    path = scratch_folder(spark, "metrics")
    offered = _run_metrics(spark, sf)
    older = offered.where(F.substring(F.md5("run_name"), 1, 1) < "8").withColumn("test_acc", F.lit(-1.0))
    tables.append_new_runs(spark, older, path)
    repeated = offered.unionByName(offered.withColumn("train_acc", F.col("train_acc") + 1))
    tables.append_new_runs(spark, repeated, path)
    return tables.read_runs(spark, path)


@query
def feature_metadata(spark, sf):
    m = features.feature_metadata(A.staged_visits_li(spark, sf))
    offsets = [F.col(f"feature_offsets.{b}").alias(f"{b}_offset") for b in ("category", "region", "temporal", "collaborative")]
    return m.select("num_pois", "num_categories", "num_regions", "num_users", "num_time_bins", "total_dim", *offsets)


# ---- cleaning ----


@query
def coerce_numeric(spark, sf):
    rows = cleaning.coerce_numeric(A.raw_checkins_ev(spark, sf))
    return rows.select(
        "row_id",
        F.coalesce("lat", F.lit(-999.0)).alias("lat"),
        F.coalesce("lon", F.lit(-999.0)).alias("lon"),
        F.coalesce("tz_offset", F.lit(-999)).alias("tz_offset"),
    )


def _valid_ev(spark, sf):
    return cleaning.valid_coords(cleaning.coerce_numeric(A.raw_checkins_ev(spark, sf)))


@query
def valid_coords(spark, sf):
    return _valid_ev(spark, sf).select("row_id", "lat", "lon")


@query
def plus_code_region(spark, sf):
    return cleaning.with_region(_valid_ev(spark, sf)).select("row_id", "region")


@query
def parse_utc(spark, sf):
    return cleaning.parse_utc(A.raw_checkins_ev(spark, sf)).select("row_id", stamp("utc_time"))


@query
def local_time(spark, sf):
    timed = cleaning.parse_utc(cleaning.coerce_numeric(A.raw_checkins_ev(spark, sf)))
    return cleaning.local_time_text(timed).select("row_id", "time_text")


@query
def project_rename(spark, sf):
    by_name = A.checkins_li(spark, sf).withColumnsRenamed({"uid": "User ID", "pid": "Venue ID"})
    located = cleaning.local_time(cleaning.with_region(by_name))
    renamed = cleaning.project_rename(located, cleaning.CLEAN_COLUMNS, {"User ID": "uid", "Venue ID": "pid"})
    return renamed.select("row_id", "uid", "pid", "catname", "region", stamp("time"))


@query
def visit_recency(spark, sf):
    return A.clean_li(spark, sf, recency=True).select("row_id", "recency")


@query
def frequency_filter(spark, sf):
    return A.visits_li(spark, sf, columns=["row_id", "uid", "pid"])


@query
def frequency_filter_events(spark, sf):
    return cleaning.frequency_filter(A.checkins_ev(spark, sf), A.EV_PLACE_MIN, A.EV_USER_MIN).select("row_id", "uid", "pid")


@query
def clean_checkins(spark, sf):
    """Text rows to clean check-ins in one go."""
    rows = cleaning.clean_checkins(A.raw_checkins_ev(spark, sf), with_recency=True)
    return rows.select("row_id", "uid", "pid", "catname", "region", stamp("time"), "recency")


# ---- dictionaries ----


@query
def build_dictionary(spark, sf):
    visits = A.staged_visits_li(spark, sf)
    parts = [
        d.select(F.lit(name).alias("dictionary"), F.col("original").cast("string").alias("original"), "mapped")
        for name, d in encoding.build_dictionaries(visits).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def apply_dictionary(spark, sf):
    return A.encoded_li(spark, sf).select("row_id", "uid", "pid", "catname", "region")


@query
def reverse_dictionary(spark, sf):
    visits = A.staged_visits_li(spark, sf)
    names = encoding.build_dictionary(visits, "catname")
    heads = encoding.apply_dictionary(profiles.place_heads(visits), {"catname": names})
    return encoding.reverse_dictionary(heads, "catname", names, "category").select("pid", "catname", "category")


# ---- profiles and graph ----

# What the order of a user's places takes.
STEP_COLUMNS = ["uid", "pid", "row_id", "row_block"]


@query
def user_place_sequence(spark, sf):
    return graph.user_place_sequence(A.staged_visits_li(spark, sf)).select("uid", "segment", joined("pids"), joined("catnames"))


@query
def forward_neighbors(spark, sf):
    return graph.forward_neighbors(A.staged_visits_li(spark, sf, STEP_COLUMNS))


@query
def neighbors(spark, sf):
    return graph.neighbors(A.staged_visits_li(spark, sf, STEP_COLUMNS))


@query
def forward_neighbors_events(spark, sf):
    """Few places and many visits: frequencies well above one."""
    return graph.forward_neighbors(A.checkins_ev(spark, sf), min_freq=2)


@query
def place_profile(spark, sf):
    rows = profiles.place_profile(A.staged_visits_li(spark, sf))
    times = F.array_join(F.transform("times", lambda t: F.date_format(t, TIME_FORMAT)), ",").alias("times")
    return rows.select("pid", "segment", "catname", "region", joined("uids"), times)


@query
def attach_neighbors(spark, sf):
    visits = A.staged_visits_li(spark, sf)
    full = graph.attach_neighbors(visits, graph.neighbors(visits), graph.forward_neighbors(visits))
    return full.select("pid", "segment", "catname", joined("neighbors"), joined("forward_neighbors"))


@query
def latest_visit_per_user(spark, sf):
    return profiles.latest_visit_per_user(A.staged_visits_li(spark, sf, [*STEP_COLUMNS, "recency"], recency=True)).select(
        "pid", "position", "uid", "recency"
    )


# ---- features ----


def _shown(long_form: DataFrame) -> DataFrame:
    return long_form.select("pid", "idx", r6("value"))


@query
def onehot_block(spark, sf):
    visits = A.staged_encoded_li(spark, sf)
    dim = visits.select(F.count_distinct("catname").alias("n")).scalar()
    return _shown(features.onehot_block(profiles.place_heads(visits), "catname", dim))


@query
def multihot_topk_users(spark, sf):
    visits = A.staged_encoded_li(spark, sf)
    dim = visits.select(F.count_distinct("uid").alias("n")).scalar()
    return _shown(features.multihot_topk_users(profiles.first_visits(visits, "uid"), dim))


@query
def multihot_topk_hours(spark, sf):
    return _shown(features.multihot_topk_hours(profiles.first_visits(A.staged_encoded_li(spark, sf), "time")))


@query
def recency_weighted_users(spark, sf):
    visits = A.staged_encoded_li(spark, sf, recency=True)
    dim = visits.select(F.count_distinct("uid").alias("n")).scalar()
    return _shown(features.recency_weighted_users(profiles.visitor_recency(visits), dim))


@query
def assemble_features(spark, sf):
    visits = A.staged_encoded_li(spark, sf)
    return _shown(
        features.assemble_features(
            profiles.place_heads(visits), profiles.first_visits(visits, "time"), profiles.first_visits(visits, "uid"), features.feature_metadata(visits)
        )
    )


@query
def recency_pipeline(spark, sf):
    """The features of the whole chain in its recency variant, from clean check-ins on."""
    data = process_clean(A.clean_li(spark, sf, recency=True, numbers=True), A.LI_PLACE_MIN, A.LI_USER_MIN, with_recency=True)
    return data.features.select("pid", "idx", r6("value"))


@query
def feature_vectors(spark, sf):
    visits = A.staged_encoded_li(spark, sf)
    metadata = features.feature_metadata(visits)
    rows = features.assemble_features(
        profiles.place_heads(visits), profiles.first_visits(visits, "time"), profiles.first_visits(visits, "uid"), metadata
    )
    vectors = features.sparse_vectors(rows, metadata.select("total_dim").scalar())
    return vectors.select("pid", "dim", joined("indices"), joined("values"))


@query
def pid_to_index(spark, sf):
    return features.pid_to_index(profiles.place_heads(A.staged_visits_li(spark, sf)))


# ---- split and sequences ----


@query
def time_split(spark, sf):
    return splits.time_split(staged(A.clean_li(spark, sf), "clean")).select("row_id", F.col("is_train").cast("int").alias("is_train"))


@query
def drop_cold_test_rows(spark, sf):
    return A.split_li(spark, sf)[1].select("row_id", "uid", "pid")


@query
def union_train_test(spark, sf):
    train, test = A.split_li(spark, sf)
    return splits.union_train_test(train, test).select("row_id", "uid", "pid", stamp("time"))


def _shown_visits(name: str) -> list[Column]:
    visits = F.col(name)
    return [
        F.size(visits).alias("n"),
        F.array_join(F.transform(visits, lambda v: v["pid"].cast("string")), ",").alias("pids"),
    ]


@query
def cap_history(spark, sf):
    return sequences.cap_history(A.train_li(spark, sf)).select("uid", *_shown_visits("visits"))


@query
def train_windows(spark, sf):
    windows = sequences.train_windows(sequences.cap_history(A.train_li(spark, sf))).where(F.size("window") == sequences.WINDOW)
    return windows.select("uid", "seq_no", "end", *_shown_visits("window"))


@query
def short_history_example(spark, sf):
    windows = sequences.train_windows(sequences.cap_history(A.train_li(spark, sf))).where(F.size("window") < sequences.WINDOW)
    return windows.select("uid", "end", *_shown_visits("window"))


def _shown_sequences(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra, "uid", "seq_no", joined("pids"), joined("times"), "target", "target_time")


@query
def mask_augment(spark, sf):
    return _shown_sequences(sequences.train_sequences(A.train_li(spark, sf)))


@query
def test_examples(spark, sf):
    return _shown_sequences(sequences.test_examples(A.clean_li(spark, sf)))


@query
def val_examples(spark, sf):
    return _shown_sequences(sequences.val_examples(A.clean_li(spark, sf)))


@query
def generate_all_splits(spark, sf):
    return _shown_sequences(A.sequences_li(spark, sf), "split")


@query
def format_times(spark, sf):
    history = sequences.recent_visits(A.clean_li(spark, sf), sequences.HISTORY_CAP)
    from footfall.functions.text import format_times as texts

    return history.select("uid", texts(F.transform("visits", lambda v: v["time"])).alias("times")).select("uid", joined("times"))


# ---- residual quantisation ----


@query
def nearest_codeword(spark, sf):
    return quantizer.nearest_codeword(A.vectors(spark, sf), A.codewords(spark, sf))


@query
def residual_codes(spark, sf):
    return quantizer.residual_codes(A.vectors(spark, sf), A.codewords(spark, sf)).select("pid", joined("codes"))


@query
def fit_codebooks(spark, sf):
    """Five of Lloyd's steps per level on all vectors: every codeword and how many places take it."""
    vectors = A.vectors(spark, sf)
    fitted = quantizer.fit_codebooks(vectors, vector_num=16, max_iter=FIT_STEPS)
    used = quantizer.explode_codes(quantizer.encode_places(vectors, fitted)).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    words = fitted.select("level", "code", r6(total, "centroid_sum"), r6(F.get("centroid", F.lit(0)), "centroid_0"))
    return words.join(used, ["level", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


FIT_STEPS = 5


def _assigned(spark, sf):
    return quantizer.explode_codes(A.encoded_vectors(spark, sf))


@query
def ema_codebook_update(spark, sf):
    words = A.codewords(spark, sf)
    state = words.withColumns({"ema_size": F.lit(1.0), "ema_sum": F.col("centroid")})
    step = quantizer.ema_codebook_update(quantizer.residuals_per_level(A.vectors(spark, sf), words), state)
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return step.select(
        "level", "code", r6("ema_size"), r6(total, "centroid_sum"), r6(F.get("centroid", F.lit(0)), "centroid_0")
    )


@query
def train_codebooks(spark, sf):
    """Three epochs, the diversity terms from the second on, interrupted after the first: the log and the last codewords' sums."""
    folder, vectors = scratch_folder(spark, "training"), A.vectors(spark, sf).select("pid", "vector")
    start = training.start_state(A.codewords(spark, sf), 1.0)
    for epochs in (1, 3):
        training.train_codebooks(vectors, start, folder, epochs, diversity_start_epoch=1)
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    last = training.read_state(spark, folder, 2).agg(r6(F.sum(total), "centroid_sum"), r6(F.sum("ema_size"), "ema_size"))
    log = training.read_log(spark, folder).select("epoch", *(r6(term) for term in (*training.TERMS, "loss")))
    return log.crossJoin(F.broadcast(last))  # one row


@query
def quantization_loss(spark, sf):
    return quantizer.quantization_loss(A.encoded_vectors(spark, sf)).select("level", r6("mse"), r6("loss"))


@query
def utilization_loss(spark, sf):
    return quantizer.utilization_loss(_assigned(spark, sf), A.codewords(spark, sf)).select("level", r6("utilization"))


@query
def compactness_loss(spark, sf):
    return quantizer.compactness_loss(A.codewords(spark, sf)).select("level", r6("compactness"))


@query
def kl_usage(spark, sf):
    return quantizer.kl_usage(_assigned(spark, sf), A.codewords(spark, sf)).select("level", r6("kl_divergence"))


@query
def weighted_loss(spark, sf):
    rows = A.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.month("o_orderdate").alias("epoch"))
    losses = rows.agg(
        (F.avg("o_totalprice") / 1e5).alias("reconstruction"),
        (F.max("o_totalprice") / 1e6).alias("quantization"),
        F.count(F.lit(1)).cast("double").alias("utilization"),
        (F.min("o_totalprice") / 1e4).alias("compactness"),
        (F.count_distinct("o_custkey") / 1e3).alias("kl_divergence"),
    )
    plain = quantizer.weighted_loss(losses, quantizer.loss_weights(), diversity_start_epoch=6)
    kl = quantizer.weighted_loss(losses, quantizer.loss_weights(div_weight=0.5, use_kl_divergence=True), diversity_start_epoch=6)
    return plain.join(kl.withColumnRenamed("loss", "loss_kl"), ["run", "epoch"]).select("run", "epoch", r6("loss"), r6("loss_kl"))


@query
def reconstruction_mse(spark, sf):
    return quantizer.reconstruction_mse(A.encoded_vectors(spark, sf)).select(r6("mse"))


@query
def format_sid(spark, sf):
    return A.encoded_vectors(spark, sf).select("pid", sid_text(F.col("codes")).alias("sid"))


@query
def encode_places(spark, sf):
    coded = A.encoded_vectors(spark, sf)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return coded.select("pid", joined("codes"), r6(total, "vector_sum"), r6(F.get("vector", F.lit(0)), "vector_0"))


# ---- prompts ----


def _tokens(spark, sf, split: str | None = None):
    """Sequences with their tokens, of one split or of all; train sequences alone need no test rows."""
    rows = sequences.train_sequences(A.train_li(spark, sf)).withColumn("split", F.lit("train")) if split == "train" else A.sequences_li(spark, sf)
    return prompts.sequence_to_sids(rows, A.place_codebook(spark, sf))


@query
def sequence_to_sids(spark, sf):
    return _tokens(spark, sf).select("split", "uid", "seq_no", joined("tokens", " "), "target_token")


@query
def sequence_to_ids(spark, sf):
    return prompts.sequence_to_ids(A.sequences_li(spark, sf)).select("split", "uid", "seq_no", joined("tokens", " "), "target_token")


@query
def prompt_with_time(spark, sf):
    return prompts.prompt_with_time(_tokens(spark, sf))


@query
def prompt_no_time(spark, sf):
    return prompts.prompt_no_time(_tokens(spark, sf))


@query
def prompt_completion(spark, sf):
    return prompts.prompt_completion(A.dialogue_examples(spark, sf))


@query
def mask_prompt_labels(spark, sf):
    masked = prompts.mask_prompt_labels(prompts.prompt_completion(A.dialogue_examples(spark, sf)))
    return masked.select("conv_id", "turn", joined("input_ids"), joined("labels"))


def words_and_marks(text: str) -> tuple[list[int], list[int]]:
    """A tokenizer with offsets: runs of letters and digits, and every other character by itself."""
    found = [(m.group(), m.start()) for m in re.finditer(r"\w+|\W", text, re.ASCII)]
    return [int(hashlib.md5(word.encode()).hexdigest()[:7], 16) for word, _ in found], [at for _, at in found]


@query
def load_tokenized(spark, sf):
    """Instruction arrays to token ids and labels, cut at 64 tokens."""
    rows = dataset.load_tokenized(spark, _instruction_array(spark, sf), words_and_marks, max_length=64)
    return rows.select(joined("input_ids"), joined("labels"))


@query
def token_length_stats(spark, sf):
    stats = prompts.token_length_stats(prompts.token_lengths(A.table(spark, sf, "documents")))
    return stats.select("examples", "min_len", "max_len", r6("mean_len"), "median_len")


@query
def token_length_histogram(spark, sf):
    return prompts.token_length_histogram(prompts.token_lengths(A.table(spark, sf, "documents")))


def _completions(spark, sf, split: str | None = None):
    return prompts.prompt_completion(prompts.prompt_with_time(_tokens(spark, sf, split)))


@query
def extract_user_sids(spark, sf):
    found = prompts.extract_user_sids(_completions(spark, sf))
    return found.select("split", "uid", "seq_no", "user", F.array_join(F.array_sort("sids"), " ").alias("sids"))


@query
def collect_users_sids(spark, sf):
    return prompts.collect_users_sids(_completions(spark, sf, "train"))


@query
def filter_cold_prompts(spark, sf):
    """All test prompts against the train prompts of two datasets, the even and the odd users: both reasons to drop occur."""
    both = staged(_completions(spark, sf), "prompts")
    test = both.where("split = 'test'")
    kept = []
    for i, name in enumerate(("even", "odd")):
        train = both.where((F.col("split") == "train") & (F.col("uid") % 2 == i))
        kept.append(prompts.filter_cold_prompts(test, train, prompts.SEQUENCE_KEY).withColumn("train_dataset", F.lit(name)))
    return kept[0].unionByName(kept[1]).select("train_dataset", "uid", "seq_no", "completion")


@query
def variant_matrix(spark, sf):
    named = runs.parse_run_name(A.run_ids(spark, sf)).where("dataset_name is not null")
    models = named.groupBy(F.col("dataset_name").alias("dataset"), F.col("run_name").alias("model")).agg(
        F.max(F.col("run_name").isin(prompts.NOTIME_MODELS)).alias("has_notime")
    )
    return prompts.variant_matrix(models).withColumn("with_time", F.col("with_time").cast("int"))


# ---- predictions ----

PREDICTION_KEY = ["split", "uid", "seq_no"]


def _predicted(spark, sf):
    train, test = A.unwritten_split_li(spark, sf)
    return scoring.predict_next_place(sequences.generate_sequences(train, test), graph.forward_edges(train))


def _answers(spark, sf, predicted=None):
    """``gold`` and the ``answer`` text after the hint, with the answer blank where no successor is known."""
    sids = staged(A.place_codebook(spark, sf).select("pid", sid_text(F.col("codes")).alias("sid")), "sids")
    gold = sids.select(F.col("pid").alias("target"), F.col("sid").alias("gold"))
    guess = sids.select(F.col("pid").alias("predicted"), F.col("sid").alias("guess"))
    rows = (_predicted(spark, sf) if predicted is None else predicted).select(*PREDICTION_KEY, "target", "predicted")
    answer = F.coalesce(F.substr("guess", F.lit(len(scoring.SID_PREFIX) + 1)), F.lit(""))
    return rows.join(gold, "target").join(guess, "predicted", "left").select(*PREDICTION_KEY, "gold", answer.alias("answer"))


def _attempts(spark, sf):
    """Six attempts per prompt, most of them blank by digest; the sixth never counts."""
    tries = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt")
    rows = _answers(spark, sf).select("*", tries)
    blank = F.substring(digest("try", *(F.col(c) for c in (*PREDICTION_KEY, "attempt"))), 1, 1) < "a"
    # White space of several kinds, alone or around the answer.
    spaces = F.element_at(F.array(*map(F.lit, (" ", "\n", "\t \r\n", "\u00a0"))), (F.col("uid") % 4 + 1).cast("int"))
    text = F.when(blank & (F.col("attempt") < 5), spaces).otherwise(F.concat(spaces, "answer", spaces))
    return rows.select(*PREDICTION_KEY, "gold", "attempt", text.alias("text"))


def _results(spark, sf):
    return scoring.first_nonempty_attempt(_attempts(spark, sf), [*PREDICTION_KEY, "gold"])


@query
def batch_predict(spark, sf):
    return _predicted(spark, sf).select(*PREDICTION_KEY, "target", F.coalesce("predicted", F.lit(-1)).alias("predicted"))


@query
def first_nonempty_attempt(spark, sf):
    return _results(spark, sf)


@query
def top1_accuracy(spark, sf):
    return scoring.top1_accuracy(_results(spark, sf), ["split"]).select("split", "examples", r6("accuracy"))


@query
def plain_id_accuracy(spark, sf):
    """Tables of plain ids are scored with their own hint."""
    rows = _predicted(spark, sf).select(
        "split",
        F.concat(F.lit("<"), F.col("target").cast("string"), F.lit(">")).alias("gold"),
        F.concat(F.col("predicted").cast("string"), F.lit(">")).alias("result"),
    )
    return scoring.top1_accuracy(rows, ["split"], scoring.ID_PREFIX).select("split", "examples", r6("accuracy"))


def _split_metrics(spark, sf):
    # Validation rows spread over three runs, the others over four: the fourth run has a missing value.
    number = F.when(F.col("split") == "val", F.col("uid") % 3).otherwise(F.col("uid") % 4)
    return scoring.metrics_by_split(
        _results(spark, sf).withColumn("run_name", F.concat(F.lit("run-"), number.cast("string")))
    )


@query
def metrics_by_split(spark, sf):
    wide = _split_metrics(spark, sf)
    return wide.select("run_name", *(F.coalesce(F.round(f"{s}_acc", 6), F.lit(-1.0)).alias(f"{s}_acc") for s in scoring.SPLITS))


@query
def format_metrics(spark, sf):
    return scoring.format_metrics(_split_metrics(spark, sf))


@query
def cross_eval_matrix(spark, sf):
    """Successors learnt from even or odd users, scored on the test examples of even or odd users."""
    names = ["even", "odd"]
    train, test = A.split_li(spark, sf, numbers=True)
    group = F.when(F.col("uid") % 2 == 0, names[0]).otherwise(names[1])
    examples = sequences.test_examples(test).withColumn("test_dataset", group)
    sids = staged(A.place_codebook(spark, sf).select("pid", sid_text(F.col("codes")).alias("sid")), "sids")
    parts = []
    for i, name in enumerate(names):
        edges = graph.forward_edges(train.where(F.col("uid") % 2 == i))
        parts.append(scoring.predict_next_place(examples, edges).withColumn("train_dataset", F.lit(name)))
    rows = parts[0].unionByName(parts[1])
    gold = sids.select(F.col("pid").alias("target"), F.col("sid").alias("gold"))
    guess = sids.select(F.col("pid").alias("predicted"), F.substr("sid", F.lit(4)).alias("result"))
    scored = rows.join(gold, "target").join(guess, "predicted", "left")
    matrix = scoring.cross_eval_matrix(scored, names)
    return matrix.select("train_dataset", r6("even"), r6("odd"))


# Runs and the folders of their tables; the last one has been evaluated before.
EVALUATED = {"run-a": "times", "run-b": "times", "run-c": "ids", "run-d": "half", "run-old": "half"}


def _prompt_key(prompt: Column) -> Column:
    """The digest's 16 bytes, half of what its text takes in a shuffle."""
    return F.unhex(F.md5(prompt)).alias("key")


def _evaluation_folders(spark, sf, root: str):
    """Instruction arrays of the sequences in three folders, and ``key, answer``: what a predictor says to a prompt, by its digest.

    The arrays of all prompts are the largest part of what is on disk, so they are compressed.
    """
    train, test = A.unwritten_split_li(spark, sf)
    rows = staged(sequences.generate_sequences(train, test), "sequences")
    guessed = scoring.predict_next_place(rows, graph.forward_edges(train)).select(*PREDICTION_KEY, "target", "predicted")
    guessed = staged(guessed, "guessed")
    release(spark)
    timed = staged(prompts.prompt_with_time(prompts.sequence_to_sids(rows, A.place_codebook(spark, sf))), "timed")
    ids = prompts.prompt_no_time(prompts.sequence_to_ids(rows))
    few = timed.where("split = 'test' or (split = 'train' and uid % 2 = 0)")
    for folder, examples, kind, with_time in (("times", timed, "codebook", True), ("ids", ids, "id", False), ("half", few, "codebook", True)):
        for mode in prompts.MODES if examples is not few else ("train", "test"):
            part = examples.where(F.col("split") == mode)
            instructions.write_instruction_array(
                part, f"{root}/{folder}", mode, kind, with_time, order=["uid", "seq_no"], compression="gzip", written=True
            )
            release(spark)

    def said(examples, answers, hint):
        # The key is made before the join, which would shuffle whole prompts otherwise.
        key = _prompt_key(F.concat("prompt", F.lit(hint)))
        keyed = prompts.prompt_completion(examples).select(*PREDICTION_KEY, key)
        return keyed.join(answers, PREDICTION_KEY).select("key", "answer")

    plain = F.coalesce(F.concat(F.col("predicted").cast("string"), F.lit(">")), F.lit("")).alias("answer")
    both = said(timed, _answers(spark, sf, guessed).select(*PREDICTION_KEY, "answer"), scoring.SID_PREFIX).unionByName(
        said(ids, guessed.select(*PREDICTION_KEY, plain), scoring.ID_PREFIX)
    )
    # Prompts of the same text get the same answer.
    return both.groupBy("key").agg(F.min("answer").alias("answer"))


@query
def evaluate_runs(spark, sf):
    """Four runs over folders of both kinds, evaluated twice and appended once; a fifth is in the table already."""
    root, path, kept = (scratch_folder(spark, name) for name in ("evaluation", "evaluated", "said"))
    # What the folders and answers are made from is not needed beside them.
    with scratch(spark):
        _evaluation_folders(spark, sf, root).write.option("compression", "zstd").parquet(kept)
    release(spark)
    said = spark.read.schema("key binary, answer string").parquet(kept)

    def answer(asked):
        rows = asked.select(*evaluation.ASKED, _prompt_key(F.col("prompt"))).join(said, "key", "left")
        tries = rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(5))))
        blank = F.substring(digest("try", F.col("run_name"), F.lower(F.hex("key")), F.col("attempt")), 1, 1) < "a"
        text = F.when(blank & (F.col("attempt") < 5), "\t ").otherwise(F.concat(F.lit(" "), F.coalesce("answer", F.lit("")), F.lit("\n")))
        return tries.select(*evaluation.ASKED, "attempt", text.alias("text"))

    known = spark.createDataFrame([("run-old", 0.5, None, None, 0.25)], tables.METRIC_SCHEMA)
    tables.append_new_runs(spark, known, path)
    for _ in range(2):
        evaluation.evaluate_and_save(spark, {run: f"{root}/{folder}" for run, folder in EVALUATED.items()}, answer, path)
    found = tables.read_runs(spark, path)
    return found.select("run_name", *(F.coalesce(F.round(f"{s}_acc", 6), F.lit(-1.0)).alias(f"{s}_acc") for s in scoring.SPLITS))


@query
def prediction_log(spark, sf):
    path = scratch_folder(spark, "prediction-log")
    rows = _results(spark, sf).select("gold", F.concat(F.lit(scoring.SID_PREFIX), "result").alias("prediction"))
    tables.write_prediction_log(scoring.prediction_log(rows), path)
    back = tables.read_prediction_log(spark, path)
    return back.select(F.col("correct").cast("int").alias("correct"), "gold", "prediction")


@query
def perplexity(spark, sf):
    log = A.loss_log(spark, sf)
    known = log.withColumn("perplexity", F.when(F.col("epoch") % 2 == 0, F.lit(1.5)))
    return scoring.with_perplexity(known).select("run", "epoch", r6("perplexity"))


@query
def best_epoch_early_stop(spark, sf):
    out = scoring.best_epoch_early_stop(A.loss_log(spark, sf))
    return out.select(
        "run", "epoch", "eval_loss", F.col("improved").cast("int").alias("improved"), "best_epoch",
        F.col("stopped").cast("int").alias("stopped"),
    )


# ---- semantic-id reports ----


@query
def sid_collisions(spark, sf):
    """Codebooks of three and of two levels count as two models; the parts share the embeddings' codes."""
    codes = A.staged_codes(spark, sf)
    book = A.place_codebook(spark, sf, codes).withColumn("dataset", F.lit("parts"))
    vec = codes.withColumn("dataset", F.lit("embeddings"))
    both = book.unionByName(vec, allowMissingColumns=True)
    deep = both.withColumn("model", F.lit("three-levels"))
    flat = both.withColumns({"model": F.lit("two-levels"), "codes": F.slice("codes", 1, 2)})
    return sid_report.sid_collisions(deep.unionByName(flat))


@query
def enrich_codebook(spark, sf):
    vec = A.vectors(spark, sf)
    names = encoding.build_dictionary(vec, "catname")
    profile = encoding.apply_dictionary(vec.select("pid", "catname", F.col("region_id").alias("region")), {"catname": names})
    rich = sid_report.enrich_codebook(A.encoded_vectors(spark, sf), profile, names)
    return rich.select("pid", "cat_id", "catname", "region_id", "cat_and_region")


def _prefixed(spark, sf, prefix: Column):
    return sid_report.with_prefix(A.codebook(spark, sf), prefix)


@query
def prefix_frequency(spark, sf):
    book = A.codebook(spark, sf)
    first, second = (sid_report.prefix_frequency(sid_report.with_prefix(book, sid_report.level_prefix(k))) for k in (1, 2))
    return first.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))


@query
def combo_frequency(spark, sf):
    return sid_report.prefix_frequency(_prefixed(spark, sf, sid_report.combo_prefix()), sid_report.TOP_COMBOS)


def _top(spark, sf, prefix, item, top_prefixes):
    return sid_report.top_items_per_prefix(_prefixed(spark, sf, prefix), item, top_prefixes)


@query
def top_categories_per_prefix(spark, sf):
    return _top(spark, sf, sid_report.level_prefix(1), "catname", sid_report.TOP_PREFIXES_LEVEL)


@query
def top_cat_region_per_prefix(spark, sf):
    return _top(spark, sf, sid_report.level_prefix(1), "cat_and_region", sid_report.TOP_PREFIXES_LEVEL)


@query
def top_regions_per_prefix(spark, sf):
    book = A.codebook(spark, sf)
    tops = (sid_report.TOP_PREFIXES_FIRST_BY_REGION, sid_report.TOP_PREFIXES_LEVEL)
    first, second = (
        sid_report.top_items_per_prefix(sid_report.with_prefix(book, sid_report.level_prefix(k)), "region_id", top)
        for k, top in enumerate(tops, 1)
    )
    return first.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))


@query
def top_categories_per_combo(spark, sf):
    return _top(spark, sf, sid_report.combo_prefix(), "catname", sid_report.TOP_COMBOS)


@query
def top_regions_per_combo(spark, sf):
    return _top(spark, sf, sid_report.combo_prefix(), "region_id", sid_report.TOP_COMBOS)


# The reports on drawn prefixes: name, prefix, item, least count.
DRAWN = [
    ("level_1", lambda: sid_report.level_prefix(1), "catname", sid_report.MIN_COUNT_LEVEL),
    ("level_2", lambda: sid_report.level_prefix(2), "catname", sid_report.MIN_COUNT_LEVEL),
    ("combo_category", sid_report.combo_prefix, "catname", sid_report.MIN_COUNT_COMBO_CATEGORY),
    ("combo_region", sid_report.combo_prefix, "region_id", sid_report.MIN_COUNT_COMBO_REGION),
]


def _drawn(spark, sf, report):
    """``report(prefixed, selected, item)`` of each kind over the codebook of the parts, which is the largest."""
    book = A.enriched_place_codebook(spark, sf)
    parts = []
    for name, prefix, item, least in DRAWN:
        prefixed = sid_report.with_prefix(book, prefix())
        rows = report(prefixed, sid_report.sample_frequent_prefixes(prefixed, least), item)
        parts.append(rows.withColumn("report", F.lit(name)))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@query
def sample_frequent_prefixes(spark, sf):
    return _drawn(spark, sf, lambda prefixed, selected, item: selected)


@query
def aligned_prefix_matrix(spark, sf):
    def report(prefixed, selected, item):
        return sid_report.aligned_prefix_matrix(prefixed, selected, item).withColumn("item", F.col("item").cast("string"))

    return _drawn(spark, sf, report)


@query
def projection_subset(spark, sf):
    def report(prefixed, selected, item):
        rows = sid_report.projection_subset(prefixed, selected, item)
        return rows.select("pid", "prefix", F.col(item).cast("string").alias("item"))

    return _drawn(spark, sf, report)


@query
def project_2d(spark, sf):
    prefixed = sid_report.with_prefix(A.enriched_place_codebook(spark, sf), sid_report.level_prefix(1))
    selected = sid_report.sample_frequent_prefixes(prefixed, sid_report.MIN_COUNT_LEVEL)
    subset = sid_report.projection_subset(prefixed, selected, "catname")
    return sid_report.project_2d(subset).select("pid", "catname", r6("x"), r6("y"))


# ---- regions ----


@query
def decode_region(spark, sf):
    """Every region of the check-ins of both sources."""
    li = A.clean_li(spark, sf).select("region")
    ev = cleaning.with_region(A.checkins_ev(spark, sf)).select("region")
    return regions.decode_region(li.unionByName(ev).distinct())


def _combo_regions(spark, sf):
    top = _top(spark, sf, sid_report.combo_prefix(), "region_id", sid_report.TOP_COMBOS)
    cells = A.vectors(spark, sf).select(F.col("region_id"), "region").distinct()
    centers = regions.decode_region(cells).select(F.col("region_id").alias("region"), "center_lat", "center_lon")
    return top, centers


def _pairs(spark, sf):
    return regions.region_pair_distance(regions.combo_region_lists(*_combo_regions(spark, sf)))


def _stats(spark, sf):
    return regions.combo_distance_stats(_pairs(spark, sf))


@query
def region_pair_distance(spark, sf):
    return _pairs(spark, sf).select("combo", "region_1", "region_2", r6("km"))


@query
def combo_distance_stats(spark, sf):
    pair = [F.concat_ws("-", f"{p}.region_1", f"{p}.region_2").alias(p) for p in ("nearest", "farthest")]
    return _stats(spark, sf).select(
        "combo", "pairs", r6("mean_km"), r6("min_km"), r6("max_km"), r6("std_km"), *pair
    )


@query
def rank_combos_by_compactness(spark, sf):
    return regions.rank_combos_by_compactness(_stats(spark, sf)).select("combo", r6("mean_km"), "rank")


@query
def first_combo_of_region(spark, sf):
    top, centers = _combo_regions(spark, sf)
    pairs = regions.region_pair_distance(regions.combo_region_lists(top, centers))
    return regions.first_combo_of_region(top, regions.rank_combos_by_compactness(regions.combo_distance_stats(pairs)))


@query
def geo_extent(spark, sf):
    cells = A.clean_li(spark, sf).select("region").distinct()
    extent = regions.geo_extent(regions.decode_region(cells))
    return extent.select(*(r6(c) for c in extent.columns))


# ---- runs ----


@query
def parse_run_name(spark, sf):
    parsed = runs.parse_run_name(A.run_ids(spark, sf))
    return parsed.select(
        "order_key", "run_name", F.coalesce("dataset_name", F.lit("")).alias("dataset_name"), "div_weight", "commitment_weight",
        "lr", "quant_weight", "recon_weight", F.col("use_kl_divergence").cast("int").alias("use_kl_divergence"),
        F.col("error").isNotNull().cast("int").alias("has_error"),
    )


@query
def filter_runs_by_keywords(spark, sf):
    ids = A.run_ids(spark, sf)
    quant = runs.filter_runs_by_keywords(ids, runs.QUANTISER_KEYWORDS).withColumn("preset", F.lit("quantiser"))
    text = runs.filter_runs_by_keywords(ids, runs.LANGUAGE_MODEL_KEYWORDS).withColumn("preset", F.lit("language"))
    nyc = runs.filter_runs_by_keywords(ids, ["NYC"]).withColumn("preset", F.lit("nyc"))
    return quant.unionByName(text).unionByName(nyc).select("preset", "order_key", "run_id")


@query
def codebook_size_for_dataset(spark, sf):
    named = runs.parse_run_name(A.run_ids(spark, sf)).where("dataset_name is not null")
    return named.groupBy("dataset_name", runs.codebook_size_for_dataset(F.col("dataset_name")).alias("codewords")).agg(
        F.count(F.lit(1)).alias("runs")
    )
