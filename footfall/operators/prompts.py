"""Sequences rendered as instruction and prompt tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.text import id_text, sid_text

# Fixed texts and patterns.
INSTRUCTION_WITH_TIME = "Here is a record of a user's POI accesses, your task is based on the history to predict the POI that the user is likely to access at the specified time."
INSTRUCTION_NO_TIME = "Here is a record of a user's POI accesses, your task is based on the history to predict the next POI that the user is likely to access."
SID_PATTERN = r"(?:<\w+>)+"
USER_PATTERN = r"user_\d+"
MODES = ["train", "val", "test", "test_all"]

IGNORED_LABEL = -100  # fixed value: label of a token that is not learned
SEQUENCE_KEY = ["split", "uid", "seq_no"]


# Places and different semantic ids up to which a codebook is sent to every task: 12 bytes for a place, about 100 for a semantic id.
SHIPPED_PLACES = 2_000_000
SHIPPED_SIDS = 250_000


def sequence_to_sids(sequences: DataFrame, codebook: DataFrame) -> DataFrame:
    """Adds ``tokens`` and ``target_token``: semantic ids in visit order. A place without codes is an error.

    A codebook of up to ``SHIPPED_PLACES`` places with up to ``SHIPPED_SIDS`` different ids is sent to the tasks, which look its ids up
    in place, a batch of lists at a time: nothing is shuffled. Every id is sent once, and its number for each place. A larger one is joined.
    """
    sids = codebook.select("pid", sid_text(F.col("codes")).alias("sid"))
    held = sids.limit(SHIPPED_PLACES + 1).toArrow()
    if held.num_rows > SHIPPED_PLACES:
        return _joined_sids(sequences, sids)
    coded = held["sid"].combine_chunks().dictionary_encode()
    if len(coded.dictionary) > SHIPPED_SIDS:
        return _joined_sids(sequences, sids)
    pids, numbers, texts = held["pid"].combine_chunks(), coded.indices, coded.dictionary
    schema = T.StructType([*sequences.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("target_token", T.StringType())])

    def sids_of(places: pa.Array) -> pa.Array:
        at = pc.index_in(places, value_set=pids.cast(places.type))
        if at.null_count:
            raise ValueError(f"no codes for place {places.filter(at.is_null())[0]}")
        return texts.take(numbers.take(at))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["pids"]
            lengths = pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))), pa.int32())
            tokens = pa.ListArray.from_arrays(lengths, sids_of(lists.flatten()))
            columns = {name: batch[name] for name in batch.schema.names}
            yield pa.RecordBatch.from_pydict({**columns, "tokens": tokens, "target_token": sids_of(batch["target"])})

    return sequences.mapInArrow(look_up, schema)


def _joined_sids(sequences: DataFrame, sids: DataFrame) -> DataFrame:
    """The same by a join of the places of each user, every place once.

    Sequences hold at most a few dozen places and are cut from a bounded number of a user's visits, so the places of a user are few.
    Where the sequences come from rows that lie by user, they are not moved again.
    """
    with_target = F.concat("pids", F.array("target"))
    places = sequences.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list(with_target))).alias("_pids"))
    missing = F.raise_error(F.concat(F.lit("no codes for place "), F.coalesce(F.col("pid").cast("string"), F.lit("null"))))
    named = places.select("uid", F.explode("_pids").alias("pid")).join(sids, "pid", "left").withColumn("sid", F.coalesce("sid", missing))
    # A list of pairs is wider than the two lists of their parts, which one aggregation collects in one order.
    known = named.groupBy("uid").agg(F.map_from_arrays(F.collect_list("pid"), F.collect_list("sid")).alias("_sids"))
    tokens = F.transform("pids", lambda pid: F.element_at("_sids", pid)).alias("tokens")
    # Without a user there is one list of places at most, and no key to join by.
    nobody = sequences.where("uid is null").crossJoin(known.where("uid is null").select("_sids"))
    joined = sequences.join(known, "uid").unionByName(nobody)
    return joined.select(*sequences.columns, tokens, F.element_at("_sids", F.col("target")).alias("target_token"))


def sequence_to_ids(sequences: DataFrame) -> DataFrame:
    """The same with plain ``<pid>`` tokens."""
    return sequences.withColumns({"tokens": F.transform("pids", id_text), "target_token": id_text(F.col("target"))})


def prompt_with_time(tokens: DataFrame) -> DataFrame:
    """``instruction, input, output`` for sequences with times; an empty time list joins the tokens by blanks."""
    uid = F.col("uid").cast("string")
    timed = F.concat(
        F.array_join(F.zip_with("tokens", "times", lambda token, time: F.concat(token, F.lit(" at "), time)), ", "), F.lit(".")
    )
    visited = F.when(F.size("times") > 0, timed).otherwise(F.array_join("tokens", " "))
    text = F.concat(
        F.lit("User_"), uid, F.lit(" visited: "), visited, F.lit(" When "), F.col("target_time"),
        F.lit(" user_"), uid, F.lit(" is likely to visit:"),
    )
    return _instructions(tokens, INSTRUCTION_WITH_TIME, text)


def prompt_no_time(tokens: DataFrame) -> DataFrame:
    uid = F.col("uid").cast("string")
    text = F.concat(
        F.lit("The user_"), uid, F.lit(" visited: "), F.array_join("tokens", ", "),
        F.lit(", and in the next time user_"), uid, F.lit(" is likely to visit:"),
    )
    return _instructions(tokens, INSTRUCTION_NO_TIME, text)


def _instructions(tokens: DataFrame, instruction: str, text: Column) -> DataFrame:
    return tokens.select(
        *SEQUENCE_KEY,
        F.lit(instruction).alias("instruction"),
        text.alias("input"),
        F.col("target_token").alias("output"),
    )


def prompt_completion(instructions: DataFrame) -> DataFrame:
    """Replaces the three instruction columns by ``prompt, completion``."""
    others = [c for c in instructions.columns if c not in ("instruction", "input", "output")]
    prompt = F.concat("instruction", F.lit("\n"), "input", F.lit(" "))
    return instructions.select(*others, prompt.alias("prompt"), F.col("output").alias("completion"))


def word_tokens(text: Column) -> Column:
    """Whitespace tokens: the built-in stand-in for a subword tokenizer, which is the caller's."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def word_id(token: Column) -> Column:
    """A stable token id below 2**28."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int")


def mask_prompt_labels(examples: DataFrame, max_length: int = 2048, eos: str = "</s>") -> DataFrame:
    """Adds ``input_ids, labels``: a token that starts inside the prompt gets label -100.

    Tokens that start before the prompt's end are as many as the prompt alone has, because a token is a run of
    non-blanks: no character offsets are needed. The text ends in ``eos``; both lists are cut at ``max_length``.
    """
    tokens = word_tokens(F.concat("prompt", "completion", F.lit(eos)))
    inside = F.regexp_count("prompt", F.lit(r"\S+"))
    ids = F.slice(F.transform(tokens, word_id), 1, max_length)
    return examples.withColumns({"input_ids": ids, "_inside": inside}).withColumn(
        "labels",
        F.transform("input_ids", lambda t, i: F.when(i < F.col("_inside"), F.lit(IGNORED_LABEL)).otherwise(t)),
    ).drop("_inside")


def mask_prompt_labels_by(
    examples: DataFrame, tokenize: Callable[[str], tuple[list[int], list[int]]], max_length: int = 2048, eos: str = "</s>"
) -> DataFrame:
    """``input_ids, labels`` with a caller's tokenizer: ``tokenize(text)`` gives token ids and the places where they start.

    A token that starts before the prompt's end gets label -100, also one that reaches into the completion. The other columns stay.
    """
    ignored = IGNORED_LABEL
    kept = examples.schema.fields
    lists = T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept, T.StructField("input_ids", lists), T.StructField("labels", lists)])
    names = [f.name for f in kept]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for prompt, completion in zip(batch["prompt"].to_pylist(), batch["completion"].to_pylist(), strict=True):
                found, at = tokenize(prompt + completion + eos)
                ids.append(found[:max_length])
                starts += at[:max_length]
                ends.append(len(prompt))
            lengths = np.array([len(x) for x in ids], np.int64)
            offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            tokens = np.array([x for row in ids for x in row], np.int32)
            masked = np.where(np.array(starts, np.int64) < np.repeat(np.array(ends, np.int64), lengths), ignored, tokens).astype(np.int32)
            columns = [*(batch[name] for name in names), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (tokens, masked))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "input_ids", "labels"])

    return examples.mapInArrow(tokenise, schema)


def token_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """``length, n``: how many texts have each token count. The later statistics all come from this small table."""
    return df.groupBy(F.regexp_count(text, F.lit(r"\S+")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def token_length_stats(lengths: DataFrame) -> DataFrame:
    """One row: min, max, mean and upper median (element ``n // 2`` of the sorted lengths)."""
    # One row per distinct length: the longest text bounds this table, not the number of texts.
    upto = W.orderBy("length").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_rows = W.orderBy("length").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = lengths.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(all_rows)})
    return ranked.agg(
        F.sum("n").alias("examples"),
        F.min("length").alias("min_len"),
        F.max("length").alias("max_len"),
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean_len"),
        F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("length"))).alias("median_len"),
    )


def token_length_histogram(lengths: DataFrame, width: int = 100) -> DataFrame:
    bucket = (F.floor(F.col("length") / width) * width).cast("int").alias("bucket")
    return lengths.groupBy(bucket).agg(F.sum("n").alias("examples"))


def _all_sids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + SID_PATTERN), F.lit(0))


def extract_user_sids(prompts: DataFrame) -> DataFrame:
    """Adds ``user`` (first mention in the prompt, null where there is none) and ``sids`` (distinct, prompt and completion together)."""
    prompt, completion = F.lower("prompt"), F.lower("completion")
    return prompts.withColumns(
        {
            "user": F.nullif(F.regexp_extract(prompt, USER_PATTERN, 0), F.lit("")),
            "sids": F.array_distinct(F.concat(_all_sids(prompt), _all_sids(completion))),
        }
    )


def _mentions(prompts: DataFrame, by: list[str]) -> DataFrame:
    """``*by, kind, value``: every user and semantic id that a prompt mentions."""
    return extract_user_sids(prompts).select(
        *by,
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("user").alias("kind"), F.col("user").alias("value"))),
                F.transform("sids", lambda s: F.struct(F.lit("sid").alias("kind"), s.alias("value"))),
            )
        ).alias("e"),
    ).select(*by, "e.*")


def collect_users_sids(prompts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``kind, value``: the distinct users and the distinct semantic ids of a table of prompts, or of each table named by ``by``."""
    return _mentions(prompts, list(by)).where("value is not null").distinct()


def filter_cold_prompts(test: DataFrame, train: DataFrame, key: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Test prompts whose user and semantic ids all occur in train. ``key`` identifies a prompt.

    With ``by``, columns of both tables, many data sets are filtered at once, each by its own train prompts.
    A prompt that names no user is cold.

    Each mention is an item; an item train lacks marks its prompt, and marked prompts are anti-joined away.
    """
    own = [*by, "kind", "value"]
    items = _mentions(test, list(dict.fromkeys([*key, *by])))
    # Reduce to distinct items first: the join then meets every item once, however often it is mentioned.
    unseen = items.select(*own).distinct().join(collect_users_sids(train, by), own, "left_anti")
    cold = items.join(unseen, own, "left_semi").select(*key).distinct()
    named = test.where(F.regexp_extract(F.lower("prompt"), USER_PATTERN, 0) != "")
    return named.join(cold, key, "left_anti")


# The models that also have tables without times.
NOTIME_MODELS = [
    "rqvae-nyc-div0.25-commit0.5-lr5e-5",
    "rqvae-tky-div0.25-commit0.25-lr5e-5",
    "Nrqvae-NYC-div0.25-commit0.25-lr1e-3",
    "Nrqvae-TKY-div0.25-commit0.25-lr1e-3",
    "Nrqvae-NYC_Exploration-div0.25-commit0.25-lr1e-3",
    "Nrqvae-TKY_Exploration-div0.25-commit0.25-lr1e-3",
]


def variant_matrix(models: DataFrame) -> DataFrame:
    """``dataset, model, kind, mode, with_time, file_name``: the prompt tables that exist.

    ``models`` is ``dataset, model, has_notime``. Every dataset has one set of plain-id tables, every model one of
    code tables, and a model flagged ``has_notime`` one more without times.
    """
    with_time = F.struct(F.lit("codebook").alias("kind"), F.lit(True).alias("with_time"))
    without = F.struct(F.lit("codebook").alias("kind"), F.lit(False).alias("with_time"))
    coded = models.distinct().select(
        "dataset",
        "model",
        F.explode(F.when(F.col("has_notime"), F.array(with_time, without)).otherwise(F.array(with_time))).alias("v"),
    ).select("dataset", "model", "v.*")
    plain = models.select("dataset").distinct().select(
        "dataset", F.lit("").alias("model"), F.lit("id").alias("kind"), F.lit(True).alias("with_time")
    )
    modes = F.explode(F.array(*(F.lit(m) for m in MODES))).alias("mode")
    suffix = F.when(F.col("with_time"), "").otherwise("_notime")
    return coded.unionByName(plain).select("*", modes).withColumn(
        "file_name", F.concat("mode", F.lit("_"), "kind", suffix, F.lit(".json"))
    )
