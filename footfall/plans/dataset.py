"""From raw check-ins to all tables of a dataset, as lazy DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from footfall.functions.seeded import DEFAULT_SEED
from footfall.operators import cleaning, encoding, features, graph, profiles, prompts, sequences, splits
from footfall.session import scratch, staged
from footfall.sources import instructions


# Names of the scratch tables that only lead to the encoded rows.
_PASSING = ("clean-", "kept-", "distinct-")


@dataclass(frozen=True)
class Dataset:
    visits: DataFrame
    dictionaries: dict[str, DataFrame]
    profile: DataFrame
    train: DataFrame
    test: DataFrame
    sequences: DataFrame
    metadata: DataFrame
    features: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        named = {f"dictionary_{name}": table for name, table in self.dictionaries.items()}
        return {
            "visits": self.visits,
            "profile": self.profile,
            "train": self.train,
            "test": self.test,
            "sequences": self.sequences,
            "metadata": self.metadata,
            "features": self.features,
            **named,
        }


def process_dataset(
    raw: DataFrame,
    poi_min_freq: int = 10,
    user_min_freq: int = 10,
    window_size: int = 50,
    step_size: int = 10,
    mask_prob: float = 0.1,
    with_recency: bool = False,
    seed: int = DEFAULT_SEED,
) -> Dataset:
    """Everything up to the feature vectors. ``with_recency`` selects the recency-weighted variant."""
    clean = cleaning.clean_checkins(raw, with_recency)
    return process_clean(clean, poi_min_freq, user_min_freq, window_size, step_size, mask_prob, with_recency, seed)


def process_clean(
    clean: DataFrame,
    poi_min_freq: int = 10,
    user_min_freq: int = 10,
    window_size: int = 50,
    step_size: int = 10,
    mask_prob: float = 0.1,
    with_recency: bool = False,
    seed: int = DEFAULT_SEED,
) -> Dataset:
    """The same from clean check-ins.

    Clean rows, filtered rows, encoded rows and the split are written once each to the shared scratch folder: every one of
    them is read several times, and later scans prune columns instead of cleaning the raw files again. Of these, the clean and the
    filtered rows are deleted as soon as the encoded rows are written.
    """
    with scratch(clean.sparkSession) as made:
        kept = staged(cleaning.frequency_filter(staged(clean, "clean"), poi_min_freq, user_min_freq), "kept")
        dictionaries = {
            name: staged(table, f"dictionary-{name}") for name, table in encoding.build_dictionaries(kept, seed).items()
        }
        visits = staged(encoding.apply_dictionary(kept, dictionaries), "visits")
        made[:] = [path for path in made if os.path.basename(path).startswith(_PASSING)]

    if with_recency:
        who = profiles.visitor_recency(visits)
    else:
        who = profiles.first_visits(visits, "uid")
    profile = graph.attach_neighbors(
        visits, graph.neighbors(visits), graph.forward_neighbors(visits), with_recency=with_recency
    )

    train, test = (staged(part, name) for part, name in zip(splits.split_data(visits), ("train", "test"), strict=True))
    examples = sequences.generate_sequences(train, test, window_size, step_size, mask_prob, seed)

    metadata = features.metadata_of_dictionaries(dictionaries)
    long_features = features.assemble_features(
        profiles.place_heads(visits), profiles.first_visits(visits, "time"), who, metadata
    )
    return Dataset(visits, dictionaries, profile, train, test, examples, metadata, long_features)


def load_tokenized(
    spark: SparkSession,
    path: str,
    tokenize: Callable[[str], tuple[list[int], list[int]]],
    max_examples: int | None = None,
    max_length: int = 2048,
    eos: str = "</s>",
) -> DataFrame:
    """``input_ids, labels`` of the instruction records in a file, the first ``max_examples`` of them or all."""
    records = instructions.read_instructions(spark, path, max_examples)
    masked = prompts.mask_prompt_labels_by(prompts.prompt_completion(records), tokenize, max_length, eos)
    return masked.select("input_ids", "labels")
