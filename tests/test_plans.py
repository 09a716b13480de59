"""What the physical plans must look like, whatever the size of the data."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from footfall.operators import cleaning, graph, profiles, prompts, quantizer, sequences, splits
from footfall.plans import adapters, catalog
from footfall.session import scratch


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sf_dir(testdata):
    return f"{testdata}/sf0.001"


@pytest.fixture(scope="module")
def visits(spark, sf_dir):
    return adapters.staged_visits_li(spark, sf_dir)


def test_scans_read_only_what_they_need(visits):
    plan = plan_of(graph.forward_neighbors(visits))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("time" not in s and "region" not in s and "catname" not in s for s in schemas)


def test_split_folders_prune(spark, sf_dir):
    train, _ = adapters.split_li(spark, sf_dir)
    plan = plan_of(sequences.cap_history(train))
    assert re.search(r"PartitionFilters: \[[^\]]*part[^\]]*= train", plan)


def test_predictions_write_no_split(spark, sf_dir):
    with scratch(spark) as made:
        assert catalog.CATALOG["top1_accuracy"](spark, sf_dir).count() > 0
        assert made and not any("/split-" in path for path in made)


def test_no_exchange_to_one_partition_on_visits(visits):
    """Only the split's per-bucket counts may meet in one task, never the visits themselves."""
    for df in (
        graph.neighbors(visits),
        graph.user_place_steps(visits),
        profiles.place_profile(visits),
        cleaning.frequency_filter(visits, 2, 2),
        sequences.train_sequences(visits),
        sequences.test_examples(visits),
    ):
        assert "Exchange SinglePartition" not in plan_of(df)


def test_split_sorts_counts_only(visits):
    plan = plan_of(splits.split_point(visits))
    for part in plan.split("Exchange SinglePartition")[1:]:
        below = part[: part.find("FileScan")]
        # Below every single-partition exchange there is an aggregate, or the join with the one-row spot.
        assert "HashAggregate" in below or "BroadcastHashJoin" in below


def test_histories_are_limited_before_the_shuffle(visits):
    for df in (sequences.train_sequences(visits), sequences.val_examples(visits)):
        plan = plan_of(df)
        assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_encoding_has_no_shuffle(spark, sf_dir):
    coded = quantizer.encode_places(adapters.vectors(spark, sf_dir), adapters.codewords(spark, sf_dir))
    plan = plan_of(coded)
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_cleaning_is_one_narrow_stage(spark, sf_dir):
    raw = adapters.raw_checkins_ev(spark, sf_dir)
    plan = plan_of(cleaning.clean_checkins(raw))
    assert "Exchange" not in plan and "Python" not in plan


def test_token_lengths_move_counts_not_texts(spark, sf_dir):
    plan = plan_of(prompts.token_lengths(adapters.table(spark, sf_dir, "documents")))
    assert re.search(r"ReadSchema: struct<text:string>", plan)
    assert "partial_count" in plan[plan.index("Exchange") :]


def test_no_python_rows_anywhere(spark, sf_dir):
    visits = adapters.encoded_li(spark, sf_dir)
    assert "BatchEvalPython" not in plan_of(visits)
    assert visits.where(F.col("uid").isNull()).isEmpty()


def test_residuals_of_all_levels_take_one_python_pass(spark, sf_dir):
    rows = quantizer.residuals_per_level(adapters.vectors(spark, sf_dir), adapters.codewords(spark, sf_dir))
    plan = plan_of(rows.join(adapters.codewords(spark, sf_dir).select("level", "code"), ["level", "code"], "left"))
    assert plan.count("ArrowEvalPython") == 1


def test_neighbours_join_the_profile_in_one_aggregation(visits):
    plain, full = profiles.place_profile(visits), graph.attach_neighbors(visits, graph.neighbors(visits), graph.forward_neighbors(visits))
    lists = graph.neighbors(visits), graph.forward_neighbors(visits)
    added = plan_of(full).count("Exchange") - plan_of(plain).count("Exchange")
    # Beyond the two neighbour tables only their way into the one aggregation, which the profile has anyway.
    assert added <= sum(plan_of(x).count("Exchange") for x in lists)
