"""Text forms: list literals, semantic ids, time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
MAX_LEVELS = 26  # one letter per level


def parse_list(value: Column, element: str = "int") -> Column:
    """A list literal as an array; null, ``[]`` and anything unparseable give the empty array."""
    parsed = F.from_json(value, f"array<{element}>", {"allowSingleQuotes": "true"})
    empty = F.array().cast(f"array<{element}>")
    # from_json turns an unparseable element into a null inside the list, where a literal parser refuses the whole text.
    sound = parsed.isNotNull() & ~F.exists(F.coalesce(parsed, empty), lambda x: x.isNull())
    return F.when(sound, parsed).otherwise(empty)


def sid_text(codes: Column) -> Column:
    """``[4, 17, 25]`` as ``<a_4><b_17><c_25>``."""
    tokens = F.transform(
        codes,
        lambda code, level: F.concat(
            F.lit("<"), F.char(level + 97), F.lit("_"), code.cast("string"), F.lit(">")
        ),
    )
    return F.when(F.size(codes) <= MAX_LEVELS, F.array_join(tokens, "")).otherwise(
        F.raise_error(F.lit("a semantic id has at most 26 levels"))
    )


def id_text(pid: Column) -> Column:
    """A place id as the token ``<pid>``."""
    return F.concat(F.lit("<"), pid.cast("string"), F.lit(">"))


def format_times(times: Column) -> Column:
    return F.transform(times, lambda t: F.date_format(t, TIME_FORMAT))
