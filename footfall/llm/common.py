"""Helpers shared by the operators: Arrow batches and written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from footfall.session import scratch_folder

# The six ASCII white-space characters, at which ``bytes.split`` cuts words.
WHITE = b" \t\n\x0b\x0c\r"
# Rows of one Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS = 256


def map_batches(
    df: DataFrame,
    columns: list[str],
    fn: Callable[[Iterator[list[list]]], Iterator[list[list]]],
    schema: str,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """Runs ``fn`` over Arrow batches of ``columns``, given and returned as lists of columns.

    ``fn`` gets an iterator, so it can load a model once for each task; nothing is shuffled and one batch is held
    at a time.
    """
    # Only a bound on the batch's size, which no result depends on.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ([column.to_pylist() for column in batch.columns] for batch in batches)
        for out in fn(lists):
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=field.type) for values, field in zip(out, arrow, strict=True)], schema=arrow
            )

    return df.select(*columns).mapInArrow(run, schema)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each longer by underscores as long as ``df`` has a column of it in any case."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def written_to(df: DataFrame, name: str, rows_per_file: int = 0) -> tuple[DataFrame, str]:
    """``written``, and the folder."""
    path = scratch_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Writes ``df`` to a fresh shared folder and reads it back: computed once, lineage cut, no local copy to lose.

    With ``rows_per_file`` no file holds more rows, for tables of few large rows: a file is not split among tasks.
    """
    return written_to(df, name, rows_per_file)[0]


def remove_written(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``written_to``, through the file system that it lies in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
