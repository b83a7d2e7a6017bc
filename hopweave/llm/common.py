"""What the operators share: reading a table, the shared folder for cut lineage, the definition of a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.sources.shared import materialize, shared_dir  # noqa: F401

#: A word is a maximal run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters, for translate().
SPACES = " \t\n\x0b\x0c\r"

#: Rows whose texts a Python worker holds as objects at once.
SLICE = 512
#: Bytes of a batch that goes to a Python worker, where the session still has Spark's own bound: texts count by bytes, not rows.
BATCH_BYTES, _BOUND, _DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(side: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast a side of known row count only while it is small; otherwise Spark chooses another join."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function that make() builds once in each task and that gets at most SLICE rows at a time, from
    batches of about BATCH_BYTES; a bound that the session sets itself stays."""
    conf = df.sparkSession.conf
    if conf.get(_BOUND, None) == _DEFAULT:
        conf.set(_BOUND, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield step(batch.slice(at, SLICE))

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def text_or_empty(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones; other columns, whatever their names, don't take part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
