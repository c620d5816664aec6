"""Text rules and task helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes an Arrow batch may hold, the same for every operator; a row that is longer is a batch of its own.
BATCH_ROWS, BATCH_BYTES = "20000", str(2 << 20)


def text_of(column: str = "text") -> Column:
    """The text; a null one is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: str = "text") -> Column:
    """The bytes of the text; a null one is empty."""
    return text_of(column).cast("binary")


def size_bytes(column: str = "text") -> Column:
    return F.octet_length(text_of(column)).cast("long")


def bounded_batches(spark: SparkSession) -> None:
    """Sets the bounds of Arrow batches. They hold for whatever runs next, texts and numbers alike, as the bytes are bounded too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def by_batch(frame: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over Arrow batches of bounded size, one task per partition of ``frame``."""
    bounded_batches(frame.sparkSession)
    owner = function.__module__

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        for part in parts:
            yield from function(part)

    return frame.mapInArrow(run, schema)


_FORGET: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    """Tells how a module's worker memory, which outlasts a task, is emptied."""
    _FORGET[module] = forget


def only(module: str) -> None:
    """Empties what other modules remember. Spark uses a worker for the tasks of one operator after the other, and their memories
    would add up."""
    for name, forget in _FORGET.items():
        if name != module:
            forget()
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """Answers of ``answer`` by key, forgotten together once there are ``most``; long keys are not kept."""

    def __init__(self, answer: Callable, most: int = 400_000, longest: int = 48):
        super().__init__()
        self.answer, self.most, self.longest = answer, most, longest

    def __missing__(self, key):
        value = self.answer(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def range_of(column: Column, bounds: list) -> Column:
    """Number of sorted ``bounds`` below a value, by bisection; null counts as the smallest."""
    points = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) < column, at + step).otherwise(at))


def cuts(rows: DataFrame, column: str, number: int) -> list:
    """Values that cut the rows into about ``number`` ranges of equal size: as many numbers as that, whatever the rows."""
    shares = [k / number for k in range(1, number)]
    found = rows.agg(F.percentile_approx(column, shares, F.lit(4 * number)).alias("c")).first()["c"] if shares else None
    return sorted(set(found or []))
