"""Small helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "ensure_checkpoint_dir", "free_name", "sized_join", "small_batches", "WORDS"]

#: pattern between words in the sense of the contracts: ASCII space and \t \n \v \f \r
WORDS = r"[\x20\x09-\x0D]+"

#: tables of at most so many rows may be broadcast once they have been counted
BROADCAST_ROWS = 100_000

#: whole texts that go to a Python worker at a time; Spark's own number of rows is meant for short ones
BATCH_TEXTS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let at most :data:`BATCH_TEXTS` rows go to Python workers at a time, for the rest of the session.

    A batch of texts lies in the executor's direct memory, in its queue of rows
    and, as strings and as arrays, in the worker. A lower number that is set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_TEXTS:
        spark.conf.set(name, str(BATCH_TEXTS))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join a checkpointed ``small`` (one row per key) to ``big`` whatever its size and whatever the key counts.

    ``small`` is counted: up to ``most`` rows it is broadcast. Beyond that every
    key is cut into ``salts`` parts on both sides, so that a hot key of ``big``
    is spread over as many tasks.
    """
    if small.count() <= most:
        return big.join(F.broadcast(small), on, how)
    salt = free_name(big, "_salt")
    cut = big.withColumn(salt, F.pmod(F.xxhash64(*[c for c in big.columns]), F.lit(salts)).cast("int"))
    parts = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cut.join(parts, [*on, salt], how).drop(salt)
