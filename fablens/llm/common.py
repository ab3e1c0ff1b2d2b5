"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Most rows of an Arrow batch in a step that is written at once: Spark's own 10,000 may hold gigabytes of long texts.
BATCH_ROWS = 500
#: A word: ASCII digits and letters (after lower-casing) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def words_sql(text: str) -> str:
    """``words`` for DuckDB."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one local process (tests) is a temporary folder taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="fablens-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_ROWS`` rows at most for what runs inside; the session's own setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this library's own on whichever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, wait: float = 0.0) -> None:
    """Let Spark delete the shuffle files of results that were written: it does when the driver collects its garbage, which
    in a job of few driver objects may be never. wait: seconds for Python's bridge to let go of the JVM's objects, which it
    does in a thread of its own that looks once a second; without them some shuffles stay until the next release."""
    if wait:
        spark.range(1).count()  # the scheduler and listeners hold on to the last job until there is another
    for _ in range(2 if wait else 1):
        gc.collect()
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers may not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="fablens-"), "fablens_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
