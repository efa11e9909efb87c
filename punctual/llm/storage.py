"""Tables, written intermediate tables and splitting of hot keys, shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.session import application_folder, materialise, scratch

#: Bytes of one Arrow batch on its way to Python; very long texts make batches of their own.
BATCH_BYTES = 1 << 24
#: Copies of the small side of a join whose large side may have a hot key.
SALTS = 16


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as --py-files would; bound Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if app in _shipped or not os.path.isdir(os.path.join(root, "punctual")):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "punctual")):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, root))
    # Only the driver reads this file: Spark serves it to the executors.
    folder = tempfile.mkdtemp(prefix="punctual-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"punctual-{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def _release() -> None:
    """What this process has remembered and freed goes back to the machine: Spark uses it again for other stages."""
    from punctual.llm import tokens, words

    tokens.forget()
    words.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # Only the GNU library keeps freed memory and can give it back.


def freeing(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches, which frees memory when its task ends."""

    def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return freed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that no later step recomputes it."""
    return materialise(df, f"llm-{name}")


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written and read back; the tables that it wrote on the way are deleted."""
    path = new_folder(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(work: DataFrame, n: int, *by: str) -> DataFrame:
    """A short list of `n` long pieces of work, dealt over as many tasks as it fills, four waves at most.

    Without a number of its own the list would be joined into one partition, small as its rows are.
    """
    most = 4 * int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(max(1, min(n, most)), *by)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the cluster's shared one, for files that are not tables."""
    return f"{application_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def salted_left_join(large: DataFrame, small: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Left join of `large` with a much smaller table that has each key once.

    Rows of a hot key are dealt over SALTS partitions by `spread_by`; the small side is copied as often.
    It still grows with the corpus, so it is merged and never broadcast.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("_salt", salt).join(copies.hint("merge"), [*keys, "_salt"], "left").drop("_salt")
