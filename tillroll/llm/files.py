"""Binary files that tasks write to and read from the shared folder, local or in an object store.

A task writes each file under a name of its own attempt and returns a row that describes it. Only files
whose rows Spark has committed to the manifest table are ever read, so attempts that were lost or ran
twice leave nothing but unread files.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.sources.scratch import scratch_root

# Bounds of the sample a dictionary is trained on: documents, bytes of a document, bytes of the dictionary.
SAMPLE_DOCS = 256
SAMPLE_DOC_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of an unused folder that all executors reach."""
    return f"{scratch_root(spark)}/{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


def create(folder: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file in ``folder``: its address and an open stream."""
    address = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = pyarrow.fs.FileSystem.from_uri(address)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return address, store.open_output_stream(path, compression=None)


def open_file(address: str) -> pa.NativeFile:
    store, path = pyarrow.fs.FileSystem.from_uri(address)
    return store.open_input_file(path)


def sample(df: DataFrame, key: Column, value: Column) -> list[bytes]:
    """At most SAMPLE_DOCS values of at most SAMPLE_DOC_BYTES, the same ones in every run.

    The least hashes are found first, without the values; then the rows that have them are fetched.
    """
    small = df.select(F.xxhash64(key, value).alias("order"), value.cast("binary").alias("value")).filter(
        (F.octet_length("value") > 0) & (F.octet_length("value") <= SAMPLE_DOC_BYTES)
    )
    least = [r["order"] for r in small.select("order").orderBy("order").limit(SAMPLE_DOCS).collect()]
    chosen = small.filter(F.col("order").isin(least)).dropDuplicates(["order"]).collect()
    return [bytes(r["value"]) for r in sorted(chosen, key=lambda r: r["order"])]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; with too few to train on, their bytes are the dictionary."""
    try:
        size = max(256, min(DICTIONARY_BYTES, sum(map(len, samples)) // 10))
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]
