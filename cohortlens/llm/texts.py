"""Word and shingle hashes of whole texts, as numpy arrays, for kernels that run inside tasks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_BYTES = 16 * 1024 * 1024  # Arrow data a kernel is given at once
CACHE_WORDS = 100_000  # words a task remembers the hash of; beyond it the memory starts anew
U64 = np.uint64


_remembered: dict[str, dict] = {}  # what this process keeps from batch to batch, by the kernels it belongs to
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def remembered(owner: str, kind: type[dict] = dict) -> dict:
    """What ``owner``'s kernels keep in this process.  A worker serves one operator after another: others' memories go."""
    if owner not in _remembered:
        _remembered.clear()
        give_back()
        _remembered[owner] = kind()
    return _remembered[owner]


def give_back() -> None:
    """Return freed memory to the system: an executor's workers live through all stages, and their allocators keep it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit (splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space, tab, line feed, vertical tab, form feed and return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    hashes = remembered("words", _WordHashes)
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    return np.fromiter(map(hashes.__getitem__, tokens), U64, len(tokens))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    value = np.full(n, U64(width), U64)
    for i in range(width):
        value = mix(value * U64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return value


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; with fewer words than ``width`` the whole sequence is one shingle."""
    hashes = word_hashes(words(text))
    if len(hashes) == 0:
        return np.empty(0, U64)
    return np.unique(rolled(hashes, min(width, len(hashes))))


def bound_batches(df: DataFrame) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES``: texts are long, and workers share memory."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = re.sub(r"\D", "", conf.get(name))
    if not now or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` where the kernel turns a batch into column dictionaries (arrays or lists), in the schema's order."""
    bound_batches(df)
    spark_schema, arrow = schemas(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in kernel(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
            give_back()

    return df.mapInArrow(run, spark_schema)


def schemas(ddl: str) -> tuple[StructType, pa.Schema]:
    """A schema for Spark and for Arrow."""
    spark_schema = StructType.fromDDL(ddl)
    return spark_schema, to_arrow_schema(spark_schema)
