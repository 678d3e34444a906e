"""Which keys a log holds, without reading the log: per micro-batch and hash bucket one row with a bloom filter and the keys.

A new batch is tested against the filters of its buckets, which is the only column read of batches that hold none of its keys. Batches that may
hold one are opened, through the partition pruning of the join, and the answer is exact. At 32 bits a key about one key in five million is
looked up in vain per filter, so a batch of new keys reads next to nothing but filters: 4 bytes per key of the log.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialise
from feedloom.sources.read import read_or_empty

BITS_PER_KEY, PROBES, _AT_ONCE = 32, 20, 65_536
#: Hash buckets of an index. A task holds the filters of one bucket, and the keys of one bucket of one batch.
BUCKETS = 16


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers of each key: double hashing, one row per key."""
    step = h2.astype(np.uint64) | np.uint64(1)
    return (h1.astype(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def make_filter(h1: np.ndarray, h2: np.ndarray) -> bytes:
    size = max(64, BITS_PER_KEY * len(h1))
    bits = np.zeros(size, bool)
    for a in range(0, len(h1), _AT_ONCE):
        bits[_places(h1[a : a + _AT_ONCE], h2[a : a + _AT_ONCE], size).ravel()] = True
    return np.array([size], "<u8").tobytes() + np.packbits(bits).tobytes()


def may_hold(packed: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    size = int(np.frombuffer(packed, "<u8", 1)[0])
    raw = np.frombuffer(packed, np.uint8, offset=8)
    left = np.arange(len(h1))  # each probe drops about half of the new keys
    at, step, wide = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1), np.uint64(size)
    for k in range(PROBES):
        place = (at[left] + np.uint64(k) * step[left]) % wide
        left = left[((raw[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1) == 1]
    held = np.zeros(len(h1), bool)
    held[left] = True
    return held


def _hashed(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    text = F.col(key).cast("string")
    bucket = F.pmod(F.xxhash64(text, F.lit(0)), F.lit(buckets)).cast("int")
    known = keys.where(F.col(key).isNotNull()).select(key).distinct()
    return known.select(F.col(key).alias("key"), bucket.alias("bucket"), F.xxhash64(text, F.lit(1)).alias("h1"), F.xxhash64(text, F.lit(2)).alias("h2"))


def add_keys(keys: DataFrame, folder: str, batch: str, key: str = "event_id", buckets: int = BUCKETS) -> None:
    """Index the keys of one batch; a repeated call replaces the batch. Null keys are left out; keys may repeat."""
    kind = keys.schema[key].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
        names = table.column("key").combine_chunks()
        held = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([make_filter(h1, h2)], pa.binary()), "keys": held})

    rows = _hashed(keys, key, buckets).groupBy("bucket").applyInArrow(build, f"bucket int, bits binary, keys array<{kind}>")
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def possible_batches(keys: DataFrame, folder: str, except_batch: str | None = None, key: str = "event_id", buckets: int = BUCKETS) -> DataFrame:
    """(batch, bucket, key): which parts of the index may hold which of the keys, by their filters alone."""
    filters = read_or_empty(keys.sparkSession, folder, "bucket int, bits binary, batch string")
    if except_batch is not None:
        filters = filters.where(F.col("batch") != except_batch)
    kind = keys.schema[key].dataType.simpleString()

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        h1, h2 = (left.column(c).to_numpy() for c in ("h1", "h2"))
        names, found = left.column("key").combine_chunks(), []
        for batch, bucket, bits in zip(*(right.column(c).to_pylist() for c in ("batch", "bucket", "bits"))):
            hit = np.flatnonzero(may_hold(bits, h1, h2))
            if len(hit):
                found.append(pa.table({"batch": pa.array([batch] * len(hit), pa.string()), "bucket": pa.array([bucket] * len(hit), pa.int32()), "key": names.take(pa.array(hit))}))
        return pa.concat_tables(found) if found else pa.table({"batch": pa.array([], pa.string()), "bucket": pa.array([], pa.int32()), "key": names.slice(0, 0)})

    return _hashed(keys, key, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, f"batch string, bucket int, key {kind}")


def stored_keys(possible: DataFrame, folder: str) -> DataFrame:
    """(key): the keys of ``possible`` (batch, bucket, key) that are indeed stored. Only the batches named are opened."""
    kind = possible.schema["key"].dataType.simpleString()
    stored = read_or_empty(possible.sparkSession, folder, f"bucket int, keys array<{kind}>, batch string")
    parts = possible.groupBy("batch", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    opened = stored.join(F.broadcast(parts), ["batch", "bucket"], "left_semi").select(F.explode("keys").alias("key"))  # at most one row per filter
    return possible.select("key").distinct().join(opened, "key", "left_semi")


def known_keys(keys: DataFrame, folder: str, except_batch: str | None = None, key: str = "event_id", buckets: int = BUCKETS) -> DataFrame:
    """(key): those of ``keys`` that the index holds in any other batch than ``except_batch``."""
    return stored_keys(materialise(possible_batches(keys, folder, except_batch, key, buckets)), folder)
