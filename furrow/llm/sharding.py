"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of their keys. A four-round Feistel network permutes the
smallest even-bit domain that holds N; a value that lands beyond N walks on along its cycle
until it falls inside, so the network permutes exactly 0..N-1. With place = permuted number,
shard = place mod S and slot = place div S: shard sizes differ by one row at most, slots have
no gaps, and any row's shard and slot, or the row at a shard and slot, follow from a formula.

Null keys sort first and get places like any row; null and empty texts have no bytes, very long ones
are only measured. Rows that are equal in doc_id, checksum and size take neighbouring numbers in the
order they are read in; which of them takes which makes no difference to the result. An empty table
gives an empty one. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_numbers

ROUNDS = 4


def _mix(half: np.ndarray, round_: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = half + np.uint64((seed * ROUNDS + round_ + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permute(rows, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """Places of row numbers below ``n``, or with ``inverse`` the row numbers of places."""
    x = np.array(rows, dtype=np.uint64)
    bits = np.uint64(_half_bits(n))
    low = np.uint64((1 << int(bits)) - 1)
    walking = np.ones(len(x), dtype=bool)
    while walking.any():
        left, right = x[walking] >> bits, x[walking] & low
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_mix(left, r, seed) & low), left
            else:
                left, right = right, left ^ (_mix(right, r, seed) & low)
        x[walking] = (left << bits) | right
        walking = x >= n
    return x.astype(np.int64)


def shard_and_slot(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    place = int(permute([row], n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    return int(permute([slot * shards + shard], n, seed, inverse=True)[0])


def assign(rows: DataFrame, order: list[str], shards: int = 24, seed: int = 0) -> DataFrame:
    """``rows`` with row_number, shard and slot. Keep ``rows`` narrow: all its columns are sorted."""
    # rows that are equal in all of the order are told apart, so that copies spread over partitions
    numbered = row_numbers(rows.withColumn("_row", F.monotonically_increasing_id()), [*order, "_row"], "sharding").drop("_row")
    n = numbered.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = numbered.withColumn("_place", place("row_number"))
    slot = F.expr(f"_place div {shards}")
    return placed.withColumns({"shard": (F.col("_place") % shards).cast("int"), "slot": slot}).drop("_place")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """The contract's columns under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(narrow, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
