"""64-bit MurmurHash2 (variant A), vectorised over NumPy; Spark's own hashes differ from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

_M, _U = np.uint64(0xC6A4A7935BD1E995), np.uint64


def murmur64a(values: list[bytes], seed: int = 0) -> np.ndarray:
    """Hashes of byte strings, all strings advancing one 8-byte block at a time."""
    size = np.array([len(v) for v in values], np.int64)
    if not len(size):
        return np.zeros(0, _U)
    width = int(-(-max(int(size.max()), 1) // 8) * 8)
    blocks = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), "<u8").reshape(len(values), -1)
    h = _U(seed) ^ (size.astype(_U) * _M)
    for i in range(blocks.shape[1]):
        k = blocks[:, i] * _M
        k = (k ^ (k >> _U(47))) * _M
        left = size - 8 * i
        h = np.where(left >= 8, (h ^ k) * _M, np.where(left > 0, (h ^ blocks[:, i]) * _M, h))
    h = (h ^ (h >> _U(47))) * _M
    return h ^ (h >> _U(47))


@pandas_udf(LongType())
def _murmur(values: pd.Series) -> pd.Series:
    """Strings of like lengths at a time, so that one long key pads no others; null for null."""
    raw = [None if v is None else bytes(v) for v in values]
    out = pd.Series([None] * len(raw), dtype="Int64")
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(raw):
        if v is not None:
            groups.setdefault(len(v).bit_length(), []).append(i)
    for at in groups.values():
        out.iloc[at] = murmur64a([raw[i] for i in at]).view(np.int64)
    return out


def murmur(value: Column) -> Column:
    """The hash as a signed BIGINT of the same bits."""
    return _murmur(value.cast("binary"))


def hex64(signed: Column) -> Column:
    """16 lower-case hex digits, which order as unsigned numbers do."""
    return F.lpad(F.lower(F.hex(signed)), 16, "0")


def hash_tag(key: Column) -> Column:
    """The text in the first pair of braces if there is some, else the whole key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)
