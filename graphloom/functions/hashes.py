"""64-bit fingerprints, by batches: the product leaves 64 bits, so plain SQL can't wrap it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv64(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv64_many(values: list[bytes]) -> np.ndarray:
    """All values at once, byte position by byte position."""
    h = np.full(len(values), OFFSET, np.uint64)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-lengths, kind="stable")
    ranked, sizes = [values[i] for i in order], lengths[order]
    out = h.copy()
    with np.errstate(over="ignore"):
        for k in range(int(sizes[0]) if len(values) else 0):
            n = int(np.searchsorted(-sizes, -k, side="left"))
            col = np.frombuffer(bytes(v[k] for v in ranked[:n]), np.uint8).astype(np.uint64)
            h[:n] = (h[:n] ^ col) * np.uint64(PRIME)
    out[order] = h
    return out


@pandas_udf(StringType())
def finding_fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([f"finding:{x:016x}" for x in fnv64_many([(t or "").encode() for t in text])])


@pandas_udf(StringType())
def stable_id(path: pd.Series, line: pd.Series, symbol: pd.Series) -> pd.Series:
    """Hash of path, line as eight little-endian bytes, and symbol."""
    data = [(p or "").encode() + (0 if pd.isna(n) else int(n)).to_bytes(8, "little") + (s or "").encode() for p, n, s in zip(path, line, symbol)]
    return pd.Series([f"{x:016x}" for x in fnv64_many(data)])
