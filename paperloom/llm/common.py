"""Helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Unicode White_Space, as a regular-expression character class body.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Rows of one flat array as an Arrow list column."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch in one uint32 array, and where each text starts."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    joined = "".join(t for t in texts if t)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts
