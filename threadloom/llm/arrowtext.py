"""Texts of an Arrow column as one run of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def joined_texts(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 of all texts end to end and the bytes of each; a null is an empty text."""
    data = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if not len(data):
        return b"", np.zeros(0, np.int64)
    _, offsets, values = data.buffers()
    at = np.frombuffer(offsets, np.int64, len(data) + 1, data.offset * 8)
    return (bytes(memoryview(values)[at[0] : at[-1]]) if values else b""), np.diff(at)
