"""Small helpers that the Arrow kernels of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that a kernel turns into Python objects at a time; bounds a worker's memory, not the result.
SLICE_ROWS = 256


def byte_slices(column: pa.Array) -> Iterator[list[bytes]]:
    """The column's texts as UTF-8 bytes, a slice of rows at a time; null counts as empty."""
    raw = column.cast(pa.large_binary())
    for at in range(0, len(raw), SLICE_ROWS):
        yield [x or b"" for x in raw.slice(at, SLICE_ROWS).to_pylist()]


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text (bytes.split splits at exactly these)."""
    return text.split()
