"""Word blocks: runs of documents stored as one dictionary of distinct words and the documents' word numbers.

A word's positions stay with its block. What travels between tasks is, for each block and part of the key space,
one row with the block's distinct words in that part; answers come back as arrays in the same order.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a block, whose distinct words travel once.
BLOCK_BYTES = 14 << 20
#: Text behind the distinct words of one part.
PART_BYTES = 2 << 20


def pack_codes(codes: np.ndarray, width: int = 4) -> bytes:
    """The numbers' bytes by significance, which compress better apart, after their count."""
    octets = codes.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return len(codes).to_bytes(8, "little") + zlib.compress(np.ascontiguousarray(octets).tobytes(), 1)


def unpack_codes(data: bytes, width: int = 4) -> np.ndarray:
    octets = np.frombuffer(zlib.decompress(data[8:]), np.uint8).reshape(width, int.from_bytes(data[:8], "little"))
    return np.ascontiguousarray(octets.T).view(f"<u{width}").ravel().astype(np.int64 if width < 8 else np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences, which are a good deal shorter."""
    return pack_codes(np.diff(keys, prepend=np.uint64(0)), 8)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_codes(data, 8), dtype=np.uint64)


def part_count(docs: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> int:
    """How many parts the words of docs are dealt to: in proportion to the text."""
    return 1 + (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // part_bytes


def expand(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the entries of each code, where code c has sizes[c] entries from starts[c] on."""
    n = sizes[codes]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts[-1] + sizes[-1]) if len(starts) else 0) < 1 << 31 else np.int64
    return np.repeat((starts[codes] - ends + n).astype(kind), n) + np.arange(total, dtype=kind)


def cuts_of(part: np.ndarray) -> np.ndarray:
    """Where the runs of an ascending array begin, and its length."""
    return np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)


def list_column(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """Sizes and concatenated values of a list column."""
    array = table.column(column).combine_chunks()
    array = array if isinstance(array, pa.Array) else pa.concat_arrays(array.chunks)
    return np.diff(array.offsets.to_numpy()), array.flatten()
