"""What the operators of this subpackage share: word rules, batches, lineage cuts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.matching import checkpointed  # noqa: F401  lineage cuts in the shared folder

#: Bytes of a text are handled in slices of about this size, so that a worker's memory
#: doesn't depend on how many rows Spark puts in an Arrow batch.
SLICE_BYTES = 2 << 20

#: Lower-cases A-Z, keeps 0-9 a-z and every byte over 0x7F, makes a space of all else.
TERM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.lower().split()


def term_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z."""
    return text.translate(TERM_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as bytes; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of about SLICE_BYTES of text each; a longer text is a slice of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a column of strings: first row, row beyond, and the texts as bytes. Only one slice is copied out at a time, and what was
    freed meanwhile goes back to the system in the end: idle workers count with an executor's memory."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
    start = size = 0
    for i, n in enumerate([*sizes, SLICE_BYTES]):
        if i == len(sizes) or size and size + n > SLICE_BYTES:
            if i > start:
                yield start, i, utf8(column.slice(start, i - start))
            start, size = i, 0
        size += n
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words ``[^\\x20\\x09-\\x0D]+`` of some texts with A-Z lower-cased, the number of each word of the texts one after another, and the
    words of each text. Arrow tells words apart, so Python sees each different one once."""
    column = pa.array(texts, pa.large_binary()).view(pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column)))
    flat, counts = words.flatten(), words.value_lengths().to_numpy().copy()
    blank = np.fromiter((not x.strip() for x in texts), bool, len(texts))
    if blank.any():  # such a text is one empty word
        flat = flat.filter(pc.not_equal(flat, ""))
        counts[blank] = 0
    found = flat.dictionary_encode()
    return found.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), counts
