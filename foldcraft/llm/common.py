"""Helpers shared by the corpus operators.

Operators select the columns they need, so extra columns of the caller never
meet their own names.  Those that return the caller's columns and add some
replace a column of an added name, and say so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the white space that separates words: [\x20\x09-\x0D]
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(text: Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters outside SPACES."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def has_word(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")) > 0


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart; rows repeated whole share it."""
    return F.xxhash64(text)


def slices(batch: pa.RecordBatch, column: str, chars: int, rows: int):
    """Slices of a batch with about ``chars`` bytes of the text column, or
    one row of more, and at most ``rows`` rows."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    at = 0
    while at < batch.num_rows:
        end, size = at, 0
        while end < batch.num_rows and end - at < rows and (end == at or size + lengths[end] <= chars):
            size += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


class Numbers(dict):
    """word -> its number, in the order of arrival."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes unsigned 64-bit hashes, so that every bit depends on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
