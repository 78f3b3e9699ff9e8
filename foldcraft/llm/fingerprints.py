"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed
to a wide vector, and the fingerprint is the sum of the vectors modulo powers
of two, so it does not depend on the order of paragraphs, and a paragraph is
inserted or deleted by adding or subtracting its vector:

* LANES lanes of 64 bits: the paragraph's BLAKE2b hash, summed modulo 2^64.
  They decide equality.
* SIGNS signed lanes of 64 bits: one hash bit read as +1 or -1, for each piece
  of PIECE characters of the paragraph, summed.  No text has pieces enough to
  wrap a sum.  The squared difference of two such sums is, on the mean, the
  number of pieces in which the texts differ, which gives the likeness.

Written out, a fingerprint is the LANES in 16 hex digits each and the last 16
bits of the sign lanes in 4 each; if a sign lane needs more than 16 bits, the
first 48 bits of all of them follow, in 12 each.

Likeness of two fingerprints is 1 - |a - b|^2 / (|a|^2 + |b|^2) over the sign
lanes, cut to 0..1: 1 for equal ones, near 0 for texts
without common pieces.

Neighbours.  An edited text takes its end from the next document in
descending doc_id.  Rows are cut into ranges of doc_id (quantiles of the ids
alone), each range is shuffled to a partition and sorted there, and the first
row of each range is also sent to the range before it as a guest, so every
row meets the next one with a single shuffle of the texts and a task holds two
rows at a time.  The first rows' ids, one per range, are broadcast.  The edited
fingerprint is computed incrementally: paragraphs from the cut on are
subtracted, their replacement is added.

Defined results: null text is read as empty, the empty multiset with
fingerprint zero in all lanes, and likeness 1 to another empty one; null
doc_ids come last in descending order; rows that share a doc_id are ordered
by their text's hash, rows repeated whole follow each other; the last row's
next is the first row (a single row's next is itself); an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import quantile_boundaries, with_value_bucket
from .common import documents, text_key, text_of

LANES = 8
SIGNS = 128
PIECE = 40
#: bytes of text in one range, about, within limits to the number of ranges
RANGE_BYTES = 8 << 20
MIN_RANGES, MAX_RANGES = 64, 10_000
U = np.uint64


class Fingerprint:
    """A multiset of paragraphs."""

    __slots__ = ("lanes", "signs")

    def __init__(self, lanes: np.ndarray, signs: np.ndarray):
        self.lanes, self.signs = lanes, signs

    @classmethod
    def of(cls, paragraphs: list[str]) -> "Fingerprint":
        if not paragraphs:
            return cls(np.zeros(LANES, U), np.zeros(SIGNS, np.int64))
        wide = b"".join([hashlib.blake2b(p.encode(), digest_size=8 * LANES).digest() for p in paragraphs])
        bits = b"".join([xxhash.xxh3_128_digest(p[i:i + PIECE].encode())
                         for p in paragraphs for i in range(0, max(1, len(p)), PIECE)])
        ones = np.zeros(SIGNS, np.int64)
        rows = np.frombuffer(bits, np.uint8).reshape(-1, SIGNS // 8)
        for at in range(0, len(rows), 1 << 14):
            ones += np.unpackbits(rows[at:at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
        return cls(np.frombuffer(wide, "<u8").reshape(-1, LANES).sum(0, dtype=U),
                   2 * ones - len(rows))

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.lanes + other.lanes, self.signs + other.signs)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.lanes - other.lanes, self.signs - other.signs)

    def __str__(self) -> str:
        out = self.lanes.astype(">u8").tobytes().hex() + self.signs.astype(">u2").tobytes().hex()
        if np.array_equal(self.signs.astype(np.int16), self.signs):
            return out
        return out + self.signs.astype(">i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes().hex()

    def likeness(self, other: "Fingerprint") -> float:
        if np.array_equal(self.lanes, other.lanes) and np.array_equal(self.signs, other.signs):
            return 1.0
        a, b = self.signs.astype(float), other.signs.astype(float)
        d = (self.signs - other.signs).astype(float)
        both = float(a @ a + b @ b)
        return min(1.0, max(0.0, 1.0 - float(d @ d) / both)) if both else 0.0


def paragraphs(text: str) -> list[str]:
    """The multiset of a text; the empty text has none."""
    return text.split("\n") if text else []


def edit(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced by the start of the following
    one, and the place of the first changed character."""
    n = len(text) // 3
    cut = len(text) - n
    return text[:cut] + following[:n], cut


def edited(fp: Fingerprint, text: str, new: str, cut: int) -> Fingerprint:
    """The fingerprint of ``new``, which equals ``text`` up to ``cut``, from
    that of ``text``."""
    if not text or not new:
        return Fingerprint.of(paragraphs(new))
    line = text.rfind("\n", 0, cut) + 1  # start of the first paragraph that changes
    return fp - Fingerprint.of(text[line:].split("\n")) + Fingerprint.of(new[line:].split("\n"))


OUT = ("doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _pair_up(batches):
    """Rows (doc_id, text, range, guest) in order; each is worked on when the
    next row of its range has come."""
    out: list[tuple] = []
    held = None

    def batch():
        columns = list(zip(*out))
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=[x.split()[0] for x in OUT.split(", ")])

    size = 0
    for b in batches:
        ids, texts, ranges, guests = (b.column(c) for c in ("doc_id", "text", "range", "guest"))
        for i in range(b.num_rows):
            text = texts[i].as_py()
            row = (ids[i].as_py(), text, Fingerprint.of(paragraphs(text)), ranges[i].as_py())
            if held is not None and held[3] == row[3]:
                doc, own, fp, _ = held
                new, cut = edit(own, text)
                fp2 = edited(fp, own, new, cut)
                out.append((doc, len(own), new, str(fp), str(fp2), fp.likeness(fp2), fp.likeness(row[2])))
                size += len(new)
            held = None if guests[i].as_py() else row
            if size > 4 << 20:
                yield batch()
                size = 0
    if out:
        yield batch()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Rows OUT for ``docs`` (doc_id, text): fingerprints of every text and
    of its edited text, and likenesses."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    n_ranges = int(min(MAX_RANGES, max(MIN_RANGES, size // RANGE_BYTES)))
    ids = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)).alias("at"))
    cuts = quantile_boundaries(ids, "at", n_ranges)
    # range 0 has the smallest ids, and null ones
    heads = with_value_bucket(ids, "at", cuts, "range").groupBy("range").agg(F.max("doc_id").alias("head"))
    up = Window.orderBy("range")  # one row per range: MAX_RANGES at most
    heads = heads.select("head", F.coalesce(F.lead("range").over(up), F.min("range").over(Window.partitionBy()))
                         .alias("before"))
    d = docs.select("doc_id", text_of(F.col("text")).alias("text"),
                    F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)).alias("at"))
    d = with_value_bucket(d, "at", cuts, "range").join(
        F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct("range", F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    d = d.select("doc_id", "text", text_key(F.col("text")).alias("tkey"), F.explode(
        F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"))
    d = d.select("doc_id", "text", "tkey", "to.range", "to.guest").repartition("range").sortWithinPartitions(
        "range", "guest", F.col("doc_id").desc_nulls_last(), F.col("tkey").desc())
    return d.drop("tkey").mapInArrow(_pair_up, OUT)


def op9_fingerprints(spark, sf_dir):
    """op9: fingerprints and likenesses of every document."""
    d = fingerprint_documents(documents(spark, sf_dir))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                    "fingerprint", "edited_fingerprint", "near_edited", "near_next")
