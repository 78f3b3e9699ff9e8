"""Substring dedup by level-wise doubling.

Repeats of ``window`` words are found in two levels.  At half the length,
windows are exchanged by hash and counted; only windows that repeat there are
extended to twice the length and exchanged again.  At the full length the
candidates that still repeat are the result: every occurrence but the first
(smallest doc_id, then smallest start) is deleted.  A longer repeat is
covered by its windows of this length, so growing further could delete
nothing more.

At the first level a document does not send all its windows.  Each long
window is represented by the half-length window with the smallest hash among
those inside it: equal long windows have equal representatives, so a long
window whose representative does not repeat cannot repeat, and only about a
sixth of all half windows (for 20 words) ever represent one.

Distribution.  Three shuffles of hash arrays, split by hash into as many
parts as keep one part near ``PART`` entries, and one shuffle of the texts,
which both joins share.  Before each exchange a task keeps one entry per
hash: what repeats inside its batch is decided on the spot, so a passage that
a third of all documents hold sends one entry per batch to the part of its
hash, and the marks of the other occurrences travel by document.  Nothing
reaches the driver but one sum.

Defined results: null text has no words; words are the runs of characters
outside [\\x20\\x09-\\x0D]; a null doc_id comes before all others; rows that
share a doc_id are told apart by their text's hash, rows repeated whole share
one result and do not count as repeats of each other; an empty table gives
an empty result.  Windows are compared by 64-bit hashes at both levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_key, text_of

WINDOW = 20
#: entries in one part of an exchange, about
PART = 2_000_000
#: words after which a task sends what it has
FLUSH = 1_000_000
NO_ID = -(1 << 63)
U = np.uint64


class WordHashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair (a, b)."""
    x = a * U(0x9E3779B97F4A7C15) + (b ^ (b >> U(31))) * U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` of the sequence ``h``, by doubling."""
    if len(h) < length:
        return h[:0]
    cur, n = h, 1
    for bit in bin(length)[3:]:
        cur, n = mix(cur[:-n], cur[n:]), 2 * n
        if bit == "1":
            cur, n = mix(cur[:-1], h[n:]), n + 1
    return cur


def long_windows(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every window, hash of its representative half window, start
    of that one)."""
    half = (window + 1) // 2
    hh = window_hashes(h, half)
    n = len(h) - window + 1
    if n <= 0:
        return h[:0], h[:0], np.zeros(0, np.int64)
    rep, at = hh[:n].copy(), np.arange(n)
    for j in range(1, window - half + 1):
        less = hh[j:j + n] < rep
        rep[less] = hh[j:j + n][less]
        at[less] = np.flatnonzero(less) + j
    return mix(hh[:n], hh[window - half:window - half + n]), rep, at


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.ListArray:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


EXCHANGE = "part int, docs array<bigint>, keys array<bigint>, starts array<int>, hashes array<bigint>, known array<tinyint>"


def _by_part(part, doc, key, start, h, known) -> pa.RecordBatch:
    """Rows of EXCHANGE, one per part."""
    order = np.argsort(part, kind="stable")
    part, doc, key, start, h, known = (x[order] for x in (part, doc, key, start, h, known))
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[ends - 1].astype(np.int32)), _lists(doc, ends, pa.int64()), _lists(key, ends, pa.int64()),
         _lists(start.astype(np.int32), ends, pa.int32()), _lists(h.view(np.int64), ends, pa.int64()),
         _lists(known.astype(np.int8), ends, pa.int8())],
        names=["part", "docs", "keys", "starts", "hashes", "known"])


def _send(doc, key, start, h, parts: int, first_stays: bool) -> pa.RecordBatch:
    """What a batch sends.  Entries are ordered by hash, document and start.
    The first of each hash goes to the part of the hash, with known 1 if the
    hash repeats in this batch and 0 otherwise.  The others are decided (known
    2): they repeat, and travel to a part of their document.  If the first
    occurrence stays, rows equal to it in document and start do too."""
    order = np.lexsort((start, doc, h))
    doc, key, start, h = doc[order], key[order], start[order], h[order]
    new = np.append(True, h[1:] != h[:-1])
    later = ~new
    if first_stays:
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = (doc != doc[head]) | (start != start[head])
        keep = new | later | (key != key[head])
        doc, key, start, h, later = (x[keep] for x in (doc, key, start, h, later))
    known = np.where(later, 2, np.append(later[1:], False))
    part = np.where(later, (doc.view(U) * U(0x9E3779B97F4A7C15) ^ key.view(U)) >> U(33), h >> U(33)) % U(parts)
    return _by_part(part, doc, key, start, h, known)


def _word_batches(batches, cache, extra: str | None = None) -> Iterator[list]:
    """Lists of (doc, key, word hashes[, extra]) of about FLUSH words."""
    got, n = [], 0
    for b in batches:
        docs, keys, texts = (b.column(c) for c in ("did", "tkey", "text"))
        more = b.column(extra) if extra else None
        for i in range(b.num_rows):
            if more is not None and not more[i].is_valid:
                continue
            words = texts[i].as_py().encode().split()
            h = np.fromiter(map(cache.__getitem__, words), U, len(words))
            got.append((docs[i].as_py(), keys[i].as_py(), h,
                        more[i].values.to_numpy().view(U) if more is not None else None))
            n += len(words)
            if n >= FLUSH:
                yield got
                got, n = [], 0
    if got:
        yield got


def send_representatives(window: int, parts: int):
    def run(batches):
        cache = WordHashes()
        for got in _word_batches(batches, cache):
            rows = []
            for doc, key, h, _ in got:
                _, rep, at = long_windows(h, window)
                if not len(rep):
                    continue
                # a half window that represents several neighbours counts once
                value, n = np.unique(rep[np.append(True, at[1:] != at[:-1])], return_counts=True)
                value = np.concatenate((value, value[n > 1]))
                rows.append((np.full(len(value), doc), np.full(len(value), key), value))
            if rows:
                doc, key, h = (np.concatenate(x) for x in zip(*rows))
                yield _send(doc, key, np.zeros(len(h), np.int32), h, parts, False)
    return run


def _columns(table: pa.Table):
    """Flat arrays of one part's rows."""
    def flat(name):
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks])
    return flat("docs"), flat("keys"), flat("starts"), flat("hashes").view(U), flat("known")


def _per_document(doc, key, values, kind, name) -> pa.Table:
    order = np.lexsort((key, doc))
    doc, key, values = doc[order], key[order], values[order]
    if not len(doc):
        ends = np.zeros(0, np.int64)
    else:
        ends = np.append(np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1, len(doc))
    return pa.Table.from_arrays([pa.array(doc[ends - 1], pa.int64()), pa.array(key[ends - 1], pa.int64()),
                                 _lists(values, ends, kind)], names=["g_doc", "g_key", name])


def repeated_representatives(table: pa.Table) -> pa.Table:
    """Per document the hashes of this part that occur more than once."""
    doc, key, _, h, known = _columns(table)
    decided = known == 2
    d, k, v, n = doc[~decided], key[~decided], h[~decided], known[~decided]
    order = np.argsort(v, kind="stable")
    d, k, v, n = d[order], k[order], v[order], n[order]
    same = v[1:] == v[:-1]
    repeated = np.append(False, same) | np.append(same, False) | (n == 1)
    return _per_document(np.concatenate((doc[decided], d[repeated])), np.concatenate((key[decided], k[repeated])),
                         np.concatenate((h[decided], v[repeated])).view(np.int64), pa.int64(), "hashes")


def send_candidates(window: int, parts: int):
    """Windows whose representative repeats (column hashes)."""
    def run(batches):
        cache = WordHashes()
        for got in _word_batches(batches, cache, "hashes"):
            rows = []
            for doc, key, h, repeated in got:
                value, rep, _ = long_windows(h, window)
                at = np.flatnonzero(np.isin(rep, repeated))
                rows.append((np.full(len(at), doc), np.full(len(at), key), at, value[at]))
            doc, key, start, h = (np.concatenate(x) for x in zip(*rows))
            if len(h):
                yield _send(doc, key, start, h, parts, True)
    return run


def later_windows(table: pa.Table) -> pa.Table:
    """Per document the starts of windows that are not the first of theirs."""
    doc, key, start, h, known = _columns(table)
    decided = known == 2
    d, k, s, v = doc[~decided], key[~decided], start[~decided], h[~decided]
    order = np.lexsort((s, d, v))
    d, k, s, v = d[order], k[order], s[order], v[order]
    later = np.append(False, v[1:] == v[:-1])[:len(v)]
    if len(v):
        head = np.maximum.accumulate(np.where(~later, np.arange(len(v)), 0))
        later &= (d != d[head]) | (s != s[head])
    return _per_document(np.concatenate((doc[decided], d[later])), np.concatenate((key[decided], k[later])),
                         np.concatenate((start[decided], s[later])), pa.int32(), "starts")


def cut_words(window: int):
    """Texts without the words of the windows in ``starts``."""
    def run(batches):
        for b in batches:
            ids, texts, starts = (b.column(c) for c in ("did", "text", "starts"))
            kept, total, gone = [], [], []
            for i in range(b.num_rows):
                words = texts[i].as_py().encode().split()
                total.append(len(words))
                if starts[i].is_valid:
                    at = starts[i].values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    words = [w for w, x in zip(words, stay.tolist()) if x]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["did", "n_words", "n_removed", "kept"])
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text): the words of
    every text without those in a window of ``window`` words that starts
    earlier too; kept words are joined by one space."""
    d = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    parts = max(64, size // (6 * PART))
    d = d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), text_key(F.col("text")).alias("tkey"), "text")

    def per_document(table, column):
        return table.groupBy("g_doc", "g_key").agg(F.flatten(F.collect_list(column)).alias(column))

    def with_marks(marks):
        return d.join(marks, (F.col("did") == F.col("g_doc")) & (F.col("tkey") == F.col("g_key")), "left")

    repeated = (d.mapInArrow(send_representatives(window, parts), EXCHANGE).groupBy("part")
                .applyInArrow(repeated_representatives, "g_doc bigint, g_key bigint, hashes array<bigint>"))
    # a shuffled join at every size; as both joins want the same columns of d,
    # the texts are shuffled once
    candidates = with_marks(per_document(repeated, "hashes").hint("merge")).select("did", "tkey", "text", "hashes")
    later = (candidates.mapInArrow(send_candidates(window, parts), EXCHANGE).groupBy("part")
             .applyInArrow(later_windows, "g_doc bigint, g_key bigint, starts array<int>"))
    marked = with_marks(per_document(later, "starts").hint("merge")).select("did", "text", "starts")
    out = marked.mapInArrow(cut_words(window), "did bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept")


def op1_substring_dedup(spark, sf_dir):
    """op1: word counts, words deleted and the hash of what is kept."""
    d = dedup_substrings(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS c
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d) x),
later AS (
  SELECT doc_id, s FROM (SELECT *, min((doc_id, s)) OVER (PARTITION BY c) AS first FROM win) z WHERE first < (doc_id, s)),
cover AS (SELECT doc_id, list(s ORDER BY s) AS ss FROM later GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
mark AS (
  SELECT p.doc_id, p.i, p.w[p.i] AS word,
    max(l.s) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) AS last
  FROM pos p LEFT JOIN later l ON l.doc_id = p.doc_id AND l.s = p.i),
agg AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE i - last < 20) AS gone,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 20) AS kept
  FROM mark GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""
