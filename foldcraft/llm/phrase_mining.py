"""Phrase collocations, counted in counting quotient filters.

Per language, phrases of two and three words inside a piece (a stretch without
``.,;:!?`` or line ends) with at least MIN_COUNT occurrences are candidates.  A
candidate cut after its first k words has the score

    floor(1000000 * a * a / (l * r))

of its count a and its parts' counts l and r; its lowest-scoring cut counts, of
equals the one with the smallest k.  A candidate inside a longer one that has
at least COVER percent of its occurrences is dropped.

Counting.  Words with MIN_COUNT occurrences or more get numbers per language (a
phrase with a rarer word can't be a candidate); n-grams are these numbers packed
side by side into p bits.  A Feistel network permutes the p-bit numbers; the
permuted number's upper bits are the quotient, all others the remainder, which
is kept whole, so nothing is lost and the permutation can be undone.  A filter
holds its slots in order: one bit vector with the quotients in unary, the
remainders in as many bytes as they need, and the counts.  Filters of the same
range of quotients are merged in order, and their counts added.

Distribution.  Texts are cut into batches of CHARS characters, one part per
language; a part numbers its distinct words and stores its tokens once as arrays
in the shared folder.  Distinct words per part, not tokens, meet the table of
frequent words.  A part's n-grams are counted in memory and leave as one filter
per range of quotients; the permutation spreads any n-grams evenly, and a
frequent one is a slot per part, so no range is hot.  A merging task holds one
range, about SHARD slots.  Candidates, cuts and covers are joins of DataFrames on
numbers; the first TOP phrases are ranked in hash groups first.

Defined results: null texts are empty, null languages "und"; repeated rows count
each; equal scores are ordered by count, then by the phrase's bytes; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import row_number_in_order
from ..session import cut_lineage, scratch_path
from .arrays import open_arrays, pack, store_arrays, unpack
from .common import Numbers, documents, slices, spread

MIN_COUNT, TOP, COVER = 10, 2000, 50
#: characters and rows of a batch; slots of a merging task, about
CHARS, ROWS, SHARD = 16 << 20, 20_000, 2_000_000
#: groups in which the first TOP are ranked beforehand
GROUPS = 64
U = np.uint64
#: one odd number's multiples, for the permutation's rounds
KEYS = np.arange(4, dtype=U) * U(0x9E3779B97F4A7C15)
#: stands for the borders of pieces; no UTF-8 text holds this byte
BREAK = b"\xff"
#: the characters that end a piece become line ends, tabs become spaces
PIECES = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i for i in range(256))


def tokens_of(text: str) -> list[bytes]:
    """Words and borders of a text."""
    return text.encode().lower().translate(PIECES).replace(b"\n", b" " + BREAK + b" ").split()


class Packing:
    """Numbers of ``bits`` bits, ``words`` of them side by side, permuted.

    The p-bit number is held as its upper and lower half."""

    def __init__(self, bits: int, words: int):
        self.bits, self.words = bits, words
        p = bits * words
        self.low = p // 2
        self.high = p - self.low
        self.one = p <= 64  # both halves fit in one 64-bit number

    def _halves(self):
        return ((1 << self.high) - 1, (1 << self.low) - 1)

    def join(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The packed and permuted numbers of n-grams."""
        high, low = np.zeros(len(ids[0]), U), np.zeros(len(ids[0]), U)
        for x in ids:  # shift the pair of halves by ``bits`` and put x in
            for at in range(0, self.bits, 16):
                n = min(16, self.bits - at)
                digit = (x >> U(self.bits - at - n)) & U((1 << n) - 1)
                carry = low >> U(max(0, self.low - n)) if self.low >= n else None
                if carry is None:  # a lower half of fewer bits than the digit
                    every = low << U(n) | digit
                    high = (high << U(n)) | (every >> U(self.low))
                    low = every & U(self._halves()[1])
                else:
                    high = (high << U(n)) | carry
                    low = ((low << U(n)) | digit) & U(self._halves()[1])
                high &= U(self._halves()[0])
        return self._permute(high, low, range(4))

    def split(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        """The numbers of the words, from the permuted ones."""
        high, low = self._permute(high, low, range(3, -1, -1))
        out = []
        for w in range(self.words):
            begin = self.bits * (self.words - 1 - w)  # lowest bit of this word
            x = np.zeros(len(high), U)
            for k in range(self.bits):
                at = begin + k
                bit = (low >> U(at)) & U(1) if at < self.low else (high >> U(at - self.low)) & U(1)
                x |= bit << U(k)
            out.append(x)
        return out

    def _permute(self, high, low, rounds):
        top, rest = (U(x) for x in self._halves())
        for r in rounds:
            if r % 2:
                low = low ^ (spread(high + KEYS[r]) & rest)
            else:
                high = high ^ (spread(low + KEYS[r]) & top)
        return high, low

    def count(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None):
        """Distinct numbers in order, and how often they occur (or the sums
        of their counts)."""
        if self.one:
            every = (high << U(self.low)) | low
            order = np.argsort(every, kind="stable") if counts is not None else None
            every = np.sort(every) if order is None else every[order]
            new = np.diff(every, prepend=~every[:1]) != 0
        else:
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            new = (np.diff(high, prepend=~high[:1]) != 0) | (np.diff(low, prepend=~low[:1]) != 0)
        starts = np.flatnonzero(new)
        if counts is None:
            n = np.diff(np.append(starts, len(new))).astype(U)
        else:
            n = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
        if self.one:
            every = every[starts]
            return every >> U(self.low), every & U(self._halves()[1]), n
        return high[starts], low[starts], n


class CountingQuotientFilter:
    """Counts of permuted numbers, in their order."""

    def __init__(self, packing: Packing, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.packing, self.high, self.low, self.counts = packing, high, low, counts

    @classmethod
    def of(cls, packing: Packing, ids: list[np.ndarray]) -> "CountingQuotientFilter":
        return cls(packing, *packing.count(*packing.join(ids)))

    @classmethod
    def merged(cls, filters: list["CountingQuotientFilter"]) -> "CountingQuotientFilter":
        packing = filters[0].packing
        high, low, n = (np.concatenate([getattr(f, k) for f in filters]) for k in ("high", "low", "counts"))
        return cls(packing, *packing.count(high, low, n))

    def ranges(self, bits: int):
        """(range, filter) by the first ``bits`` bits of the numbers."""
        own = self.high >> U(self.packing.high - bits)
        starts = np.flatnonzero(np.diff(own, prepend=~own[:1]))
        for a, b in zip(starts, [*starts[1:], len(own)]):
            yield int(own[a]), CountingQuotientFilter(self.packing, self.high[a:b], self.low[a:b], self.counts[a:b])

    def to_bytes(self, skipped: int = 0) -> bytes:
        """``skipped`` first bits, which are equal, are left out."""
        n = len(self.high)
        left = self.packing.high - skipped
        q = min(left, max(1, n.bit_length()))  # about one slot per quotient
        high = self.high & U((1 << left) - 1)
        quotients = (high >> U(left - q)).astype(np.int64)
        bits = np.zeros(n + (1 << q), bool)
        bits[quotients + np.arange(n)] = True
        rest = high & U((1 << (left - q)) - 1)
        return b"".join([q.to_bytes(1, "little"), n.to_bytes(8, "little"), np.packbits(bits).tobytes(),
                         _cut(rest, left - q), _cut(self.low, self.packing.low), pack(self.counts)])

    @classmethod
    def from_bytes(cls, packing: Packing, blob: bytes, prefix: int = 0, skipped: int = 0) -> "CountingQuotientFilter":
        left = packing.high - skipped
        q, n = blob[0], int.from_bytes(blob[1:9], "little")
        at = 9 + (n + (1 << q) + 7) // 8
        quotients = np.flatnonzero(np.unpackbits(np.frombuffer(blob[9:at], np.uint8))) - np.arange(n)
        parts = []
        for bits in (left - q, packing.low):
            size = (bits + 7) // 8
            parts.append(_uncut(blob[at:at + n * size], n, size))
            at += n * size
        high = (U(prefix) << U(left)) | (quotients.astype(U) << U(left - q)) | parts[0]
        return cls(packing, high, parts[1], unpack(blob[at:]))


def _cut(values: np.ndarray, bits: int) -> bytes:
    """Numbers in as many bytes as ``bits`` bits need."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8].tobytes()


def _uncut(data: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(n, size)
    return out.view("<u8").reshape(n)


PARTS = "batch bigint, lang string, n bigint, words array<string>, counts array<bigint>"


def word_parts(docs: DataFrame, folder: str) -> DataFrame:
    """Stores the tokens of ``docs`` (lang, text) in the folder.  Returns the
    stored table of parts: file, language, words, distinct words, counts."""
    def run(batches):
        for b in batches:
            for part in slices(b, "text", CHARS, ROWS):
                texts = part.column("text").to_pylist()
                rows: dict[str, list[int]] = {}
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    rows.setdefault(lang, []).append(i)
                for lang, own in rows.items():
                    number = Numbers()
                    end = np.array([number[BREAK]], np.int32)
                    ids = []
                    for i in own:
                        words = tokens_of(texts[i] or "")
                        ids += [np.fromiter(map(number.__getitem__, words), np.int32, len(words)), end]
                    tokens = np.concatenate(ids)
                    counts = np.bincount(tokens, minlength=len(number))[1:]
                    path = store_arrays(folder, {"tokens": tokens}, compress=True)
                    yield pa.RecordBatch.from_pydict({
                        "batch": [int(path.rpartition("/")[2].partition(".")[0], 16)], "lang": [lang],
                        "n": [int(counts.sum())], "words": pa.array([[w.decode() for w in list(number)[1:]]], pa.list_(pa.string())),
                        "counts": pa.array([counts], pa.list_(pa.int64()))})

    return cut_lineage(docs.select("lang", "text").mapInArrow(run, PARTS), "phrase-parts")


def frequent_words(parts: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f, id, last): words with ``min_count`` occurrences or more,
    numbered from 1 to last in their language; stored."""
    each = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    f = each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).filter(F.col("f") >= min_count)
    d = row_number_in_order(cut_lineage(f, "phrase-words"), "lang", ["word"], "place")
    return cut_lineage(d.select("lang", "word", "f", (F.col("place") + 1).alias("id"), F.col("place_n").alias("last")), "phrase-numbers")


def count_ngrams(parts: DataFrame, words: DataFrame, folder: str, min_count: int, sizes=(2, 3)) -> DataFrame:
    """(lang, ids, a): n-grams of the numbered words with ``min_count``
    occurrences or more."""
    n = parts.groupBy("lang").agg(F.sum("n").alias("n")).select(F.col("lang").alias("n_lang"), "n")
    w = words.join(n, F.col("lang") == F.col("n_lang")).select(F.col("lang").alias("w_lang"), F.col("word").alias("w_word"), "id", "last", "n")
    local = parts.select("batch", "lang", F.posexplode("words").alias("place", "word"))
    local = local.join(w, (F.col("lang") == F.col("w_lang")) & (F.col("word") == F.col("w_word"))).select(
        "batch", "lang", (F.col("place") + 1).alias("place"), "id", "last", "n")
    slots = SHARD

    def count(key, table):
        batch, lang = key[0].as_py(), key[1].as_py()
        bits = int(table.column("last")[0].as_py()).bit_length()
        ranges = max(0, math.ceil(math.log2(max(1, table.column("n")[0].as_py() / slots))))
        with open_arrays(f"{folder}/{batch:016x}.arrow") as a:
            tokens = np.array(a["tokens"])
        places, ids = (table.column(c).to_numpy() for c in ("place", "id"))
        numbers = np.zeros(max(int(tokens.max(initial=0)), int(places.max())) + 1, U)
        numbers[places] = ids  # other words and borders: 0
        g = numbers[tokens]
        rows = []
        for size in sizes:
            packing = Packing(bits, size)
            prefix = min(ranges, packing.high)
            inside = np.ones(max(0, len(g) - size + 1), bool)
            for k in range(size):
                inside &= g[k:len(g) - size + 1 + k] > 0
            at = np.flatnonzero(inside)
            every = CountingQuotientFilter.of(packing, [g[at + k] for k in range(size)])
            for r, own in every.ranges(prefix):
                rows.append({"lang": lang, "size": size, "bits": bits, "prefix": prefix, "part": r, "slots": own.to_bytes(prefix)})
        return pa.Table.from_pylist(rows, pa.schema([("lang", pa.string()), ("size", pa.int32()), ("bits", pa.int32()),
                                                     ("prefix", pa.int32()), ("part", pa.int64()), ("slots", pa.binary())]))

    def merge(key, table):
        lang, size, bits, prefix, part = (k.as_py() for k in key)
        packing = Packing(bits, size)
        every = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(packing, x.as_py(), part, prefix)
                                               for x in table.column("slots")])
        some = every.counts >= min_count
        ids = packing.split(every.high[some], every.low[some])
        flat = np.stack(ids, 1).astype(np.int64).reshape(-1) if some.any() else np.zeros(0, np.int64)
        many = int(some.sum())
        return pa.Table.from_pydict({
            "lang": pa.array([lang] * many, pa.string()),
            "ids": pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * size, pa.int32()), pa.array(flat)),
            "a": pa.array(every.counts[some].astype(np.int64))})

    filters = local.groupBy("batch", "lang").applyInArrow(
        count, "lang string, size int, bits int, prefix int, part bigint, slots binary")
    return filters.groupBy("lang", "size", "bits", "prefix", "part").applyInArrow(merge, "lang string, ids array<bigint>, a bigint")


def _score(a, left, right):
    """floor(1000000 a a / (l r)): products of up to 37 digits are exact."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", (a * a) * F.lit(1000000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """The first ``top`` phrases of every language of ``docs`` (lang, text):
    lang, rank, phrase, a, l, r, n, score."""
    folder = scratch_path(docs.sparkSession, "phrase-tokens")
    parts = word_parts(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), folder)
    words = frequent_words(parts, min_count)
    found = cut_lineage(count_ngrams(parts, words, folder, min_count), "phrase-counts")
    id_of = [F.get("ids", F.lit(k)).alias(f"i{k + 1}") for k in range(3)]
    two = found.filter("size(ids) = 2").select("lang", *id_of[:2], "a")
    three = found.filter("size(ids) = 3").select("lang", *id_of, "a")

    def with_word(d: DataFrame, k: int) -> DataFrame:
        w = words.select(F.col("lang").alias("w_lang"), F.col("id").alias("w_id"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
        return d.join(w, (F.col("lang") == F.col("w_lang")) & (F.col(f"i{k}") == F.col("w_id"))).drop("w_lang", "w_id")

    def with_pair(d: DataFrame, j: int, k: int, name: str) -> DataFrame:
        p = two.select(F.col("lang").alias("p_lang"), F.col("i1").alias("p1"), F.col("i2").alias("p2"), F.col("a").alias(name))
        return d.join(p, (F.col("lang") == F.col("p_lang")) & (F.col(f"i{j}") == F.col("p1")) & (F.col(f"i{k}") == F.col("p2"))
                      ).drop("p_lang", "p1", "p2")

    longer = three.select("lang", F.explode(F.array(F.struct("i1", "i2"), F.struct(F.col("i2").alias("i1"), F.col("i3").alias("i2"))))
                          .alias("x"), "a").groupBy("lang", "x").agg(F.max("a").alias("over"))
    longer = longer.select(F.col("lang").alias("o_lang"), F.col("x.i1").alias("o1"), F.col("x.i2").alias("o2"), "over")
    free = two.join(longer, (F.col("lang") == F.col("o_lang")) & (F.col("i1") == F.col("o1")) & (F.col("i2") == F.col("o2")), "left")
    free = free.filter(F.coalesce(100 * F.col("over") < cover * F.col("a"), F.lit(True)))
    pairs = with_word(with_word(free, 1), 2).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    pairs = pairs.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    triples = with_pair(with_pair(three, 1, 2, "a12"), 2, 3, "a23")
    triples = with_word(with_word(with_word(triples, 1), 2), 3)
    cuts = F.array(*[F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
                     for k, x, y in ((1, "f1", "a23"), (2, "a12", "f3"))])
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array_min(cuts).alias("cut"))
    every = pairs.unionByName(triples.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    some = every.withColumn("group", group).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= top)
    n = parts.groupBy("lang").agg(F.sum("n").alias("n")).select(F.col("lang").alias("n_lang"), "n")
    return first.join(n, F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir):
    """op13: every language's first collocations."""
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 4) r(k)) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1 AND a >= 10),
cut AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN gram x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(c.w[:c.j], ' ')
  JOIN gram y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_pair AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest([1, 2]) AS s FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_pair i ON b.k = 2 AND i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.a IS NULL OR 100 * i.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
