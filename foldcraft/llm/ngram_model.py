"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Tokens are the words of a text, ASCII letters in lower case, between a begin
and an end mark; the end is predicted like a word, the begin is context alone.
With c(ab) the count of a pair and t(b) the number of distinct a before b,

    p(b|a) = (c(ab) - D[c(ab)]) / c(a.) + g(a) q(b)
    q(b)   = (t(b) - D'[t(b)]) / t(.) + g' / (V + 1)

g(a) and g' give what the discounts took, so both sum to 1 over the V known
tokens and one unknown one.  There are three discounts (for 1, 2, 3 and more)
per order, estimated from the numbers of pairs, and of tokens, with counts 1 to
4.  A context never seen gives q(b).

The order is 2: most word triples of a corpus occur once, so that a third order
stores about as many entries as there are tokens (measured: 75 of 100 triples
are new, against 45 of 100 pairs), more than the input itself.

Distribution.  Texts are cut into batches of CHARS characters; a batch numbers
its distinct words and is stored once as arrays in the shared folder.

1. Pairs.  A batch sends its distinct pairs' 64-bit hashes, sorted, with the
   counts of its learning documents, one blob per shard of the hash range.  A
   shard merges them, stores its sorted hash and count arrays in the shared
   folder, memory-maps these and answers every batch: the total count of each
   of its pairs, in the batch's order, and which pairs this batch speaks for
   (each pair has one speaker).
2. Words.  Speakers add up what contexts and continuations need (c(a.), pairs
   of a by count, t(b)), batches their word counts; shards of the words' hash
   merge, store, map and answer in the same way.
3. Scores.  Each batch maps its own arrays, and has with the answers all numbers
   of its tokens.

Hashes of pairs and words spread evenly, so a frequent word or pair is one entry
per batch and no shard is hot.  A shard's task holds about SHARD entries, a
batch's task one batch; the driver sees sums alone (totals, counts of counts).
Everything between jobs is in the shared folder.

Defined results: null and empty texts have the end as their one token; null
doc_ids are learned from; repeated rows count and are scored each; with nothing
to learn from every token has probability 1 / (V + 1) = 1; an empty table gives
an empty result.  Different words or pairs count as one if their 64-bit hashes
agree (probability about n^2 / 2^65 for n distinct ones).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .arrays import open_arrays, pack, pack_sorted, store_arrays, sum_by_key, unpack, unpack_sorted
from .common import Numbers, documents, slices, spread

#: characters of a batch; entries of a shard, about
CHARS, SHARD = 16 << 20, 2_000_000
ROWS = 20_000
HELD_OUT = 2
#: no word holds a line end
BEGIN, END = b"\n<", b"\n>"
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
#: sums per word: own count, then as context the sum of its pairs' counts and
#: its pairs with count 1, 2, more, then distinct words before it
STATS = ("n", "total", "n1", "n2", "n3", "before")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))


def word_batches(docs: DataFrame) -> DataFrame:
    """Stores ``docs`` (doc_id, text, learn) as arrays.  Returns the stored
    table (batch, n_tokens, n_words) with the files' paths."""
    folder = scratch_path(docs.sparkSession, "word-batches")

    def run(batches):
        for b in batches:
            for part in slices(b, "text", CHARS, ROWS):
                number = Numbers()
                begin, end = number[BEGIN], number[END]
                rows = []
                for t in part.column("text").to_pylist():
                    words = (t or "").encode().lower().split()
                    row = np.empty(len(words) + 2, np.int32)
                    row[0], row[-1] = begin, end
                    row[1:-1] = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                    rows.append(row)
                ids = part.column("doc_id")
                path = store_arrays(folder, {
                    "tokens": np.concatenate(rows), "lengths": np.array([len(r) for r in rows], np.int64),
                    "words": np.fromiter(map(xxhash.xxh3_64_intdigest, number), U, len(number)),
                    "doc_id": ids.fill_null(0).to_numpy(zero_copy_only=False),
                    "no_id": ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                    "learn": part.column("learn").to_numpy(zero_copy_only=False).astype(np.uint8)}, compress=True)
                yield pa.RecordBatch.from_pydict({"batch": [path], "n_tokens": [sum(map(len, rows)) - len(rows)], "n_words": [len(number)]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    return cut_lineage(rows.mapInArrow(run, "batch string, n_tokens bigint, n_words bigint"), "word-batches")


class Batch:
    """A batch's tokens and its distinct pairs, ascending by their hash."""

    def __init__(self, path: str):
        with open_arrays(path) as a:
            a = {k: np.array(v) for k, v in a.items()}
        self.words, self.lengths, self.learn = a["words"], a["lengths"], a["learn"].astype(bool)
        self.doc_id, self.no_id = a["doc_id"], a["no_id"].astype(bool)
        tokens = a["tokens"].astype(np.int64)
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        follows = doc[1:] == doc[:-1]
        self.first, self.token, self.doc = tokens[:-1][follows], tokens[1:][follows], doc[1:][follows]
        n = len(self.words)
        self.local = self.first * n + self.token
        known = np.unique(self.local)
        hashed = pair_hash(self.words[known // n], self.words[known % n])
        order = np.argsort(hashed, kind="stable")
        self.pairs, self.hashes = known[order], hashed[order]
        self._at, self._order = known, order

    def place(self) -> np.ndarray:
        """Every token's place among the pairs."""
        back = np.empty(len(self._order), np.int64)
        back[self._order] = np.arange(len(self._order))
        return back[np.searchsorted(self._at, self.local)]

    def learned(self) -> np.ndarray:
        """How often learning documents have each pair."""
        return np.bincount(self.place()[self.learn[self.doc]], minlength=len(self.pairs)).astype(U)

    def word_order(self) -> np.ndarray:
        return np.argsort(self.words, kind="stable")


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return spread(first * ODD ^ spread(second))


def _shards(hashes: np.ndarray, n_shards: int):
    """(shard, begin, end) of the shards that ascending hashes fall into."""
    step = (1 << 64) // n_shards + 1
    cuts = np.searchsorted(hashes, np.array([step * i for i in range(1, n_shards)], U))
    ends = [0, *cuts.tolist(), len(hashes)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]


ASK = "shard int, batch string, keys binary, sums array<binary>"
ANSWER = "kind string, batch string, shard int, blobs array<binary>, path string, totals array<bigint>"


def _ask_rows(path: str, keys: np.ndarray, sums: list[np.ndarray], n_shards: int):
    parts = _shards(keys, n_shards)
    for at in range(0, len(parts), 64):
        some = parts[at:at + 64]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([i for i, _, _ in some], pa.int32()), "batch": [path] * len(some),
            "keys": pa.array([pack_sorted(keys[a:b]) for _, a, b in some], pa.binary()),
            "sums": pa.array([[pack(v[a:b]) for v in sums] for _, a, b in some], pa.list_(pa.binary()))})


def _paths(batches):
    for b in batches:
        yield from b.column("batch").to_pylist()


def _merge(folder: str, kind: str):
    """A shard's task: merges what the batches ask with, stores the sums and
    answers from the mapped arrays."""

    def run(key, table):
        shard = key[0].as_py()
        rows = sorted(table.select(["batch", "keys", "sums"]).to_pylist(), key=lambda r: r["batch"])
        keys = [unpack_sorted(r["keys"]) for r in rows]
        sums = [np.concatenate([unpack(r["sums"][i]) for r in rows]) for i in range(len(rows[0]["sums"]))]
        every = np.concatenate(keys)
        ends = np.cumsum([0] + [len(k) for k in keys])
        seen = np.flatnonzero(sums[0]) if kind == "pair" else np.arange(len(every))
        merged = sum_by_key(every[seen], *[s[seen] for s in sums])
        path = store_arrays(folder, dict(zip(("keys", *(STATS if kind == "word" else ("n",))), merged)))
        # of equal pairs, the first batch's speaks for the pair
        speaks = np.zeros(len(every), U)
        if kind == "pair":
            order = np.argsort(every[seen], kind="stable")
            speaks[seen[order[np.flatnonzero(np.diff(every[seen][order], prepend=~every[seen][order][:1]))]]] = 1
        del every, sums, merged
        out = []
        with open_arrays(path) as model:
            for r, k, a, b in zip(rows, keys, ends, ends[1:]):
                found = look_up(model, k)
                out.append({"kind": kind, "batch": r["batch"], "shard": shard, "path": None, "totals": None,
                            "blobs": [pack(x) for x in found] + ([pack(speaks[a:b])] if kind == "pair" else [])})
            totals = _totals(model, kind)
        out.append({"kind": f"{kind} model", "batch": None, "shard": shard, "blobs": None, "path": path, "totals": totals})
        return pa.Table.from_pylist(out, pa.schema([
            ("kind", pa.string()), ("batch", pa.string()), ("shard", pa.int32()), ("blobs", pa.list_(pa.binary())),
            ("path", pa.string()), ("totals", pa.list_(pa.int64()))]))

    return run


def look_up(model: dict[str, np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """Sums of the keys in a shard's sorted arrays, 0 for those not there."""
    at = np.searchsorted(model["keys"], keys)
    there = at < len(model["keys"])
    there[there] = model["keys"][at[there]] == keys[there]
    out = []
    for name, column in model.items():
        if name != "keys":
            v = np.zeros(len(keys), U)
            v[there] = column[at[there]]
            out.append(v)
    return out


def _totals(model: dict[str, np.ndarray], kind: str) -> list[int]:
    """Counts of the counts 1 to 4 and more; of words also tokens, distinct
    ones and the sum of words before."""
    n = model["n" if kind == "pair" else "before"]
    out = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:].tolist()
    if kind == "word":
        out += [int(model["n"].sum()), int((model["n"] > 0).sum()), int(n.sum())]
    return out


def _discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more, from the counts of counts 1 to 4."""
    d = [0.0, 0.0, 0.0, 0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        own = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else float(k) / 2
        d[k] = min(max(own, 0.0), float(k))
    return np.array(d)


@dataclass
class Model:
    """Where the arrays are, and the sums over all of them."""
    shards: DataFrame      # kind, shard, path
    n_pair_shards: int
    n_word_shards: int
    discounts: np.ndarray  # of pairs
    lower: np.ndarray      # of tokens
    counts: list[int]      # of tokens by words before: 1, 2, 3 and more
    n_tokens: int
    n_known: int
    n_before: int

    def unigram(self, before: np.ndarray) -> np.ndarray:
        if not self.n_before:
            return np.full(len(before), 1 / (self.n_known + 1))
        kind = np.minimum(before, 3).astype(np.int64)
        rest = float(self.lower[1:] @ np.array(self.counts)) / self.n_before
        return np.maximum(before - self.lower[kind], 0) / self.n_before + rest / (self.n_known + 1)

    def bigram(self, pair: np.ndarray, context: dict[str, np.ndarray], before: np.ndarray) -> np.ndarray:
        """Probability of tokens from their pair's count, the sums of their
        context, and the words before them."""
        total = context["total"]
        kept = np.maximum(pair - self.discounts[np.minimum(pair, 3).astype(np.int64)], 0)
        rest = sum(self.discounts[k] * context[f"n{k}"] for k in (1, 2, 3))
        some = np.maximum(total, 1)
        low = self.unigram(before)
        return np.where(total > 0, kept / some + rest / some * low, low)


def _ask_pairs(n_shards: int):
    def run(batches):
        for path in _paths(batches):
            b = Batch(path)
            yield from _ask_rows(path, b.hashes, [b.learned()], n_shards)
    return run


def _replies(table: pa.Table, kind: str) -> list[np.ndarray]:
    """A batch's answers of one kind, in the order of its keys."""
    rows = sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])
    return [np.concatenate([unpack(r["blobs"][i]) for r in rows]) for i in range(len(rows[0]["blobs"]))]


def _ask_words(n_shards: int):
    def run(key, table):
        b = Batch(key[0].as_py())
        n, speaks = _replies(table, "pair")
        speaks = speaks > 0
        first, second, n = b.pairs[speaks] // len(b.words), b.pairs[speaks] % len(b.words), n[speaks]
        count = len(b.words)
        sums = [np.bincount(b.token[b.learn[b.doc]], minlength=count), np.bincount(first, n, count)]
        sums += [np.bincount(first[own], minlength=count) for own in (n == 1, n == 2, n > 2)]
        sums.append(np.bincount(second, minlength=count))
        order = b.word_order()
        rows = list(_ask_rows(key[0].as_py(), b.words[order], [s[order].astype(U) for s in sums], n_shards))
        return pa.Table.from_batches(rows)
    return run


def fit(batches: DataFrame) -> tuple[Model, DataFrame]:
    """Learns from stored batches.  Returns the model and the answers to the
    batches' own questions, which :func:`scores` takes."""
    spark = batches.sparkSession
    n_tokens, n_words = batches.agg(F.sum("n_tokens"), F.sum("n_words")).first()  # two numbers
    sizes = [max(1, -(-(n or 0) // SHARD)) for n in (n_tokens, n_words)]
    asked = batches.select("batch").mapInArrow(_ask_pairs(sizes[0]), ASK)
    pairs = cut_lineage(asked.groupBy("shard").applyInArrow(
        _merge(scratch_path(spark, "pair-model"), "pair"), ANSWER), "pair-answers")
    asked = pairs.filter("kind = 'pair'").groupBy("batch").applyInArrow(_ask_words(sizes[1]), ASK)
    words = cut_lineage(asked.groupBy("shard").applyInArrow(
        _merge(scratch_path(spark, "word-model"), "word"), ANSWER), "word-answers")
    every = pairs.unionByName(words)
    totals = {r["kind"]: list(r)[1:] for r in every.filter("totals is not null").groupBy("kind").agg(
        *[F.sum(F.get("totals", F.lit(i))) for i in range(8)]).collect()}  # two rows of sums
    p, w = totals.get("pair model", [0] * 8), totals.get("word model", [0] * 8)
    model = Model(every.filter("path is not null").select("kind", "shard", "path"), *sizes, _discounts(p), _discounts(w),
                  [w[0], w[1], w[2] + w[3] + w[4]], w[5], w[6], w[7])
    return model, every.filter("batch is not null").drop("path", "totals")


def ask(batches: DataFrame, model: Model) -> DataFrame:
    """A stored model's answers for batches it has not seen."""
    def pairs(parts):
        for path in _paths(parts):
            b = Batch(path)
            yield from _ask_rows(path, b.hashes, [], model_shards[0])

    def words(parts):
        for path in _paths(parts):
            b = Batch(path)
            yield from _ask_rows(path, b.words[b.word_order()], [], model_shards[1])

    def answer(key, table):
        out = []
        rows = table.to_pylist()
        with open_arrays(rows[0]["path"]) as arrays:
            for r in rows:
                out.append({"kind": kind, "batch": r["batch"], "shard": r["shard"],
                            "blobs": [pack(x) for x in look_up(arrays, unpack_sorted(r["keys"]))]})
        return pa.Table.from_pylist(out, pa.schema([("kind", pa.string()), ("batch", pa.string()), ("shard", pa.int32()),
                                                    ("blobs", pa.list_(pa.binary()))]))

    model_shards = (model.n_pair_shards, model.n_word_shards)
    found = None
    for kind, run in (("pair", pairs), ("word", words)):
        asked = batches.select("batch").mapInArrow(run, ASK)
        own = model.shards.filter(F.col("kind") == f"{kind} model").select(F.col("shard").alias("m_shard"), "path")
        part = asked.join(own, F.col("shard") == F.col("m_shard")).groupBy("shard").applyInArrow(
            answer, "kind string, batch string, shard int, blobs array<binary>")
        part = cut_lineage(part, f"{kind}-answers")
        found = part if found is None else found.unionByName(part)
    return found


def scores(answers: DataFrame, model: Model) -> DataFrame:
    """Per document of the batches: doc_id, learn, n_tokens, n_known (tokens
    that were learned), base_score (add-one unigrams) and score, both log10 of
    the text's probability."""
    sums = {k: v for k, v in vars(model).items() if k != "shards"}

    def run(key, table):
        own = Model(None, **sums)
        b = Batch(key[0].as_py())
        pair = _replies(table, "pair")[0]
        back = np.empty(len(b.words), np.int64)
        back[b.word_order()] = np.arange(len(b.words))
        word = {k: v[back].astype(float) for k, v in zip(STATS, _replies(table, "word"))}
        context = {k: word[k][b.first] for k in ("total", "n1", "n2", "n3")}
        p = own.bigram(pair[b.place()].astype(float), context, word["before"][b.token])
        n = word["n"][b.token]
        docs = len(b.lengths)
        base = np.log10((n + 1) / (own.n_tokens + own.n_known + 1))
        return pa.Table.from_pydict({
            "doc_id": pa.array(b.doc_id, mask=b.no_id), "learn": b.learn, "n_tokens": b.lengths - 1,
            "n_known": np.bincount(b.doc[n > 0], minlength=docs), "base_score": np.bincount(b.doc, base, docs),
            "score": np.bincount(b.doc, np.log10(p), docs)})

    return answers.groupBy("batch").applyInArrow(
        run, "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def op12_ngram_model(spark, sf_dir):
    """op12: every document's log10 probability under a model of the learning ones."""
    docs = documents(spark, sf_dir).select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("learn"))
    model, answers = fit(word_batches(docs))
    return scores(answers, model).select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
