"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its features: hashed words,
hashed character n-grams of the words (with borders marked) and hashed word
bigrams (a word and the same word again is one feature of its own).  A softmax
layer on that average gives the probability of the label; vectors and layer
are trained together by stochastic gradient descent in numpy.

Training takes a bounded sample of the labelled rows: SAMPLE documents, those
with the smallest hash of their doc_id, so reruns agree and every size draws
alike.  Features of the sample are counted by the executors and the descent
runs as one task over them: at most SAMPLE rows of at most BUCKETS counts.
The model is BUCKETS x DIM numbers, whatever the corpus.

Scoring reads every whole text once and moves nothing.  As the softmax of two
classes depends on one dot product, each bucket comes down to one number.  A
task holds CHARS characters of texts at a time (or one text): it hashes their
distinct words once and forms all pairs and n-grams in arrays.

Defined results: null and empty texts have no features and get the bias's
score; a null doc_id has no label; several labels of one document count as
good if any is; with no labelled rows, or only one class, training sees none
or that class alone and scores are still between 0 and 1; repeated rows get
equal scores; a column named like an added one is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Numbers, documents, slices, spread, text_of

BUCKETS = 1 << 16
DIM = 16
NGRAMS = (3, 4)
#: labelled documents that training sees, at most
SAMPLE = 4000
EPOCHS = 5
RATE = 0.5
THRESHOLD = 0.7
HELD_OUT = 2
#: characters and rows that are scored at a time
CHARS, ROWS = 2 << 20, 2000
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
#: the bucket of a word that stands twice in a row, whichever it is
AGAIN = 0


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _buckets(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of the hashes of one kind of feature."""
    return (spread(h + U(kind * int(ODD) % (1 << 64))) % U(BUCKETS)).astype(np.int64)


class Features:
    """The features of some texts.  Every distinct word is hashed once;
    neighbours and character n-grams mix hashes and code points in numpy.

    ``word``, ``doc``: number of the word and of the text, per token;
    ``pair``, ``pair_doc``: bucket and text of every two neighbours;
    ``owner``, ``bucket``: number and bucket per feature of a distinct word."""

    def __init__(self, texts: list[str]):
        number = Numbers()
        rows = [t.encode().split() for t in texts]
        lengths = [len(r) for r in rows]
        self.word = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.int64, sum(lengths))
        self.doc = np.repeat(np.arange(len(texts)), lengths)
        words = list(number)
        self.n_words = len(words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
        inside = self.doc[1:] == self.doc[:-1] if len(self.doc) else np.zeros(0, bool)
        first, second = self.word[:-1][inside], self.word[1:][inside]
        self.pair_doc = self.doc[1:][inside]
        self.pair = np.where(first == second, AGAIN, _buckets(hashes[first] * ODD ^ spread(hashes[second]), 2))
        marked = [f"<{w.decode()}>" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(words))
        code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(U)
        owner = np.repeat(np.arange(len(words)), sizes)
        left = np.cumsum(sizes)[owner] - np.arange(len(code))  # code points of the word from here on
        owners, buckets = [np.arange(len(words))], [_buckets(hashes, 1)]
        for n in NGRAMS:
            start = np.flatnonzero(left >= n)
            h = np.zeros(len(start), U)
            for k in range(n):
                h = h * ODD + spread(code[start + k])
            owners.append(owner[start])
            buckets.append(_buckets(h, n))
        self.owner, self.bucket = np.concatenate(owners), np.concatenate(buckets)

    def counts(self) -> np.ndarray:
        """How often each bucket occurs, over all texts."""
        of_word = np.bincount(self.word, minlength=self.n_words)
        return np.bincount(self.bucket, of_word[self.owner], BUCKETS) + np.bincount(self.pair, minlength=BUCKETS)

    def means(self, weights: np.ndarray, n_texts: int) -> np.ndarray:
        """The mean weight of every text's features, 0 without any."""
        total = np.bincount(self.owner, weights[self.bucket], self.n_words)
        many = np.bincount(self.owner, minlength=self.n_words)
        total = np.bincount(self.doc, total[self.word], n_texts) + np.bincount(self.pair_doc, weights[self.pair], n_texts)
        many = np.bincount(self.doc, many[self.word], n_texts) + np.bincount(self.pair_doc, minlength=n_texts)
        return total / np.maximum(many, 1)


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    total = Features([text]).counts()
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.int64)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    layer: np.ndarray    # DIM x 2
    bias: np.ndarray     # 2

    def weights(self) -> tuple[np.ndarray, float]:
        """A bucket's share of the log odds, and the odds without features."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = 7) -> Model:
    """Softmax regression on averaged vectors, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, done = max(1, epochs * len(labels)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            now = rate * (1 - done / steps)
            done += 1
            at, n = features[i]
            share = (n / max(1, n.sum()))[:, None]
            mean = (vectors[at] * share).sum(0)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # gradient of the loss by z
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * p
            # an average spreads its step over the features; scaled so that
            # the mean itself moves by the step
            vectors[at] -= now * share / max(1e-9, float((share ** 2).sum())) * back
    return Model(vectors, layer, bias)


def _count_features(batches):
    for b in batches:
        rows = [text_features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("order"), b.column("label"),
             pa.array([x for x, _ in rows], pa.list_(pa.int32())), pa.array([n for _, n in rows], pa.list_(pa.int64()))],
            names=["order", "label", "buckets", "counts"])


def _train_task(batches):
    rows = []
    for b in batches:
        at, n = b.column("buckets"), b.column("counts")
        rows += [(o, y, at[i].values.to_numpy(), n[i].values.to_numpy())
                 for i, (o, y) in enumerate(zip(b.column("order").to_pylist(), b.column("label").to_pylist()))]
    rows.sort(key=lambda r: r[:2])  # the same order in every run
    model = train([(at, n) for _, _, at, n in rows], np.array([y for _, y, _, _ in rows], np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes()]) for x in (model.vectors, model.layer, model.bias)], names=["vectors", "layer", "bias"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on rows (doc_id, label) for ``docs`` (doc_id, text).  Rows that
    may not be learned from are left out by the caller."""
    one = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # the sample bounds what is broadcast: SAMPLE pairs of numbers
    drawn = cut_lineage(one.select(F.col("doc_id").alias("l_doc"), "label", F.xxhash64("doc_id").alias("order"))
                        .orderBy("order", "l_doc").limit(sample), "quality-sample")
    rows = docs.select("doc_id", text_of(F.col("text")).alias("text")).join(
        F.broadcast(drawn), F.col("doc_id") == F.col("l_doc")).select("order", F.col("label").cast("int").alias("label"), "text")
    counted = rows.mapInArrow(_count_features, "order bigint, label int, buckets array<int>, counts array<bigint>")
    got = counted.repartition(1).mapInArrow(_train_task, "vectors binary, layer binary, bias binary").collect()  # one row
    if not got:
        return train([], np.zeros(0, np.int64))
    parts = [np.frombuffer(x) for x in got[0]]
    return Model(parts[0].reshape(BUCKETS, DIM), parts[1].reshape(DIM, 2), parts[2])


def log_odds(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The model's log odds of label 1 for every text."""
    return Features(texts).means(weights, len(texts)) + bias


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, score: str = "score",
            predicted: str = "predicted") -> DataFrame:
    """``docs`` with the columns ``score`` and ``predicted`` (1 if the score
    reaches threshold), in the place of columns of these names."""
    weights, bias = model.weights()
    shipped = docs.sparkSession.sparkContext.broadcast((weights.tolist(), bias))  # BUCKETS numbers
    docs = docs.drop(score, predicted)

    def run(batches):
        numbers, bias = shipped.value
        weights = np.array(numbers)
        for b in batches:
            for part in slices(b, "text", CHARS, ROWS):
                odds = log_odds([t or "" for t in part.column("text").to_pylist()], weights, bias)
                p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    names=[*part.schema.names, score, predicted])

    schema = docs.withColumns({score: F.lit(0.0), predicted: F.lit(0)}).schema
    return docs.mapInArrow(run, schema)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").alias("label"))


def op7_quality_classifier(spark, sf_dir):
    """op7: score and prediction of every document."""
    docs = documents(spark, sf_dir)
    model = fit(docs, quality_labels(spark, sf_dir))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
