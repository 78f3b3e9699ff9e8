"""The manifest and the n-gram operators against plain re-computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcraft.llm import arrays, merkle, ngram_model, phrase_mining

from .helpers import awkward, frame


def key(row):
    return tuple((x is None, x) for x in row)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# arrays --------------------------------------------------------------------

def test_blobs_round_trip():
    r = np.random.default_rng(1)
    for v in ([], [0], [1, 2, 300, 2 ** 64 - 1], r.integers(0, 2 ** 63, 1000)):
        v = np.array(v, np.uint64)
        assert (arrays.unpack(arrays.pack(v)) == v).all()
        v = np.sort(v)
        assert (arrays.unpack_sorted(arrays.pack_sorted(v)) == v).all()


def test_sums_by_key():
    r = np.random.default_rng(2)
    for n in (0, 1, 500):
        k, a = r.integers(0, 20, n).astype(np.uint64), r.integers(0, 9, n).astype(np.uint64)
        got = arrays.sum_by_key(k, a, a * 2)
        want = Counter()
        for x, y in zip(k.tolist(), a.tolist()):
            want[x] += y
        assert dict(zip(got[0].tolist(), got[1].tolist())) == dict(want) and (got[2] == got[1] * 2).all()
        assert (np.diff(got[0].astype(float)) > 0).all()


# manifest --------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(nodes):
    """The last node, and the (left, right) list of every leaf."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i:i + 8]
            for j in range(len(run)):
                for leaf in at[i + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h(*run))
            below.append([x for a in at[i:i + 8] for x in a])
        nodes, at = up, below
    return nodes[0], paths


def brute_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text)"""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops, own = [], {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        top, paths = brute_tree([x[2] for x in groups[name]])
        tops.append(top)
        own[name] = paths
    root, above = brute_tree(tops)
    for name, top, over in zip(names, tops, above):
        for (_, _, leaf, r), path in zip(groups[name], own[name]):
            path = path + over
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = brute_leaf((*r[:4], lowered(r[4])))
            for left, right in path:
                node = h(left, node, right)
            yield (r[0], leaf, top, root, h(*[a + b for a, b in path]), node, node == root)


def manifest_rows(spark, rows, monkeypatch):
    d = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    monkeypatch.setattr(merkle, "documents", lambda spark, sf_dir: d.withColumns({c: F.lit("x") for c in ("pos", "n", "grp", "node", "leaf")}))
    return [tuple(r) for r in merkle.op11_merkle(spark, "").collect()]


@pytest.mark.parametrize("langs", [(None, "en", "de", "é", ""), ("en",), tuple(f"l{i:02d}" for i in range(11))])
def test_manifest_like_brute_force(spark, monkeypatch, langs):
    r = random.Random(4)
    rows = [(i, r.choice(["a", None, "-"]), r.choice(langs), r.choice([None, 7]), t) for i, t in awkward(9)]
    rows += [(i, "s", langs[0], 1, f"Text {i}") for i in range(1000, 1150)]
    rows += rows[:3]
    got = manifest_rows(spark, rows, monkeypatch)
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)
    assert len({x[3] for x in got}) == 1 and not all(x[6] for x in got) and any(x[6] for x in got)


def test_manifest_blocks_are_no_borders(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, None, "en" if i % 5 else None, i, str(i)) for i in range(137)]
    assert sorted(manifest_rows(spark, rows, monkeypatch), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_few(spark, monkeypatch):
    assert manifest_rows(spark, [], monkeypatch) == []
    (got,) = manifest_rows(spark, [(1, None, None, None, None)], monkeypatch)
    leaf = h("1:1", "-", "-", "-", "-")
    assert got == (1, leaf, leaf, leaf, h(), leaf, True)


# language model --------------------------------------------------------------

class BruteModel:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words, before, after = Counter(), Counter(), defaultdict(set), defaultdict(Counter)
        for t in texts:
            seq = [0, *self.cut(t), 1]
            self.pairs.update(zip(seq, seq[1:]))
            self.words.update(seq[1:])
        for (a, b), n in self.pairs.items():
            before[b].add(a)
            after[a][b] = n
        self.before, self.after = {b: len(x) for b, x in before.items()}, after
        self.d, self.low = self.discounts(self.pairs.values()), self.discounts(self.before.values())

    @staticmethod
    def cut(text):
        return re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))

    @staticmethod
    def discounts(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) if n[k - 1] else k / 2 for k in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1] if c else 0

    def low_p(self, b):
        total, v = sum(self.before.values()), len(self.words)
        if not total:
            return 1 / (v + 1)
        rest = sum(self.low(c) for c in self.before.values())
        return max(self.before.get(b, 0) - self.low(self.before.get(b, 0)), 0) / total + rest / total / (v + 1)

    def p(self, a, b):
        own = self.after.get(a)
        if not own:
            return self.low_p(b)
        total = sum(own.values())
        return max(own[b] - self.d(own[b]), 0) / total + sum(map(self.d, own.values())) / total * self.low_p(b)

    def row(self, text):
        seq = [0, *self.cut(text), 1]
        n, v = sum(self.words.values()), len(self.words)
        return (len(seq) - 1, sum(self.words[w] > 0 for w in seq[1:]),
                sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in seq[1:]),
                sum(math.log10(self.p(a, b)) for a, b in zip(seq, seq[1:])))


def is_held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


@pytest.mark.parametrize("chars,shard", [(1 << 20, 2_000_000), (2000, 500)])
def test_scores_like_brute_force(spark, monkeypatch, chars, shard):
    monkeypatch.setattr(ngram_model, "CHARS", chars)
    monkeypatch.setattr(ngram_model, "SHARD", shard)
    rows = awkward(7) + [(400 + i, "A b a B </s> <s> x\x0by") for i in range(8)]
    monkeypatch.setattr(ngram_model, "documents", lambda spark, sf_dir: frame(spark, rows))
    got = sorted(map(tuple, ngram_model.op12_ngram_model(spark, "").collect()), key=key)
    brute = BruteModel([t for i, t in rows if not is_held_out(i)])
    n = sum(brute.words.values())
    want = sorted([(i, is_held_out(i), *brute.row(t)[:2], n, *brute.row(t)[2:]) for i, t in rows], key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)
    assert any(x[1] for x in got)


def test_probabilities_sum_to_one(spark):
    rows = awkward(7)
    model, _ = ngram_model.fit(ngram_model.word_batches(frame(spark, rows).withColumn("learn", F.lit(True))))
    brute = BruteModel([t for _, t in rows])
    assert (model.n_tokens, model.n_known) == (sum(brute.words.values()), len(brute.words))
    for context in (0, "w1", "é", "never seen"):
        assert math.isclose(sum(brute.p(context, b) for b in [*brute.words, "never seen"]), 1, rel_tol=1e-9)


def test_model_scores_other_documents(spark):
    rows, others = awkward(7), awkward(8) + [(900, "entirely unseen words"), (901, None)]
    model, _ = ngram_model.fit(ngram_model.word_batches(frame(spark, rows).withColumn("learn", F.lit(True))))
    d = ngram_model.word_batches(frame(spark, others).withColumn("learn", F.lit(False)))
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in
                  ngram_model.scores(ngram_model.ask(d, model), model).collect()], key=key)
    brute = BruteModel([t for _, t in rows])
    want = sorted([(i, *brute.row(t)) for i, t in others], key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in want], rtol=1e-9)


def test_model_of_nothing(spark):
    d = frame(spark, []).withColumn("learn", F.lit(True))
    model, answers = ngram_model.fit(ngram_model.word_batches(d))
    assert ngram_model.scores(answers, model).collect() == []
    d = frame(spark, [(1, "a b"), (None, None)]).withColumn("learn", F.lit(None).cast("boolean"))
    model, answers = ngram_model.fit(ngram_model.word_batches(d))
    got = ngram_model.scores(answers, model).collect()
    assert sorted([(r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got]) == [(0, 1, 0, 0, 0), (1, 3, 0, 0, 0)]


# phrases -------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 2, 5, 15, 16, 17, 21, 22, 31, 33, 40, 42])
@pytest.mark.parametrize("words", [2, 3])
def test_packing_is_invertible(bits, words):
    r = random.Random(bits)
    rows = list({tuple(r.randrange(1 << bits) for _ in range(words)) for _ in range(500)})
    ids = [np.array(x, np.uint64) for x in zip(*rows)]
    packing = phrase_mining.Packing(bits, words)
    high, low = packing.join(ids)
    assert len(set(zip(high.tolist(), low.tolist()))) == len(rows)
    assert high.max() < 1 << packing.high and low.max() < 1 << packing.low
    assert list(zip(*[x.tolist() for x in packing.split(high, low)])) == rows


@pytest.mark.parametrize("bits,words", [(3, 2), (9, 3), (21, 3), (30, 3), (42, 3)])
def test_filters_lose_nothing(bits, words):
    r = random.Random(bits)
    packing = phrase_mining.Packing(bits, words)
    shards, want = [], Counter()
    for _ in range(3):
        rows = [tuple(min(int(r.paretovariate(0.5)), (1 << bits) - 1) for _ in range(words)) for _ in range(2000)]
        want.update(rows)
        shards.append(phrase_mining.CountingQuotientFilter.of(packing, [np.array(x, np.uint64) for x in zip(*rows)]))
    for prefix in (0, 1, 3):
        got, by_range = Counter(), defaultdict(list)
        for f in shards:
            assert (np.diff(f.high.astype(np.int64)) >= 0).all()
            for at, part in f.ranges(prefix):
                by_range[at].append(part.to_bytes(prefix))
        for at, blobs in by_range.items():
            f = phrase_mining.CountingQuotientFilter.merged(
                [phrase_mining.CountingQuotientFilter.from_bytes(packing, b, at, prefix) for b in blobs])
            for *ids, n in zip(*[x.tolist() for x in packing.split(f.high, f.low)], f.counts.tolist()):
                got[tuple(ids)] += n
        assert got == want


def brute_phrases(rows, least, top, cover):
    """rows (lang, text)"""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, every in f.items():
        found, cand = [], {p: a for p, a in every.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= cover * a for q, b in cand.items()):
                continue
            s, k = min((1000000 * a * a // (every[p[:k]] * every[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), every[p[:k]], every[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            yield (lang, rank, p.decode(), -a, left, right, n[lang], -s)


@pytest.mark.parametrize("chars,shard,top", [(1 << 20, 2_000_000, 2000), (1500, 40, 7)])
def test_phrases_like_brute_force(spark, monkeypatch, chars, shard, top):
    monkeypatch.setattr(phrase_mining, "CHARS", chars)
    monkeypatch.setattr(phrase_mining, "SHARD", shard)
    r = random.Random(2)
    langs = ["en", None, "und", "é", ""]
    rows = [(r.choice(langs), t) for _, t in awkward(5)] + [("en", "New york, new York! a b c; A b\tc a b. \x00 \x00 b")] * 9
    d = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("n", "id", "batch", "word", "phrase")})
    got = sorted(map(tuple, phrase_mining.collocations(d, min_count=4, top=top).collect()))
    assert got == sorted(brute_phrases(rows, 4, top, 50)) and any(" " in x[2].replace(" ", "", 1) for x in got)


def test_scores_are_exact_beyond_64_bits(spark):
    a, x, y = 10 ** 12 + 7, 10 ** 13 + 3, 10 ** 12 + 9
    d = spark.createDataFrame([(a, x, y), (3, 3, 3), (10, 7 * 10 ** 14, 9 * 10 ** 14)], "a bigint, l bigint, r bigint")
    got = [r[0] for r in d.select(phrase_mining._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000000 * a * a // (x * y), 1000000, 0]


def test_phrases_of_nothing(spark):
    d = spark.createDataFrame([], "lang string, text string")
    assert phrase_mining.collocations(d).collect() == []
    d = spark.createDataFrame([("en", None), (None, ""), ("en", "only a few words")], "lang string, text string")
    assert phrase_mining.collocations(d).collect() == []
