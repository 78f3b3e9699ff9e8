"""Substring, line and SimHash dedup against plain re-computations."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from foldcraft.llm import line_dedup, simhash, substring_dedup
from foldcraft.llm.common import SPACES

from .helpers import awkward, frame

LOW = -(1 << 63)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def place(doc_id):
    return LOW if doc_id is None else doc_id


def brute_substrings(rows, window):
    first = {}
    for doc, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (place(doc), s)), (place(doc), s))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (place(doc), s):
                gone |= set(range(s, s + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("window", [4, 7, 20])
def test_substrings_like_brute_force(spark, window):
    rows = awkward()
    got = substring_dedup.dedup_substrings(frame(spark, rows), window).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_substrings(rows, window), key=key)


def test_substrings_in_small_batches(spark, monkeypatch):
    """Batches and parts so small that all entries have to meet in exchanges."""
    rows = awkward(5)
    run = substring_dedup.send_representatives(6, 7)
    import pyarrow as pa

    def batches(size):
        for i in range(0, len(rows), size):
            part = rows[i:i + size]
            yield pa.RecordBatch.from_arrays(
                [pa.array([place(d) for d, _ in part]), pa.array([hash(t) % 1000 for _, t in part]),
                 pa.array([t or "" for _, t in part])], names=["did", "tkey", "text"])

    def repeated(parts):
        tables = {}
        for b in parts:
            for i in range(b.num_rows):
                tables.setdefault(b.column("part")[i].as_py(), []).append(b.slice(i, 1))
        out = set()
        for p in tables.values():
            t = substring_dedup.repeated_representatives(pa.Table.from_batches(p))
            for doc, k, hs in zip(*(t.column(c).to_pylist() for c in ("g_doc", "g_key", "hashes"))):
                out |= {(doc, k, h) for h in hs}
        return out

    whole = repeated(run(batches(1000)))
    monkeypatch.setattr(substring_dedup, "FLUSH", 30)
    assert repeated(run(batches(2))) == whole


def test_substrings_of_nothing(spark):
    assert substring_dedup.dedup_substrings(frame(spark, [])).collect() == []


def brute_lines(rows, min_lines, min_words):
    distinct = sorted(set(rows), key=lambda r: (place(r[0]), r[1] or ""))
    held = {(d, t): [x for x in (t or "").split("\n") if words(x)] for d, t in distinct}

    def later(n):
        first = {}
        for (d, _), ls in held.items():
            for s in range(len(ls) - n + 1):
                k = tuple(ls[s:s + n])
                first[k] = min(first.get(k, (place(d), s)), (place(d), s))
        return {(r, s) for r, ls in held.items() for s in range(len(ls) - n + 1)
                if first[tuple(ls[s:s + n])] < (place(r[0]), s)}

    gone = {r: set() for r in held}
    longest = dict.fromkeys(held, 0)
    n = 1
    while found := later(n):
        for r, s in found:
            longest[r] = n
            if n == 1 and min_lines > 1 and len(words(held[r][s])) >= min_words:
                gone[r].add(s)
            if n == min_lines:
                gone[r] |= set(range(s, s + n))
        n += 1
    out = []
    for r in rows:
        kept, s = [], 0
        for line in (r[1] or "").split("\n"):
            if words(line):
                if s not in gone[r]:
                    kept.append(line)
                s += 1
            else:
                kept.append(line)
        text = "\n".join(kept) if gone[r] else r[1]
        out.append((r[0], text, len(held[r]), len(gone[r]), longest[r]))
    return out


@pytest.mark.parametrize("min_lines,min_words", [(2, 5), (1, 1), (4, 3)])
def test_lines_like_brute_force(spark, min_lines, min_words):
    rows = awkward(9)
    d = line_dedup.delete_later_copies(frame(spark, rows), min_lines, min_words)
    assert d.columns == [*[c for c in frame(spark, rows).columns if c != "line_dedup"], "line_dedup"]
    got = [(r.doc_id, r.text, *r.line_dedup) for r in d.collect()]
    assert sorted(got, key=key) == sorted(brute_lines(rows, min_lines, min_words), key=key)


def test_lengths_of_copied_runs(spark, monkeypatch):
    """Runs of all lengths, of several earlier texts, that end at different lines."""
    monkeypatch.setattr(line_dedup, "WIDTH", 2)
    monkeypatch.setattr(line_dedup, "RANGES", 2)
    r = random.Random(11)
    base = [f"line {i}" for i in range(40)]
    rows = [(0, "\n".join(base)), (1, "\n".join([*base[:21], "x", *base[10:]]))]
    for i in range(2, 40):
        lines = []
        for _ in range(r.randint(1, 4)):
            a = r.randrange(40)
            lines += base[a:a + r.randint(1, 19)] + [f"own {r.randrange(6)}"] * r.randint(0, 2)
        rows.append((i, "\n".join(lines)))
    d = line_dedup.delete_later_copies(frame(spark, rows))
    assert sorted([(x.doc_id, x.text, *x.line_dedup) for x in d.collect()], key=key) == sorted(brute_lines(rows, 2, 1), key=key)
    coarse = line_dedup.delete_later_copies(frame(spark, rows), exact=False).collect()
    exact = {x.doc_id: x.line_dedup.longest for x in d.collect()}
    assert all(x.line_dedup.longest == (1 << exact[x.doc_id].bit_length() >> 1) for x in coarse)


def test_lines_of_nothing(spark):
    assert line_dedup.delete_later_copies(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        line_dedup.delete_later_copies(frame(spark, []), 3)


# SimHash ---------------------------------------------------------------------

def brute_fingerprint(text, n=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    best = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            best[r] = min(best.get(r, ids[i]), ids[i])
    return [best.get(find(i)) for i in range(n)]


def test_simhash_like_brute_force(spark):
    rows = awkward(11)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    ids, fps = [d for d, _ in rows], [brute_fingerprint(t) for _, t in rows]
    expected = list(zip(ids, fps, brute_components(ids, fps, 4)))
    assert sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], key=key) == sorted(expected, key=key)


def clusters(r, n):
    """Fingerprints in chains and balls around centres, and single ones."""
    out = [0, 1, (1 << 64) - 1, 1 << 63]
    while len(out) < n:
        x = r.getrandbits(64)
        out.append(x)
        for _ in range(r.randint(0, 12)):
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
            out.append(x)
    return out[:n]


@pytest.mark.parametrize("block", [1024, 8])
def test_links_in_buckets_and_blocks(spark, monkeypatch, block):
    """All links are found, also where buckets are dealt in blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(block)
    fps = sorted(set(clusters(r, 300) + [12345 ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    vertices = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.near_links(vertices)
    roots = {r.hi: r.root for r in simhash.components(edges).collect()}
    assert [roots.get(x, x) for x in signed] == brute_components(signed, fps, 4)


def test_wide_groups_as_matrices():
    r = random.Random(2)
    fps = np.array(clusters(r, 200), np.uint64)
    whole = simhash.links_of_block(fps, np.zeros(len(fps), np.int64), 4)
    few = simhash.links_of_block(fps[:simhash.WIDE], np.zeros(simhash.WIDE, np.int64), 4)

    def parts(n, edges):
        place = {int(x): i for i, x in enumerate(fps[:n])}
        a, b = (np.array([place[int(x)] for x in e], int) for e in edges)
        return len(simhash.forest(a, b, n)[0])
    for n, edges in ((len(fps), whole), (simhash.WIDE, few)):
        comp = brute_components(list(range(n)), [int(x) for x in fps[:n]], 4)
        distinct = len({int(x) for x in fps[:n]})
        assert n - parts(n, edges) - (n - distinct) <= len(set(comp)) <= distinct


def chunk_of(fp, chunks):
    """As near_links deals fingerprints of a big bucket (Spark's xxhash64 of a long)."""
    h = xxhash.xxh64_intdigest(fp.to_bytes(8, "little"), 42)
    return (h - (1 << 64) if h >> 63 else h) % chunks


def test_pairs_inside_a_chunk_of_a_big_bucket(spark):
    """Isolated pairs at 3 or 4 bits of the first segment, which meet in one
    bucket alone; it has several chunks, and both of a pair are in the same."""
    r, n = random.Random(7), 1100
    chunks = -(-2 * n // simhash.BLOCK)
    fps = np.zeros(0, np.uint64)
    while len(fps) < 2 * n:
        # at most two bits from the zero codeword: one key for segments 1 and 2
        a = r.getrandbits(22) | sum(1 << b for b in r.sample(range(22, 43), 2) + r.sample(range(43, 64), 2))
        b = a
        for bit in r.sample(range(22), r.choice([3, 4])):
            b ^= 1 << bit
        pair = np.array([a, b], np.uint64)
        keys = simhash.segment_keys(pair, 0)
        if chunk_of(a, chunks) == chunk_of(b, chunks) and not set(keys[0]) & set(keys[1]) and (
                np.bitwise_count(fps[:, None] ^ pair) > 4).all():
            fps = np.concatenate((fps, pair))
    bucket, _ = simhash.buckets(fps)
    assert (np.unique(bucket, return_counts=True)[1] > simhash.BLOCK).sum() == 1
    signed = fps.view(np.int64).tolist()
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()
    assert {(e.hi, e.lo) for e in edges} == {(max(p), min(p)) for p in zip(signed[::2], signed[1::2])}


@pytest.mark.parametrize("n", [20, 100])
def test_sides_are_decided_per_group(n):
    """A group of side 0 beside one of sides 1 and 2 keeps its links."""
    fps = np.array([x << 8 for x in range(n)] + [x << 40 for x in range(n)], np.uint64)
    group, side = np.repeat([1, 2], n), np.concatenate((np.zeros(n, np.int8), np.arange(n, dtype=np.int8) % 2 + 1))

    def links(rows, sides):
        return set(zip(*(x.tolist() for x in simhash.links_of_block(fps[rows], group[rows], 4, sides))))
    alone = links(slice(0, n), None)
    assert alone and alone <= links(slice(0, 2 * n), side)
    assert links(slice(n, n + 1), side[n:n + 1]) == set()


def test_golay_keys_meet():
    """Words that differ in at most two bits share a key."""
    rng = np.random.default_rng(4)
    w = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    for s, (first, bits) in enumerate(simhash.SEGMENTS):
        for _ in range(3):
            a, b = (np.uint64(first) + rng.integers(0, bits, len(w)).astype(np.uint64) for _ in range(2))
            v = w ^ (np.uint64(1) << a) ^ (np.uint64(1) << b)
            x, y = simhash.segment_keys(w, s), simhash.segment_keys(v, s)
            assert (x[:, :, None] == y[:, None, :]).any((1, 2)).all()


def test_golay_code_is_perfect():
    errors = simhash._corrections()
    assert (errors >= 0).all() and max(int(e).bit_count() for e in errors) == 3


def test_simhash_query_columns(spark, monkeypatch):
    rows = [(i, t) for i, t in awkward() if i is not None]
    monkeypatch.setattr(simhash, "documents", lambda spark, sf_dir: frame(spark, rows))
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_components(range(len(rows)), fps, 4)
    first = {}
    for g, (doc, _) in zip(groups, rows):
        first[g] = min(first.get(g, doc), doc)
    want = sorted((doc, f"{fp:016x}", first[g]) for (doc, _), fp, g in zip(rows, fps, groups))
    assert sorted(map(tuple, simhash.op10_simhash(spark, "").collect())) == want


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_digest_helpers():
    assert set(SPACES) == set(" \t\n\v\f\r")
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
