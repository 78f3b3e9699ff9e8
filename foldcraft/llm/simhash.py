"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has bit b set if bit b is set in more than half of
the XXH64 hashes (seed 42) of its word shingles.  Fingerprints link if they
differ in at most ``max_bits`` (4) of 64 bits; documents of linked
fingerprints form components.

Candidates.  A fingerprint is cut into three segments of 22, 21 and 21 bits,
padded with zeros to words of 23 bits.  The binary Golay code is perfect:
each 23-bit word has exactly one codeword within three bits.  A segment's
keys are the indices of the codewords of the word and of all its neighbours
at one bit: one key where the word lies within two bits of its codeword, six
otherwise.  Two segments that differ in at most two bits have a common key:
the word half way between them is a neighbour of both.  By pigeonhole, of
three segments that differ in at most four bits together at most one differs
in more than two; so two fingerprints that link share the keys of at least
one pair of segments.  Fingerprints are joined on (segment pair, key, key),
24 bits of key each, and every pair that meets is verified bit by bit.

Distribution.  Documents with one fingerprint are one vertex (an aggregate
with map-side combine), so exact copies cost nothing further.  Keys are
shuffled as (bucket, fingerprint); tasks walk their sorted buckets and compare
in blocks, and emit a spanning forest of the verified links of a bucket, never
all its pairs.  Buckets above ``BLOCK`` fingerprints are dealt in blocks: their
fingerprints are split in chunks and every pair of chunks is a task's block, so
no bucket is held by one task and no link is lost.  Components come from
alternating minimum and shortcut steps over stored tables, which join with
adaptive skew handling; each step's convergence check moves two numbers.

Defined results: null text is read as empty; texts without words have
fingerprint 0, linked like any other; rows repeated whole, or that share a
doc_id, are rows of one or of several vertices like any others; a null doc_id
never is a component's id unless no other is there; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents, text_key, text_of

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: fingerprints of one bucket that are compared in one block
BLOCK = 1024
#: a bucket with more fingerprints than this is compared as a matrix
WIDE = 64
#: (first bit, bits) of the segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code
GENERATOR = 0b110001110101
U = np.uint64


# fingerprints ------------------------------------------------------------

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's UTF-8 bytes."""
    words = text.lower().split()  # bytes: lower-cases A-Z alone, splits at [\x20\x09-\x0D]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:len(words) - k] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], U)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(U)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            text = b.column("text")
            fp = np.fromiter((fingerprint(text[i].as_py().encode(), shingle) for i in range(b.num_rows)), U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "tkey", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tkey, fp) of rows (doc_id, text); tkey is the text's hash, fp
    the unsigned fingerprint's bits in a long."""
    d = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    d = d.select("doc_id", text_key(F.col("text")).alias("tkey"), "text")
    return d.mapInArrow(_fingerprints(shingle), d.select("doc_id", "tkey", F.lit(0).cast("long").alias("fp")).schema)


# keys ----------------------------------------------------------------------

def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    w = words.astype(np.int64)
    for bit in range(22, 10, -1):
        w = np.where(w >> bit & 1, w ^ (GENERATOR << (bit - 11)), w)
    return w


@lru_cache(1)
def _corrections() -> np.ndarray:
    """The error pattern of three bits or fewer of every syndrome."""
    bits = 1 << np.arange(23)
    a, b, c = np.meshgrid(bits, bits, bits, indexing="ij")
    errors = np.unique(np.concatenate(([0], (a | b | c).ravel())))
    table = np.full(2048, -1, np.int64)
    table[_syndromes(errors)] = errors
    return table


def nearest_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within three bits of each 23-bit word."""
    return (words ^ _corrections()[_syndromes(words)]) >> 11


def segment_keys(fp: np.ndarray, segment: int) -> np.ndarray:
    """(n, 6) keys of a segment of the fingerprints, some repeated."""
    first, bits = SEGMENTS[segment]
    words = (fp >> U(first) & U((1 << bits) - 1)).astype(np.int64)
    distinct, back = np.unique(words, return_inverse=True)
    out = np.empty((len(distinct), 6), np.int64)
    flips = np.concatenate(([0], 1 << np.arange(23)))
    for at in range(0, len(distinct), 1 << 16):
        keys = np.sort(nearest_index(distinct[at:at + (1 << 16), None] ^ flips), axis=1)
        new = np.concatenate((np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
        part = np.repeat(keys[:, :1], 6, axis=1)
        row, col = np.nonzero(new)
        part[row, (np.cumsum(new, axis=1) - 1)[row, col]] = keys[row, col]
        out[at:at + len(keys)] = part
    return out[back]


def buckets(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in fp): the buckets of every fingerprint, each once."""
    keys = [segment_keys(fp, s) for s in range(3)]
    once = [np.concatenate((np.ones((len(fp), 1), bool), k[:, 1:] != k[:, :1]), axis=1) for k in keys]
    place, bucket = [], []
    for p, (i, j) in enumerate(PAIRS):
        both = once[i][:, :, None] & once[j][:, None, :]
        b = (p << 24) | (keys[i][:, :, None] << 12) | keys[j][:, None, :]
        at = np.nonzero(both)
        place.append(at[0])
        bucket.append(b[at])
    return np.concatenate(bucket), np.concatenate(place)


def _emit_buckets(batches):
    for b in batches:
        all_fp = b.column("fp").to_numpy().view(U)
        for at in range(0, len(all_fp), 4096):
            fp = all_fp[at:at + 4096]
            bucket, place = buckets(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array(fp[place].view(np.int64))], names=["bucket", "fp"])


# links ---------------------------------------------------------------------

def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest vertex of its component) of the graph on
    0..n-1 with the edges (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(root, before):
            child = np.flatnonzero(root != np.arange(n))
            return child, root[child]


def links_of_block(fp: np.ndarray, group: np.ndarray, max_bits: int, side: np.ndarray | None = None):
    """Forest edges (fp, fp) of the links inside the groups; rows come sorted
    by group.  With ``side``, rows of side 0 meet all rows of their group, and
    those of side 1 or 2 not the rows of their own side."""
    new = np.append(True, group[1:] != group[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    found_a, found_b = [], []
    # small groups together: each row meets the row d places on
    few = np.repeat(sizes <= WIDE, sizes) & (np.repeat(sizes, sizes) > 1)
    rows = np.flatnonzero(few)
    f, g = fp[rows], group[rows]
    for d in range(1, min(WIDE, len(rows))):
        same = np.flatnonzero(g[d:] == g[:-d])
        if not len(same):
            break
        if side is not None:
            one, two = side[rows[same]], side[rows[same + d]]
            same = same[(one != two) | (one == 0)]
        near = same[np.bitwise_count(f[same] ^ f[same + d]) <= max_bits]
        found_a.append(rows[near])
        found_b.append(rows[near + d])
    out = []
    if found_a:
        child, root = forest(np.concatenate(found_a), np.concatenate(found_b), len(fp))
        out.append((fp[child], fp[root]))
    # large ones alone, as matrices; labels sink to the smallest neighbour's
    for at, n in zip(starts[sizes > WIDE], sizes[sizes > WIDE]):
        f = fp[at:at + n]
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= max_bits
        if side is not None:
            own = side[at:at + n]
            near &= (own[:, None] != own[None, :]) | (own[:, None] == 0)
            np.fill_diagonal(near, True)
        label = np.arange(n, dtype=np.int32)
        while True:
            low = np.where(near, label[None, :], np.int32(n)).min(1)
            low = np.minimum(low, low[low])
            if np.array_equal(low, label):
                break
            label = low
        child = np.flatnonzero(label != np.arange(n))
        out.append((f[child], f[label[child]]))
    if not out:
        return fp[:0], fp[:0]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _edges(a, b) -> pa.RecordBatch:
    """Edges (hi, lo) with hi > lo as signed numbers, each once."""
    a, b = a.view(np.int64), b.view(np.int64)
    pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hi", "lo"])


def _link_buckets(max_bits: int):
    def run(batches):
        """Rows (group, fp[, side]) come sorted by group."""
        def flush(parts):
            group, fp, side = (np.concatenate(x) for x in zip(*parts))
            return _edges(*links_of_block(fp, group, max_bits, side if side.any() else None))

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            row = (b.column("grp").to_numpy(), b.column("fp").to_numpy().view(U), b.column("side").to_numpy())
            # hold back the last group, it may go on in the next batch
            last = int(np.searchsorted(row[0], row[0][-1], "left"))
            if last or (held and held[-1][0][-1] != row[0][0]):
                if last:
                    held.append(tuple(x[:last] for x in row))
                    yield flush(held)
                    held = [tuple(x[last:] for x in row)]
                else:
                    yield flush(held)
                    held = [row]
            else:
                held.append(row)
        if held:
            yield flush(held)
    return run


EDGES = "hi bigint, lo bigint"


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (hi, lo) over distinct fingerprints ``fps`` (column fp, stored)
    with the components of all pairs within ``max_bits`` bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the segments' keys meet for at most 4 bits")
    keyed = cut_lineage(fps.select("fp").mapInArrow(_emit_buckets, "bucket int, fp bigint"), "simhash-buckets")
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    big = cut_lineage(sizes.filter(F.col("n") > BLOCK).select(
        F.col("bucket").alias("b_bucket"), F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "simhash-big")
    side = F.lit(0).cast("byte")
    if big.isEmpty():
        small, blocks = keyed, None
    else:
        small = keyed.join(big, F.col("bucket") == F.col("b_bucket"), "left_anti")
        dealt = (keyed.join(big, F.col("bucket") == F.col("b_bucket"))
                 .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")))
        # chunk c meets every chunk d: block (min, max), side says which of the two
        dealt = dealt.select("bucket", "fp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        blocks = dealt.select(
            F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("grp"), "fp",
            F.when(F.col("chunk") < F.col("other"), 1).when(F.col("chunk") > F.col("other"), 2)
            .otherwise(0).cast("byte").alias("side"))

    def linked(rows, *order):
        return (rows.repartition("grp").sortWithinPartitions(*order)
                .mapInArrow(_link_buckets(max_bits), EDGES))

    out = linked(small.select(F.col("bucket").cast("long").alias("grp"), "fp", side.alias("side")), "grp")
    if blocks is not None:
        out = out.unionByName(linked(blocks, "grp"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(hi, root): the smallest vertex of the component of every vertex that
    is not itself the smallest.  ``edges`` are rows (hi, lo), hi > lo.

    Every round links the lower neighbours of a vertex to the lowest of them,
    then replaces each lower end by its own lowest neighbour.  Both keep the
    components; the fixed point is a star around each smallest vertex."""
    e = cut_lineage(edges.select("hi", "lo"), "components")
    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())
        if now == state or not now[0]:
            return e.select("hi", F.col("lo").alias("root"))
        state = now
        low = cut_lineage(e.groupBy("hi").agg(F.min("lo").alias("m")), "components-low")
        star = e.join(low, "hi").select(F.explode(F.when(F.col("lo") == F.col("m"), F.array(F.struct("hi", F.col("m").alias("lo"))))
                                                  .otherwise(F.array(F.struct("hi", F.col("m").alias("lo")),
                                                                     F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))).alias("x"))
        star = cut_lineage(star.select("x.hi", "x.lo").distinct(), "components-star")
        up = low.select(F.col("hi").alias("u_hi"), "m")
        e = cut_lineage(star.join(up, F.col("lo") == F.col("u_hi"), "left").select(
            "hi", F.coalesce("m", "lo").alias("lo")).distinct(), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, tkey, fp, root, component_id) of every row of ``docs``; root is
    the component's smallest fingerprint, component_id the smallest doc_id that
    can be reached over links (null if no row there has one, and not
    the component's alone where rows share a doc_id)."""
    fps = cut_lineage(fingerprints(docs, shingle), "simhash-fingerprints")
    vertices = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-vertices")
    roots = components(near_links(vertices, max_bits))
    v = vertices.join(roots, F.col("fp") == F.col("hi"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    v = cut_lineage(v, "simhash-roots")
    ids = cut_lineage(v.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ids")
    v = cut_lineage(v.join(ids, "root").select(F.col("fp").alias("v_fp"), "root", "component_id"), "simhash-components")
    return fps.join(v, F.col("fp") == F.col("v_fp")).select("doc_id", "tkey", "fp", "root", "component_id")


def op10_simhash(spark, sf_dir):
    """op10: fingerprint and component of every document."""
    d = near_duplicates(documents(spark, sf_dir))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
