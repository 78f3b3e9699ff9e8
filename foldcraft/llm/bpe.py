"""Byte-level BPE encoding and decoding with DuckDB inside the tasks.

Encoding.  A text is cut into pieces by the tokenizer's pattern; pieces that
are tokens themselves are done.  The others enter a recursive DuckDB query,
one token per byte at first: each step unfolds a word's tokens to rows (word,
position, token), joins neighbours with the merge table, finds the pair of
minimum rank (the leftmost of equals) and contracts it, until no word has a
pair left.  As a word is encoded alike wherever it stands, each task encodes
each distinct piece once and remembers a bounded number of them.

Decoding.  Rows (document, position, id) join the vocabulary and an ordered
aggregation concatenates the tokens' bytes.

A recursion's result holds every state of a word, tokens in proportion to the
square of its length; for pieces of more than KEYED bytes it is keyed by the
word and holds the last state alone.  The steps still take time in proportion
to that square, so a piece of more than LONGEST bytes (a run of kilobytes
without a border) goes through the same contraction over a heap of pairs.

Distribution.  Both directions work row by row and shuffle nothing.  The rank
file is read once by the driver and travels as a broadcast variable (its size
is that of the vocabulary, under 1 MB for 50,000 tokens); each task opens its
own DuckDB, with the merge table, and closes it at its end.  What a query holds
is bounded by PIECES, STEPS and IDS.

Defined results: null text is read as empty and has no ids; null ids decode
to empty; ids outside the vocabulary are an error, as no text has them;
special tokens are ordinary text; repeated rows are encoded each; columns
named like added ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import struct
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, text_of

KEYED, LONGEST = 256, 4096
#: of one encoding query: pieces, and the sum of their squared lengths, which
#: bounds what the recursion holds
PIECES, STEPS = 40_000, 4_000_000
#: ids of one decoding query
IDS = 150_000
#: characters and rows that are encoded at a time
CHARS, ROWS = 4 << 20, 2000
#: pieces that are remembered, twice: those of the time before stay until as
#: many new ones have come
REMEMBERED = 150_000

MERGES_SQL = """
CREATE TABLE merges AS
SELECT l.id::BIGINT << 32 | r.id::BIGINT AS pair, t.id::BIGINT AS merged
FROM (SELECT id, hex, unnest(generate_series(2, length(hex) - 2, 2)) AS cut FROM vocab) t
JOIN vocab l ON l.hex = substr(t.hex, 1, t.cut)
JOIN vocab r ON r.hex = substr(t.hex, t.cut + 1)
"""

#: words(w, toks) -> (w, toks): the contraction to the fixed point.  Each step
#: unfolds a word's tokens to rows (word, position), joins neighbours with the
#: merge table and contracts the word's pair of minimum rank; a merge's rank is
#: the id of the token it makes, and rank and position share one number, so its
#: minimum is the leftmost pair of minimum rank.  A finished word drops out.
#: With a key, a word's last state is all that is kept of it.
ENCODE_SQL = """
WITH RECURSIVE step(w, toks, live) {key} AS (
  SELECT w, toks, true FROM words
  {union}
  (WITH pairs AS (
     SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS spot FROM step WHERE live),
   best AS (
     SELECT p.w, min(m.merged << 20 | p.spot) AS pair
     FROM pairs p JOIN merges m ON m.pair = (p.l::BIGINT << 32 | p.r::BIGINT) GROUP BY p.w),
   found AS (SELECT s.w, s.toks, b.pair >> 20 AS merged, b.pair & 1048575 AS spot
     FROM step s LEFT JOIN best b ON b.w = s.w WHERE s.live)
   SELECT w, CASE WHEN spot IS NULL THEN toks
     ELSE list_concat(list_concat(toks[:spot - 1], [merged::INT]), toks[spot + 2:]) END, spot IS NOT NULL FROM found))
SELECT w, toks FROM step WHERE NOT live
"""

DECODE_SQL = """
SELECT i.doc, unhex(string_agg(v.hex, '' ORDER BY i.pos)) AS data
FROM ids i JOIN vocab v ON v.id = i.id GROUP BY i.doc
"""


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, of a file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}


class Codec:
    """One worker's vocabulary, DuckDB tables and remembered pieces."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(rank_file)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.bytes = None  # the single bytes' ids, once the merge table is there
        self.db = duckdb.connect(":memory:", config={
            "threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": False})
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()),
                          "hex": pa.array([t.hex() for t in self.ranks], pa.string())})
        self._load("CREATE TABLE vocab AS SELECT * FROM given", vocab)

    def close(self) -> None:
        self.db.close()
        self.known, self.before = {}, {}

    def _load(self, sql: str, table: pa.Table):
        self.db.register("given", table)
        self.db.execute(sql)
        self.db.unregister("given")

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not known yet."""
        todo: dict[bool, list[str]] = {False: [], True: []}
        steps = 0
        for piece in pieces:
            data = piece.encode()
            if (rank := self.ranks.get(data)) is not None:
                self.known[piece] = struct.pack("<I", rank)
            elif len(data) > LONGEST:
                ids = contract(data, self.ranks)
                self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            elif len(data) > KEYED:
                todo[True].append(piece)
            else:
                todo[False].append(piece)
                steps += len(data) ** 2
                if len(todo[False]) == PIECES or steps >= STEPS:
                    self._learn_by_query(todo[False], False)
                    todo[False], steps = [], 0
        for keyed, part in todo.items():
            for at in range(0, len(part), PIECES if not keyed else PIECES // 100):
                self._learn_by_query(part[at:at + (PIECES if not keyed else PIECES // 100)], keyed)

    def _learn_by_query(self, part: list[str], keyed: bool) -> None:
        if self.bytes is None:
            self.db.execute(MERGES_SQL)
            self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        data = [x.encode() for x in part]
        ends = np.cumsum([0] + [len(x) for x in data])
        toks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.bytes[np.frombuffer(b"".join(data), np.uint8)]))
        self._load("CREATE OR REPLACE TEMP TABLE words AS SELECT * FROM given",
                   pa.table({"w": pa.array(range(len(part)), pa.int32()), "toks": toks}))
        form = {"key": "USING KEY (w)", "union": "UNION"} if keyed else {"key": "", "union": "UNION ALL"}
        got = self.db.sql(ENCODE_SQL.format(**form)).to_arrow_table().combine_chunks()
        ids = got.column("toks").combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), 4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())
        for w, a, b in zip(got.column("w").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            self.known[part[w]] = flat[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        cut = [self.pieces.findall(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        every = set().union(*cut) - self.known.keys()
        again = every & self.before.keys()
        self.known.update((x, self.before[x]) for x in again)
        self.learn(every - again)
        known = self.known
        return [b"".join([known[x] for x in pieces]) for pieces in cut]

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        """Bytes of every array of ids."""
        out = [b""] * len(docs)
        at = 0
        while at < len(docs):
            end, n = at, 0
            while end < len(docs) and (end == at or n + len(docs[end]) <= IDS):
                n += len(docs[end])
                end += 1
            lens = [len(x) for x in docs[at:end]]
            ids = np.concatenate(docs[at:end]) if n else np.zeros(0, np.int32)
            if n and not 0 <= ids.min() <= ids.max() < len(self.ranks):
                raise ValueError("an id is not in the vocabulary")
            rows = pa.table({"doc": np.repeat(np.arange(at, end, dtype=np.int32), lens),
                             "pos": np.arange(n, dtype=np.int32), "id": ids.astype(np.int32)})
            self._load("CREATE OR REPLACE TEMP TABLE ids AS SELECT * FROM given", rows)
            got = self.db.sql(DECODE_SQL).to_arrow_table()
            for doc, data in zip(got.column("doc").to_pylist(), got.column("data").to_pylist()):
                out[doc] = data
            at = end
        return out


def contract(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long piece, with a heap of pairs."""
    n = len(data)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # token at i is data[i:end[i]]; end 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if end[i] == 0 or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for a in (prev[i], i):
            if a >= 0 and nxt[a] < n:
                b = end[nxt[a]]
                if (r := ranks.get(data[a:b])) is not None:
                    heapq.heappush(heap, (r, a, b))
    return [ranks[data[i:end[i]]] for i in range(n) if end[i]]


def _rank_broadcast(spark, rank_path: str):
    with open(rank_path, "rb") as f:  # a file of the installation, not of the store
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids",
           packed: str | None = "ids_le", data: str | None = None) -> DataFrame:
    """``docs`` with the column ``text`` replaced by the array ``ids``, the
    binary ``packed`` (the same as little-endian unsigned 32-bit integers) and
    the binary ``data``, the ids decoded again in the same pass; None leaves
    out one of the last two.  Columns of these names are replaced."""
    ranks = _rank_broadcast(docs.sparkSession, rank_path)
    docs = docs.drop(*[c for c in (ids, packed, data) if c and c != text])
    kept = [c for c in docs.columns if c != text]

    def run(batches):
        with closing(Codec(ranks.value, pattern)) as codec:
            for b in batches:
                for part in slices(b, text, CHARS, ROWS):
                    codes = codec.encode([x or "" for x in part.column(text).to_pylist()])
                    flat = np.frombuffer(b"".join(codes), np.int32)
                    ends = np.cumsum([0] + [len(x) // 4 for x in codes])
                    out = {c: part.column(c) for c in kept}
                    out[ids] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                    if packed:
                        out[packed] = pa.array(codes, pa.binary())
                    if data:
                        out[data] = pa.array(codec.decode([flat[i:j] for i, j in zip(ends[:-1], ends[1:])]), pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    new = {ids: F.array(F.lit(0))} | {c: F.lit(b"") for c in (packed, data) if c}
    return docs.mapInArrow(run, docs.select(*kept).withColumns(new).schema)


def decode(rows: DataFrame, rank_path: str, pattern: str, ids: str = "ids", data: str = "bytes",
           keep_ids: bool = False) -> DataFrame:
    """``rows`` with the column ``ids`` replaced by the binary ``data``, or
    followed by it; a column of that name is replaced."""
    ranks = _rank_broadcast(rows.sparkSession, rank_path)
    rows = rows.drop(*[c for c in (data,) if c != ids])

    def run(batches):
        with closing(Codec(ranks.value, pattern)) as codec:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    column = part.column(ids)
                    arrays = [column[i].values.to_numpy() if column[i].is_valid else np.zeros(0, np.int32)
                              for i in range(part.num_rows)]
                    keep = [c for c in part.schema.names if keep_ids or c != ids]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(codec.decode(arrays), pa.binary())],
                                                     names=[*keep, data])

    schema = (rows if keep_ids else rows.drop(ids)).withColumn(data, F.lit(b"")).schema
    return rows.mapInArrow(run, schema)


def op5_bpe(spark, sf_dir):
    """op5: token count and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    d = documents(spark, sf_dir).select("doc_id", text_of(F.col("text")).alias("text"))
    d = encode(d, path, pattern, data="bytes")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"),
                    F.sha2("bytes", 256).alias("decoded_sha256"))
