"""Arrays in files of the shared folder, memory-mapped by the tasks that read
them, and compact blobs of numbers for rows that are shuffled.

A file is written by one attempt of a task under a name of its own, so a
retried or doubled task never touches another's; the path that Spark commits in
the task's output row is the file that counts.  The folder is that of
spark.checkpoint.dir, which all executors see.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs


def store_arrays(folder: str, arrays: dict[str, np.ndarray], compress: bool = False) -> str:
    """Writes the arrays to a new file of the folder and returns its path.
    Uncompressed files are mapped by readers without a copy."""
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().int >> 65:016x}.arrow"  # 63 random bits
    columns = {k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), pa.array(v)) for k, v in arrays.items()}
    batch = pa.RecordBatch.from_pydict(columns)
    options = pa.ipc.IpcWriteOptions(compression="zstd" if compress else None)
    with files.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return f"{folder}/{name}"


@contextmanager
def open_arrays(path: str):
    """The arrays of a file: memory-mapped where the shared folder is mounted,
    read through its file system where not."""
    files, name = pafs.FileSystem.from_uri(path)
    local = isinstance(files, pafs.LocalFileSystem)
    with (pa.memory_map(name) if local else files.open_input_file(name)) as source:
        batch = pa.ipc.open_file(source).get_batch(0)
        yield {k: batch.column(k).values.to_numpy() for k in batch.schema.names}


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as compressed planes of their bytes: numbers
    below 256^k take k bytes at most."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the values' sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return (keys[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values])
