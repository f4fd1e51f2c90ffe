"""Helpers shared by the operators: scratch tables in the cluster's shared
folder, sizes taken from the data, and vectorised word and shingle hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fairlane
from fairlane.session import checkpoint_dir

U64 = np.uint64
CHUNK_BYTES = 3 << 20           # text hashed at once inside a task
BATCH_BYTES = 32 << 20          # Arrow batch sent to a Python worker
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:                 # another C library: it keeps its own counsel
    _libc = None


def prepare(spark: SparkSession) -> None:
    """Make a session ready for the operators' Python tasks.

    Bounds the bytes of one Arrow batch, so that long texts can't fill a
    worker, and sends this package to the executors once per application.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(fairlane.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="fairlane-")) / "fairlane.zip"    # the driver serves it to the executors
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks it was running.
    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts: one cheap aggregate, used only to size partitions."""
    return docs.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


def parts_for(n_bytes: int, per_part: int, most: int = 1 << 22) -> int:
    """Number of hash partitions for ``n_bytes`` of data at ``per_part`` bytes each."""
    return int(min(most, max(8, -(-n_bytes // per_part))))


# ------------------------------------------------------------ word hashing

_rng = np.random.default_rng(20240611)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]                 # A-Z hash like a-z
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n + 1:
        with np.errstate(over="ignore"):
            for k, b in (("p", _BASE), ("i", _BASE_INV)):
                a = np.full(n + 1, b, U64)
                a[0] = 1
                _powers[k] = np.cumprod(a)
    return _powers["p"], _powers["i"]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(batches, col: str = "text", size: int = CHUNK_BYTES):
    """Cut record batches so that each holds about ``size`` bytes of ``col`` (a longer text stays whole)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = bytes_of(batch.column(col))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def release() -> None:
    """Give memory back at the end of a task, before the worker runs another stage's tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def word_spans(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = ASCII_SPACE, kinds: np.ndarray | None = None):
    """(start, end, text number) of every word; words never cross texts.

    ``breaks`` marks the bytes between words. With ``kinds`` a word also ends
    where a byte of kind 1 meets one of kind 2, in either order.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = breaks[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[off[:-1][off[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    if kinds is not None:
        k = kinds[data]
        meet = (k[1:] + k[:-1] == 3) & (k[1:] != 0) & (k[:-1] != 0)
        before[1:] |= meet
        after[:-1] |= meet
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(off[1:], start, "right")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word from prefix sums over the bytes (``fold``: A-Z as a-z)."""
    p, inv = _pow(len(data))
    with np.errstate(over="ignore"):
        pre = np.zeros(len(data) + 1, U64)
        np.cumsum((_FOLDED if fold else _LETTER)[data] * p[:len(data)], out=pre[1:])
        return mix((pre[end] - pre[start]) * inv[start])


def shingles(wh: np.ndarray, owner: np.ndarray, n_owners: int, k: int):
    """Distinct k-word shingle hashes of each owner, sorted: (hashes, n+1 offsets).

    An owner with fewer than k words has one shingle: its whole sequence.
    """
    count = np.bincount(owner, minlength=n_owners)
    first = np.concatenate(([0], np.cumsum(count)))
    with np.errstate(over="ignore"):
        m = max(0, len(wh) - k + 1)
        s = np.zeros(m, U64)
        for j in range(k):
            s = s * U64(0xD6E8FEB86659FD93) + wh[j:j + m]
        s = mix(s)
    out, sizes = [], np.zeros(n_owners, np.int64)
    for i in range(n_owners):
        c = count[i]
        if c >= k:
            u = np.unique(s[first[i]:first[i] + c - k + 1])
        elif c:
            x = U64(c)
            with np.errstate(over="ignore"):
                for h in wh[first[i]:first[i] + c]:
                    x = x * U64(0xA0761D6478BD642F) + h
            u = mix(np.array([x], U64))
        else:
            continue
        out.append(u)
        sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


def set_hash(sh: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """Order-free hash of each owner's set of shingles; 0 for an empty set."""
    out = np.zeros(len(off) - 1, U64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(sh ^ U64(seed)), off[:-1][some]) + np.diff(off)[some].astype(U64))
    return out


def long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def binaries(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary column over the bytes of ``buf`` cut at the item offsets ``off``."""
    buf = np.ascontiguousarray(buf)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * buf.itemsize).astype(np.int64)), pa.py_buffer(buf)]).cast(pa.binary())
