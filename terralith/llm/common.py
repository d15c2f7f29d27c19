"""Shared helpers of the text operators.

White space everywhere is the six bytes ``[\\x20\\x09-\\x0D]``. Those are exactly
what ``bytes.split``/``bytes.strip`` use, and ``bytes.lower`` maps A-Z only, so
the operators work on UTF-8 bytes and need no regular expressions.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache, wraps
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share.

    ``spark.checkpoint.dir`` names that folder. Only a session on one machine may do
    without it, as in tests: there a folder of the machine is set. On a cluster
    that would scatter the tables over the executors' disks, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/terralith-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later stages, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(work):
    """``work`` (of batches, of a key and its group, or of two groups), which gives its memory back at its end."""

    @wraps(work)
    def of_group(one, other):
        out = work(one, other)
        give_back()
        return out

    @wraps(work)
    def of_batches(batches):
        yield from work(batches)
        give_back()

    return of_batches if isgeneratorfunction(work) else of_group


def id_fold(column: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null id: -1)."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds)), F.lit(-1).cast("bigint"))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        at = b.schema.get_field_index("body")
        yield b.set_column(at, "body", pa.array([pack(x) for x in b.column(at).to_pylist()], pa.binary()))


def bodies(rows: pa.RecordBatch | pa.Table) -> list[bytes]:
    """The texts of rows that ``batched`` dealt."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in rows.column("body").to_pylist()]


def batched(docs: DataFrame, batch_bytes: int) -> tuple[DataFrame, int]:
    """Deal documents into batches of about ``batch_bytes`` of text by a hash of the row's place.

    ``docs`` must have the column ``body`` (binary) and be read from files, so that rows
    keep their places when a task is run again. Equal rows are dealt like any others.
    Texts travel compressed (``bodies`` gives them back). One shuffle; a query that reads
    the result several times reuses it.
    """
    total = docs.select(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-int(total) // batch_bytes))
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return dealt.mapInArrow(_compressed, dealt.schema).repartition(n, "batch"), n


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Each byte, A-Z lower-cased, plus one: so that a word of zero bytes isn't nothing.
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
HASH_BYTES = 1 << 20


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, where each begins): polynomials of their bytes, as differences of one running sum, then mixed."""
    size = max(HASH_BYTES, 1 << (len(raw) - 1).bit_length())
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate([[0] if inside[0] else [], edge, [len(raw)] if inside[-1] else []]).astype(np.int64)
    start, end = edge[::2], edge[1::2]
    upto = np.append(np.uint64(0), np.cumsum(_BYTE[raw] * _powers(_BASE, size)[: len(raw)], dtype=np.uint64))
    mixed = (upto[end] - upto[start]) * _powers(pow(_BASE, -1, 1 << 64), size)[start]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xC4CEB9FE1A85EC53)
    return mixed ^ (mixed >> np.uint64(32)), start


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of the texts, A-Z lower-cased; words of each text)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, starts, at = [], [], 0
    while at < len(raw):
        stop = min(at + HASH_BYTES, len(raw))
        # Up to white space, so that no word is cut; a longer word is taken whole.
        space = np.flatnonzero(_SPACE[raw[at:stop]])
        while not len(space):
            stop = min(stop + HASH_BYTES, len(raw))
            space = np.flatnonzero(_SPACE[raw[at:stop]])
        stop = at + int(space[-1]) + 1
        found, where = _word_hashes(raw[at:stop])
        hashes.append(found)
        starts.append(where + at)
        at = stop
    starts_ = np.concatenate([*starts, np.zeros(0, np.int64)])
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.diff(np.searchsorted(starts_, begins))


#: Text whose words are hashed at once.
RUN_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words; texts are hashed in runs of about a megabyte."""
    sizes = np.cumsum([0, *map(len, texts)]) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        hashes, n = hashed_words(texts[a:b])
        ends = np.cumsum(n)
        yield from (hashes[z - k : z] for z, k in zip(ends.tolist(), n.tolist()))


def hashed_shingles(own: np.ndarray, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    n = len(own) - shingle + 1
    if n < 1:
        shingle, n = len(own), 1
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = (out ^ own[k : k + n]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def environment_guard() -> None:
    """Tokenizer threads off: Spark already runs one worker per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
