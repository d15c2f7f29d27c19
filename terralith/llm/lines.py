"""Operator 2: line dedup through a sharded minimal perfect hash.

A line's key is the line stripped of white space with A-Z lower-cased, known by
its 64-bit hash. Documents are dealt into batches; each batch sends its distinct
line hashes, with the number of its documents that hold them, to the shards
of the hash space, packed as arrays. A shard indexes its distinct hashes by a
minimal perfect hash (bit arrays level by level, a rank over their ones) into
arrays of 32-bit fingerprints and 16-bit document counts. The batches' hashes
are probed against those arrays, and the ones at or over the limit go back to
their batch, where the lines are dropped. No line text ever moves.

Scale: the documents are shuffled once by a hash (both uses share it); 8 to 12
bytes travel per line and batch. A line that a third of all documents hold is
one entry per batch. Shards are sized by the input, so none outgrows a task.

Edge cases: null or empty text is one empty line; empty keys are never dropped;
repeated rows count as documents of their own; ids need be neither unique nor
set; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.llm.common import batched, bodies, lean, text_bytes

#: Keys found in so many documents lose all their lines.
MIN_DOCS = 10
#: Keys of fewer code points are kept.
MIN_CHARS = 1
BATCH_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: Bits per key of a level of the perfect hash.
GAMMA = 2
#: Levels after which the few keys left are listed in order.
LEVELS = 24
TOP = 65535
_ODD = np.uint64(0x9E3779B97F4A7C15)


def key_hash(line: bytes, min_chars: int = MIN_CHARS) -> int | None:
    """The hash of a line's key; None if the key is too short to be dropped."""
    key = line.strip().lower()
    if not key or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh64_intdigest(key)


def _spread(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = (keys ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) * _ODD
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed >> np.uint64(11)) % np.uint64(size)).astype(np.int64)


def _mark(keys: np.ndarray) -> np.ndarray:
    return ((keys * _ODD) >> np.uint64(32)).astype(np.uint32)


class LineIndex:
    """Document counts by line hash: a minimal perfect hash, fingerprints, counts."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray, marks: np.ndarray, counts: np.ndarray):
        self.levels, self.rest, self.marks, self.counts = levels, rest, marks, counts
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + n)
            n += int(bits.sum())
        self.n = n

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> LineIndex:
        """``keys``: distinct unsigned 64-bit hashes."""
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            size = GAMMA * len(left) + 64
            at = _spread(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        index = cls(levels, np.sort(left), np.zeros(0, np.uint32), np.zeros(0, np.uint16))
        place = index.places(keys)
        index.marks, index.counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint16)
        index.marks[place] = _mark(keys)
        index.counts[place] = np.minimum(counts, TOP)
        return index

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; of keys outside the index any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = _spread(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.n + at[hit]
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 where the fingerprint differs."""
        place = self.places(keys)
        known = place >= 0
        known[known] = self.marks[place[known]] == _mark(keys[known])
        return np.where(known, self.counts[np.where(known, place, 0)] if len(self.counts) else 0, 0)

    def row(self) -> dict:
        return {"levels": [np.packbits(b).tobytes() for b in self.levels], "sizes": [len(b) for b in self.levels], "rest": self.rest.tobytes(), "marks": self.marks.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def of(cls, row: dict) -> LineIndex:
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(row["levels"], row["sizes"])]
        return cls(levels, *(np.frombuffer(row[k], t) for k, t in (("rest", np.uint64), ("marks", np.uint32), ("counts", np.uint16))))


INDEX_SCHEMA = "shard int, levels array<binary>, sizes array<long>, rest binary, marks binary, counts binary"
_INDEX = pa.schema([("shard", pa.int32()), ("levels", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("rest", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary())])


def _send(shards: int, min_chars: int):
    """Rows (shard, batch, keys, docs): distinct line hashes of a batch and the documents that hold each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("batch").to_numpy()
            by: dict[int, list[int]] = {}
            for n, text in zip(number.tolist(), bodies(b)):
                found = {key_hash(line, min_chars) for line in text.split(b"\n")}
                found.discard(None)
                by.setdefault(n, []).extend(found)
            out: list[list] = [[], [], [], []]
            for n, hashes in by.items():
                keys, docs = np.unique(np.array(hashes, np.uint64), return_counts=True)
                shard = _shard(keys, shards)
                # Only shards that the batch has lines of, however many there are.
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)] if len(keys) else [0]
                for lo, hi in zip(cuts, cuts[1:]):
                    for column, value in zip(out, (int(shard[lo]), n, keys[lo:hi].tobytes(), docs[lo:hi].astype(np.uint32).tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["shard", "batch", "keys", "docs"])

    return send


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash space, so sorted keys have sorted shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _index(key, table):
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.uint32)
    distinct, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, weights=docs, minlength=len(distinct)).astype(np.int64)
    return pa.Table.from_pylist([{"shard": key[0].as_py(), **LineIndex.build(distinct, counts).row()}], schema=_INDEX)


def _probe(min_docs: int):
    def probe(sent, index):
        batch, gone = [], []
        arrays = LineIndex.of(index.to_pylist()[0]) if len(index) else None
        for n, raw in zip(sent.column("batch").to_pylist(), sent.column("keys").to_pylist()) if arrays else ():
            keys = np.frombuffer(raw, np.uint64)
            over = keys[arrays.count(keys) >= min_docs]
            if len(over):
                batch.append(n)
                gone.append(over.tobytes())
        return pa.table({"batch": pa.array(batch, pa.int32()), "gone": pa.array(gone, pa.binary())})

    return probe


def keep_lines(text: bytes, gone: set[int], min_chars: int = MIN_CHARS) -> tuple[int, int, bytes]:
    """(lines, dropped lines, text of the others)"""
    lines = text.split(b"\n")
    kept = [x for x in lines if key_hash(x, min_chars) not in gone] if gone else lines
    return len(lines), len(lines) - len(kept), text if len(kept) == len(lines) else b"\n".join(kept)


def _drop(min_chars: int):
    def drop(docs, gone):
        hashes = set(np.frombuffer(b"".join(gone.column("gone").to_pylist()), np.uint64).tolist())
        rows = [keep_lines(t, hashes, min_chars) for t in bodies(docs)]
        lines, dropped, kept = zip(*rows) if rows else ((), (), ())
        return pa.table({"rest": docs.column("rest"), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return drop


def sent_lines(dealt: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    return dealt.mapInArrow(lean(_send(shards, min_chars)), "shard int, batch int, keys binary, docs binary")


def line_index(sent: DataFrame) -> DataFrame:
    """One row per shard: the arrays of its perfect hash (see INDEX_SCHEMA)."""
    return sent.groupBy("shard").applyInArrow(lean(_index), INDEX_SCHEMA)


def without_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``rest`` (a struct of the other columns), n_lines, n_dropped and kept (bytes) of every document."""
    if not 1 <= min_docs <= TOP:
        raise ValueError(f"min_docs must be from 1 to {TOP}")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(text_bytes().alias("body"), F.struct(*others, F.col("text").isNull().alias("text_is_null")).alias("rest"))
    dealt, batches = batched(rows, batch_bytes)
    sent = sent_lines(dealt, max(1, batches * batch_bytes // shard_bytes), min_chars)
    gone = sent.groupBy("shard").cogroup(line_index(sent).groupBy("shard")).applyInArrow(lean(_probe(min_docs)), "batch int, gone binary")
    schema = T.StructType([rows.schema["rest"]]).add("n_lines", "long").add("n_dropped", "long").add("kept", "binary")
    return dealt.groupBy("batch").cogroup(gone.groupBy("batch")).applyInArrow(lean(_drop(min_chars)), schema)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines of frequent keys, in the same columns; n_chars follows the text, null texts stay null."""
    kept = without_lines(docs, min_docs, min_chars)
    text = F.when(F.col("rest.text_is_null"), F.lit(None)).otherwise(F.col("kept").cast("string"))
    new = {"text": text, "n_chars": F.char_length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return kept.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """What op2 returns."""
    kept = without_lines(docs.select("doc_id", "text"))
    return kept.select("rest.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM texts
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS}
), kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM keyed WHERE k NOT IN (SELECT k FROM frequent) GROUP BY r
)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
