"""Operator 11: alignment of two tokenizers through inverted bitmaps of id pairs.

A document's bytes are cut into tokens by tokenizer A and by tokenizer B. Where both end,
the last tokens of either side are linked, and the tokens between two such places are a group.
Documents are handled in chunks of some megabytes. A chunk keeps, for each id pair that it
links, compressed bitmaps of its documents: plane p holds the documents whose number of such
links has bit p. A bitmap is a list of 16-bit places, or bits once that is shorter. The
planes' OR has the documents of a pair, the planes' popcounts times 2^p its links; counts
of all chunks are summed. Then the bitmaps are read the other way, as postings: each pair's
score goes to the documents that its planes name, as often as they say.

Scale: texts are tokenized once, in a map-only pass that writes the chunks, and never move.
Pairs are dealt into ``SEGMENTS`` by hash. A pair that all documents link is one entry a
chunk, summed over ``CHUNKS`` chunks at a time and then over those sums; the scores of a segment
are sent to groups of as many chunks. What documents get back is one row a segment
and chunk. Distinct pairs, which the vocabularies limit, are all that a segment's scores hold;
the highest counts of B's ids, one number for each id of the vocabulary, go to all tasks.

Edge cases: a text that is null, empty, or whose tokens on either side don't give back its
bytes, has no tokens: zeros and an empty groups_sha256; equal texts and repeated rows count and
score each; ids may be null or repeated; an empty table gives an empty result. A very long text
is a chunk of its own, for which a task holds some 60 bytes a byte. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.llm.common import environment_guard, written

#: Names of public tokenizers, or paths: A, the same vocabulary as ranks (None: A serves all texts), and B.
TOKENIZER_A, RANKS_A, TOKENIZER_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A chunk's text and documents, and the text that is aligned at once.
CHUNK_BYTES, CHUNK_DOCS, RUN_BYTES = 8 << 20, 1 << 16, 1 << 20
SEGMENTS = 32
#: Chunks whose counts are summed at once, and that share a copy of a segment's scores.
CHUNKS = 256
#: Letters for which both libraries that read A surely split alike: Latin ones and common punctuation.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")
_SPACE = "▁"


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class Tokenizers:
    """Ids and the bytes of each id, of A and of B."""

    def __init__(self, a: str, ranks: str | None, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        environment_guard()
        self.slow = Tokenizer.from_file(_path(a))
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(_path(ranks), "rb") as lines:
                known = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=_path(b))
        letters = _byte_letters()
        self.bytes_a = [b""] * self.slow.get_vocab_size()
        for token, i in self.slow.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.pieces.vocab_size())]
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int32) for x in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of each text; none on either side where they don't give back its bytes."""
        out_a, out_b = [], []
        for text, own_b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            a = b = np.zeros(0, np.int32)
            if text:
                spaced = " " + text
                if self.fast is not None and not _OTHER.search(text):
                    own_a = self.fast.encode_ordinary(spaced)
                else:
                    own_a = self.slow.encode(spaced, add_special_tokens=False).ids
                whole = spaced.encode()
                if b"".join(map(self.bytes_b.__getitem__, own_b)) == whole and b"".join(map(self.bytes_a.__getitem__, own_a)) == whole:
                    a, b = np.array(own_a, np.int32), np.array(own_b, np.int32)
            out_a.append(a)
            out_b.append(b)
        return out_a, out_b


def _byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary means: printable Latin-1 is itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}


@lru_cache(2)
def tokenizers(a: str, ranks: str | None, b: str) -> Tokenizers:
    return Tokenizers(a, ranks, b)


@lru_cache(1)
def _written_ids(top: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as digits and one of the separators ``,|;`` (row number * 3 + separator), padded by zeros; and their lengths."""
    width = len(str(top - 1)) + 1
    number = np.arange(top)
    digits = np.char.encode(number.astype(str), "ascii")
    length = np.char.str_len(digits)
    out = np.zeros((top, 3, width), np.uint8)
    out[:] = np.frombuffer(digits.astype(f"S{width}").tobytes(), np.uint8).reshape(top, 1, width)
    for k, mark in enumerate(b",|;"):
        out[number, k, length] = mark
    return out.reshape(-1, width), np.repeat(length + 1, 3)


def align(a: list[np.ndarray], b: list[np.ndarray], lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of some documents' ids: (A's ids of all links, B's, number of links of each document, digest of each document's groups)."""
    n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
    ids_a, ids_b = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (a, b))
    ends_a, ends_b = np.cumsum(lengths_a[ids_a], dtype=np.int64), np.cumsum(lengths_b[ids_b], dtype=np.int64)
    met = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
    met[ends_a] = 1
    met[ends_b] += 1
    shut_a, shut_b = met[ends_a] == 2, met[ends_b] == 2
    groups = np.diff(np.append(0, np.cumsum(shut_a))[np.append(0, np.cumsum(n_a))])
    # Groups one after the other, A's ids before B's.
    last_a, last_b = np.flatnonzero(shut_a) + 1, np.flatnonzero(shut_b) + 1
    group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + np.append(0, last_b)[group_a]] = ids_a.astype(np.int64) * 3 + shut_a
    codes[np.arange(len(ids_b)) + last_a[group_b]] = ids_b.astype(np.int64) * 3 + 2 * shut_b
    table, length = _written_ids()
    text = table[codes].ravel()
    text = text[text != 0]
    cuts = np.append(0, np.cumsum(length[codes]))[np.append(0, np.cumsum(n_a + n_b))].tolist()
    digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]
    return ids_a[shut_a], ids_b[shut_b], groups, digests


def planes(pair: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(distinct pairs, for each plane: documents of each pair, places of short lists, bits of long ones) of a chunk's links."""
    key = np.sort((pair.astype(np.int64) << 16) | doc)
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    times, key = np.diff(np.append(starts, len(key))), key[starts]
    pairs, at = np.unique(key >> 16, return_inverse=True)
    place = (key & 0xFFFF).astype(np.uint16)
    out = []
    for p in range(int(times.max(initial=0)).bit_length()):
        held = np.flatnonzero(times >> p & 1)
        n = np.bincount(at[held], minlength=len(pairs))
        long = n > docs // 16
        in_long = long[at[held]]
        bits = np.zeros((int(long.sum()), -(-docs // 8) * 8), bool)
        bits[(np.cumsum(long) - 1)[at[held[in_long]]], place[held[in_long]]] = True
        out.append((n, place[held[~in_long]], np.packbits(bits, axis=1)))
    return pairs, out


def scores_of(block: dict, scores: np.ndarray) -> np.ndarray:
    """Sums over the links of each of a chunk's documents of the scores (a row a pair) of a block's pairs."""
    docs = block["docs"]
    out = np.zeros((docs, scores.shape[1]), np.int64)
    for p, (n, short, long) in enumerate(_planes_of(block)):
        is_long = n > docs // 16
        whose = np.repeat(np.flatnonzero(~is_long), n[~is_long])
        bits = np.unpackbits(long, axis=1, count=docs) if len(long) else np.zeros((0, docs), np.uint8)
        for k in range(scores.shape[1]):
            np.add.at(out[:, k], short, scores[whose, k] << p)
            out[:, k] += (scores[is_long, k] << p) @ bits.astype(np.int64) if len(bits) else 0
    return out


def _planes_of(block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    width = -(-block["docs"] // 8)
    for n, short, long in zip(block["counts"], block["short"], block["long"]):
        yield np.frombuffer(n, np.uint32).astype(np.int64), np.frombuffer(short, np.uint16), np.frombuffer(long, np.uint8).reshape(-1, width)


def counted(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """(documents, links) of each pair of a block: the OR of its planes counted, its planes counted."""
    docs, pairs = block["docs"], len(block["pairs"]) // 4
    links, once = np.zeros(pairs, np.int64), []
    merged: dict[int, np.ndarray] = {}
    for p, (n, short, long) in enumerate(_planes_of(block)):
        links += n << p
        is_long = n > docs // 16
        once.append((np.repeat(np.flatnonzero(~is_long), n[~is_long]) << 16) | short)
        for pair, bits in zip(np.flatnonzero(is_long).tolist(), long):
            merged[pair] = merged[pair] | bits if pair in merged else bits
    key = np.unique(np.concatenate([*once, np.zeros(0, np.int64)]))
    found = np.bincount(key >> 16, minlength=pairs)
    for pair, bits in merged.items():
        bits = np.unpackbits(bits, count=docs).astype(bool)
        bits[key[np.searchsorted(key, pair << 16) : np.searchsorted(key, (pair + 1) << 16)] & 0xFFFF] = True
        found[pair] = bits.sum()
    return found, links


_BLOCK = pa.schema([("docs", pa.int32()), ("pairs", pa.binary()), ("counts", pa.list_(pa.binary())), ("short", pa.list_(pa.binary())), ("long", pa.list_(pa.binary()))])
CHUNK_COLUMNS = "chunk long, place int, n_a long, n_b long, n_groups long, groups_sha256 string, segment int, docs int, pairs binary, counts array<binary>, short array<binary>, long array<binary>"


def _segment(pairs: np.ndarray, segments: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)


def _blocks(pair: np.ndarray, doc: np.ndarray, docs: int, segments: int) -> list[dict]:
    """A chunk's bitmaps by segment."""
    segment = _segment(pair, segments)
    out = []
    for s in np.unique(segment).tolist():
        own = segment == s
        pairs, found = planes(pair[own], doc[own], docs)
        n, short, long = zip(*found)
        out.append({"segment": s, "docs": docs, "pairs": pairs.astype(np.uint32).tobytes(), "counts": [x.astype(np.uint32).tobytes() for x in n], "short": [x.tobytes() for x in short], "long": [x.tobytes() for x in long]})
    return out


def _chunks(a: str, ranks: str | None, b: str, segments: int, chunk_bytes: int, id_type: pa.DataType):
    """Rows of two kinds: one a document, and one for each segment of a chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("segment", pa.int32()), *_BLOCK, ("doc_id", id_type)])

    def aligned(texts: list[str], known: Tokenizers):
        ids_a, ids_b = known.ids(texts)
        return (list(map(len, ids_a)), list(map(len, ids_b)), *align(ids_a, ids_b, known.lengths_a, known.lengths_b))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = tokenizers(a, ranks, b), TaskContext.get().partitionId() << 32
        rows, pair, doc, run, run_bytes, held = [], [], [], [], 0, 0

        def end_run():
            nonlocal run, run_bytes
            n_a, n_b, links_a, links_b, groups, digests = aligned([text for _, text in run], known)
            first = len(rows)
            pair.append((links_a.astype(np.uint32) << np.uint32(16)) | links_b.astype(np.uint32))
            doc.append(np.repeat(np.arange(first, first + len(run), dtype=np.uint16), groups))
            rows.extend({"chunk": chunk, "place": first + k, "doc_id": i, "n_a": x, "n_b": y, "n_groups": g, "groups_sha256": d} for k, ((i, _), x, y, g, d) in enumerate(zip(run, n_a, n_b, groups.tolist(), digests)))
            run, run_bytes = [], 0

        def end_chunk():
            nonlocal rows, pair, doc, held, chunk
            if run:
                end_run()
            found = [x | {"chunk": chunk} for x in _blocks(np.concatenate(pair), np.concatenate(doc), len(rows), segments)]
            out = pa.RecordBatch.from_pylist(rows + found, schema)
            rows, pair, doc, held, chunk = [], [], [], 0, chunk + 1
            return out

        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text").to_pylist()):
                run.append((i.as_py(), text))
                run_bytes += len(text)
                held += len(text)
                if run_bytes >= RUN_BYTES:
                    end_run()
                if held >= chunk_bytes or len(rows) + len(run) >= CHUNK_DOCS:
                    yield end_chunk()
        if rows or run:
            yield end_chunk()

    return chunks


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, documents, links) of rows (pairs, in_docs, links), summed."""
    pair, docs, links = (np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in (("pairs", np.uint32), ("in_docs", np.int64), ("links", np.int64)))
    pairs, at = np.unique(pair, return_inverse=True)
    out = np.zeros((2, len(pairs)), np.int64)
    np.add.at(out[0], at, docs)
    np.add.at(out[1], at, links)
    return pairs, *out


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [counted(x) for x in b.select(_BLOCK.names).to_pylist()]
        columns = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (zip(*found) if found else ((), ()))]
        yield pa.RecordBatch.from_arrays([b.column("segment"), b.column("salt"), b.column("pairs"), *columns], names=["segment", "salt", "pairs", "in_docs", "links"])


def _sum_counts(key, table):
    pairs, docs, links = _summed(table)
    rows = {"segment": [key[0].as_py()], "pairs": [pairs.tobytes()], "in_docs": [docs.tobytes()], "links": [links.tobytes()]}
    return pa.table([pa.array(v, pa.int32() if k == "segment" else pa.binary()) for k, v in rows.items()], names=list(rows))


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b_id, highest) of each row's pairs."""
    for batch in batches:
        for pairs, links in zip(batch.column("pairs").to_pylist(), batch.column("links").to_pylist()):
            b, n = np.frombuffer(pairs, np.uint32) & np.uint32(0xFFFF), np.frombuffer(links, np.int64)
            order = np.lexsort((n, b))
            last = np.append(np.flatnonzero(np.diff(b[order])), len(b) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(b[order][last].astype(np.int32)), pa.array(n[order][last])], names=["b_id", "highest"])


def _return(highest: np.ndarray):
    """What each chunk's documents get from one segment: (chunk, links of the highest count, counts)."""

    def back(blocks, scores):
        if not len(blocks):
            return pa.table({"chunk": pa.array([], pa.int64()), "best": pa.array([], pa.binary()), "sums": pa.array([], pa.binary())})
        row = scores.to_pylist()[0]
        pairs, links = np.frombuffer(row["pairs"], np.uint32), np.frombuffer(row["links"], np.int64)
        best = (links == highest[pairs & np.uint32(0xFFFF)]).astype(np.int64)
        out = []
        for block in blocks.to_pylist():
            at = np.searchsorted(pairs, np.frombuffer(block["pairs"], np.uint32))
            own = scores_of(block, np.stack([best[at], links[at]], axis=1))
            out.append((block["chunk"], own[:, 0].astype(np.int32).tobytes(), own[:, 1].tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "best", "sums"])

    return back


def _together(docs, sums):
    """A chunk's documents with the sums of what segments returned."""
    place = docs.column("place").to_numpy()
    best, total = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for x, y in zip(sums.column("best").to_pylist(), sums.column("sums").to_pylist()):
        best += np.frombuffer(x, np.int32)
        total += np.frombuffer(y, np.int64)
    columns = {k: docs.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups")} | {"n_links": docs.column("n_groups"), "n_best": pa.array(best[place]), "count_sum": pa.array(total[place])}
    return pa.table(columns | {"groups_sha256": docs.column("groups_sha256")})


class Alignment:
    """The tokenized corpus of ``docs`` (doc_id, text), its pairs and its documents' scores."""

    def __init__(self, docs: DataFrame, a: str = TOKENIZER_A, ranks: str | None = RANKS_A, b: str = TOKENIZER_B, segments: int = SEGMENTS, chunk_bytes: int = CHUNK_BYTES):
        from pyspark.sql.pandas.types import to_arrow_type

        self.kind = docs.schema["doc_id"].dataType
        schema = T.StructType.fromDDL(CHUNK_COLUMNS).add("doc_id", self.kind)
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        #: Documents and chunks' bitmaps, written in one pass.
        self.table = written(rows.mapInArrow(_chunks(a, ranks, b, segments, chunk_bytes, to_arrow_type(self.kind)), schema), "alignment")
        blocks = self.table.where("segment IS NOT NULL")
        chunks = blocks.agg(F.count_distinct("chunk")).first()[0]
        self.salts = max(1, -(-chunks // CHUNKS))
        self.blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(self.salts)).cast("int"))
        counts = "segment int, pairs binary, in_docs binary, links binary"
        partial = self.blocks.select("segment", "salt", *_BLOCK.names).mapInArrow(_count_blocks, "segment int, salt int, pairs binary, in_docs binary, links binary")
        #: A row a segment: its pairs (A's id in the high, B's in the low 16 bits) with their documents and links.
        self.counts = written(partial.groupBy("segment", "salt").applyInArrow(_sum_counts, counts).groupBy("segment").applyInArrow(_sum_counts, counts), "pairs")

    def highest(self) -> np.ndarray:
        """The highest count of each of B's ids: as many numbers as the vocabulary has ids, at most 2^16."""
        out = np.zeros(1 << 16, np.int64)
        for row in self.counts.select("pairs", "links").mapInArrow(_highest, "b_id int, highest long").groupBy("b_id").agg(F.max("highest").alias("n")).toLocalIterator():
            out[row["b_id"]] = row["n"]
        return out

    def pairs(self) -> DataFrame:
        """a_id, b_id, n_docs, n_links of every id pair that is linked anywhere."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    pairs = np.frombuffer(row["pairs"], np.uint32).astype(np.int64)
                    columns = (pairs >> 16, pairs & 0xFFFF, np.frombuffer(row["in_docs"], np.int64), np.frombuffer(row["links"], np.int64))
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a_id", "b_id", "n_docs", "n_links"])

        return self.counts.mapInArrow(each, "a_id long, b_id long, n_docs long, n_links long")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
        scores = self.counts.select("segment", "pairs", "links").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        returned = self.blocks.groupBy("segment", "salt").cogroup(scores.groupBy("segment", "salt")).applyInArrow(_return(self.highest()), "chunk long, best binary, sums binary")
        docs = self.table.where("segment IS NULL").select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
        out = T.StructType().add("doc_id", self.kind)
        for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
            out = out.add(name, "long")
        return docs.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInArrow(_together, out.add("groups_sha256", "string"))


def digest(docs: DataFrame) -> DataFrame:
    """What op11 returns."""
    return Alignment(docs).documents()
