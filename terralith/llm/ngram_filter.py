"""Operator 10: language-model scores from a log-frequency Bloom filter.

Training counts words, word pairs and triples over all training documents. Counts
are quantised to levels (1, 2, 3, 4, 6, 8, 12, ... : two to an octave), and an
n-gram of level q is a member of the filter's levels 1 to q. Each level is a Bloom
filter laid out in segments by hash, filled by the tasks that hold a segment's
n-grams, and written. Each batch of documents sends its distinct n-grams to their
segments, which probe level after level until one doesn't know the n-gram, and
gets the levels back. An n-gram takes at most the level of those inside it, which
it can't be more frequent than; that undoes most false positives.

The model interpolates discounted shares of triples, pairs and words, all from the
filter's levels: with L and U the least and largest count of a level, D the discount,

    p(w | u v) = a3 max(L(uvw) - D, 0) / U(uv) + (1 - a3) p(w | v)
    p(w | v)   = a2 max(L(vw)  - D, 0) / U(v)  + (1 - a2) p(w)
    p(w)       =    max(L(w)   - D, 0) / N     + D V / (N (V + 1))

and the lower order alone after an unknown context. L is at most and U at least the
count, so the probabilities after a context sum to at most 1, but for what the
Bloom filters falsely know. N and V, and the counts of the base score, are exact.

No level is left out at any size: the filter is never gathered in one place (the
method's broadcast would grow with the corpus), and a segment covers
``SEGMENT_BYTES`` of text however large the corpus is.

Scale: an n-gram travels as 32 bits, sorted and in differences, which Spark's
compression brings to some 20: once per training task and some million tokens with its
count, once per batch there, and its level back. The texts are shuffled once, into
batches; exact counts move 12 to 16 bytes per batch and distinct word. A word or
n-gram that all documents hold is one entry per batch.

Edge cases: null and empty texts are the end token alone; rows without doc_id
are training rows and not held out; repeated rows count and score repeatedly;
without training documents all counts are 0 and the model is uniform over the
one unknown word; an empty table gives an empty result. Scores never depend on
doc_id, lang or source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.llm.common import batched, bodies, hashed_words, id_fold, text_bytes, written

FOLDS, HELD = 7, 2
ORDERS = 3
BATCH_BYTES = 8 << 20
#: Text of a segment of an order's hash space.
SEGMENT_BYTES = 16 << 20
#: Text of a training task that is counted at once.
FLUSH_BYTES = 12 << 20
BITS_PER_MEMBER = 8
#: Bits of the smallest filter: two hashes give places apart only where there are many.
LEAST_BITS = 4096
PROBES = 5
#: Shares of pairs and triples in the interpolation, and the discount of their counts.
SHARES = (0.4, 0.6)
DISCOUNT = 0.75
#: Hashes of the end token and of the places before a text.
END, BEGIN = np.uint64(1), np.uint64(2)
#: The least count of each level from 1 on, and the largest; level 0 has none.
LEAST = np.array([0, 1, 2, *(x << k for k in range(61) for x in (3, 4))], np.int64)
MOST = np.append(LEAST[1:] - 1, np.iinfo(np.int64).max)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def all_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words, each text's followed by the end token; tokens of each text)."""
    words, n = hashed_words(texts)
    out = np.full(len(words) + len(n), END)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(n + 1) - 1] = False
    out[kept] = words
    return out, n + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def ngram_hashes(own: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends in each token; texts of these lengths stand one after the other."""
    out = _mixed(own * _M3)
    first = np.cumsum(lengths) - lengths
    for back in range(1, order):
        before = np.empty_like(own)
        before[back:] = own[:-back]
        for k in range(back):
            inside = first[lengths > k] + k
            before[inside] = BEGIN
        out = _mixed(before * _M1 + out)
    return out


def places(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Hashes as the segment, which ranges of the hash space make, above 32 bits that sort alike."""
    n = np.uint64(segments)
    return (hashes >> _32) * n + ((hashes & _LOW) * n >> _32)


def _first(ordered: np.ndarray) -> np.ndarray:
    """Where values of a sorted array occur first."""
    return np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]])


def _pack(low: np.ndarray) -> bytes:
    """Rising 32-bit numbers as the byte planes of their differences, which compress."""
    gaps = np.diff(low, prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _by_segment(distinct: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, start, stop) of the segments that sorted places have."""
    segment = (distinct >> _32).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(segment[a]), a, b


def _send_counts(segments: int):
    """Rows (part, keys, counts) of the distinct n-grams of some million training tokens; a part is a segment of an order."""

    def flush(texts: list[bytes]) -> pa.RecordBatch:
        tokens, lengths = all_tokens(texts)
        rows = []
        for order in range(1, ORDERS + 1):
            ordered = np.sort(places(ngram_hashes(tokens, lengths, order), segments))
            starts = np.flatnonzero(_first(ordered))
            distinct, n = ordered[starts], np.diff(np.append(starts, len(ordered))).astype(np.uint32)
            low = distinct.astype(np.uint32)
            rows += [((order - 1) * segments + s, _pack(low[a:b]), n[a:b].tobytes()) for s, a, b in _by_segment(distinct)]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for b in batches:
            for text in b.column("body").to_pylist():
                texts.append(text)
                held += len(text)
                if held >= FLUSH_BYTES:
                    yield flush(texts)
                    texts, held = [], 0
        if texts:
            yield flush(texts)

    return send


def _probes(low: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of keys on a level, which give all their places there."""
    mixed = _mixed((low.astype(np.uint64) + np.uint64(level << 40 | 1)) * _M1)
    return mixed & _LOW, (mixed >> _32) | np.uint64(1)


def _place(start: np.ndarray, step: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (((start + np.uint64(probe) * step) & _LOW) * np.uint64(bits) >> _32).astype(np.int64)


def _fill(bits_per_member: int):
    """The levels of one part: (level, part, bits)."""

    def fill(key, table):
        members, level = _counted(table)
        out = []
        for k in range(1, int(level.max()) + 1):
            members, level = members[level >= k], level[level >= k]
            size = max(LEAST_BITS, -(-len(members) * bits_per_member // 64) * 64)
            bits = np.zeros(size, bool)
            start, step = _probes(members, k)
            for probe in range(PROBES):
                bits[_place(start, step, probe, size)] = True
            out.append({"level": k, "part": key[0].as_py(), "bits": np.packbits(bits).tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("level", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())]))

    return fill


def _counted(table) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of one part, level of each)."""
    keys = np.concatenate([_unpack(x) for x in table.column("keys").to_pylist()])
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(_first(keys))
    total = np.add.reduceat(counts[order], starts, dtype=np.int64)
    return keys[starts], np.searchsorted(LEAST[1:], total, side="right")


def known_levels(filled: list[dict], low: np.ndarray) -> np.ndarray:
    """The highest level of a part (rows level, bits) that knows each key, with all those below it; 0 if none does."""
    found = np.zeros(len(low), np.uint8)
    left = np.arange(len(low))
    for row in sorted(filled, key=lambda r: r["level"]):
        bits = np.frombuffer(row["bits"], np.uint8)
        start, step = _probes(low[left], row["level"])
        for probe in range(PROBES):
            at = _place(start, step, probe, len(bits) * 8)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            left, start, step = left[hit], start[hit], step[hit]
        if not len(left):
            break
        found[left] = row["level"]
    return found


def filter_table(texts: DataFrame, segment_bytes: int = SEGMENT_BYTES, bits_per_member: int = BITS_PER_MEMBER) -> tuple[DataFrame, int]:
    """The written filter (level, part, bits) of all n-grams of ``texts`` (body binary), and an order's number of segments."""
    total = texts.select(F.sum(F.octet_length("body"))).first()[0] or 0
    segments = max(1, -(-int(total) // segment_bytes))
    sent = texts.mapInArrow(_send_counts(segments), "part int, keys binary, counts binary")
    return written(sent.groupBy("part").applyInArrow(_fill(bits_per_member), "level int, part int, bits binary"), "filter"), segments


def _ask(segments: int):
    """Rows (part, batch, keys): the distinct n-grams of a batch."""

    def ask(key, docs):
        tokens, lengths = all_tokens(bodies(docs))
        parts, keys = [], []
        for order in range(1, ORDERS + 1):
            distinct = np.sort(places(ngram_hashes(tokens, lengths, order), segments))
            distinct = distinct[_first(distinct)]
            low = distinct.astype(np.uint32)
            for s, a, b in _by_segment(distinct):
                parts.append((order - 1) * segments + s)
                keys.append(_pack(low[a:b]))
        return pa.table({"part": pa.array(parts, pa.int32()), "batch": pa.array(np.full(len(parts), key[0].as_py()), pa.int32()), "keys": pa.array(keys, pa.binary())})

    return ask


def _answer(asked, filled):
    """The level of each asked n-gram of one part, in the order asked."""
    rows = filled.select(["level", "bits"]).to_pylist()
    keys = [_unpack(x) for x in asked.column("keys").to_pylist()]
    levels = known_levels(rows, np.concatenate(keys)) if keys else np.zeros(0, np.uint8)
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    back = [levels[a:z].tobytes() for a, z in zip(cuts, cuts[1:])]
    return pa.table({"batch": asked.column("batch"), "part": asked.column("part"), "levels": pa.array(back, pa.binary())})


def _send_words(shards: int):
    """Rows (shard, batch, words, n): a batch's distinct tokens, as the hashes of n-grams of one, and their count in its training documents."""

    def send(key, docs):
        tokens, lengths = all_tokens(bodies(docs))
        held = docs.column("held_out").to_numpy().astype(bool)
        own = ngram_hashes(tokens, lengths, 1)
        train = np.repeat(~held, lengths)
        every, known = np.sort(own), np.sort(own[train])
        every = every[_first(every)]
        starts = np.flatnonzero(_first(known))
        seen = np.zeros(len(every), np.uint32)
        seen[np.searchsorted(every, known[starts])] = np.diff(np.append(starts, len(known)))
        cuts = list(_by_segment(places(every, shards)))
        columns = ([s for s, _, _ in cuts], [key[0].as_py()] * len(cuts), [every[a:b].tobytes() for _, a, b in cuts], [seen[a:b].tobytes() for _, a, b in cuts])
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "batch", "words", "n"])

    return send


def _sum_words(key, table):
    """The counts over all batches of each batch's words of one shard, in the order sent; the first row has the shard's totals."""
    sent = table.column("words").to_pylist()
    words, inverse = np.unique(np.frombuffer(b"".join(sent), np.uint64), return_inverse=True)
    n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32)
    c = np.bincount(inverse, weights=n, minlength=len(words)).astype(np.int64)
    cuts = np.cumsum([0, *(len(x) // 8 for x in sent)]).tolist()
    back = [c[inverse[a:z]].tobytes() for a, z in zip(cuts, cuts[1:])]
    firsts = lambda x: pa.array([int(x), *[0] * (len(sent) - 1)], pa.int64())
    return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "c": pa.array(back, pa.binary()), "total": firsts(c.sum()), "distinct": firsts((c > 0).sum())})


def probabilities(levels: list[np.ndarray], lengths: np.ndarray, texts: int, total: int, distinct: int, shares=SHARES, discount: float = DISCOUNT) -> np.ndarray:
    """Of each token, from the levels (one array an order) of the n-grams that end in it; ``texts``: training texts."""
    first = np.cumsum(lengths) - lengths
    capped = [levels[0]]
    for own in levels[1:]:
        shorter = capped[-1]
        before = np.append(np.uint8(255), shorter[:-1])
        before[first] = 255
        capped.append(np.minimum(own, np.minimum(shorter, before)))
    if not total:
        return np.ones(len(levels[0]))
    p = np.maximum(LEAST[capped[0]] - discount, 0) / total + discount * distinct / (total * (distinct + 1))
    for order, share in enumerate(shares, 2):
        context = MOST[np.append(np.uint8(0), capped[order - 2][:-1])]
        context[first] = texts
        own = share * np.maximum(LEAST[capped[order - 1]] - discount, 0) / np.maximum(context, 1)
        p = np.where(context > 0, own + (1 - share) * p, p)
    return p


def _score(segments: int, train_texts: int, shares: tuple[float, ...], discount: float):
    def score(docs, found):
        answers = found.filter(found.column("levels").is_valid()).sort_by("part")
        part, sent = answers.column("part").to_numpy(), answers.column("levels").to_pylist()
        by_word = found.filter(found.column("c").is_valid()).sort_by("shard")
        counts = np.frombuffer(b"".join(by_word.column("c").to_pylist()), np.int64)
        total, distinct = (int(by_word.column(k)[0].as_py()) for k in ("all_total", "all_distinct"))
        tokens, lengths = all_tokens(bodies(docs))
        starts = np.cumsum(lengths) - lengths
        levels = []
        for k in range(ORDERS):
            a, b = np.searchsorted(part, [k * segments, (k + 1) * segments]).tolist()
            answer = np.frombuffer(b"".join(sent[a:b]), np.uint8)
            own = ngram_hashes(tokens, lengths, k + 1)
            # Places rise with the hashes, so one order serves the distinct places asked and the distinct words sent.
            by_hash = np.argsort(own)
            own = own[by_hash]
            level = np.empty(len(own), np.uint8)
            level[by_hash] = answer[np.cumsum(_first(places(own, segments))) - 1]
            levels.append(level)
            if k == 0:
                seen = np.empty(len(own), np.int64)
                seen[by_hash] = counts[np.cumsum(_first(own)) - 1]
            del own, by_hash
        p = probabilities(levels, lengths, train_texts, total, distinct, shares, discount)
        sums = [lengths, np.add.reduceat((seen > 0).astype(np.int64), starts), np.add.reduceat(np.log10((seen + 1) / (total + distinct + 1)), starts), np.add.reduceat(np.log10(p), starts)]
        columns = [pa.array(x, k) for x, k in zip(sums, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        trained = pa.array(np.full(len(docs), total), pa.int64())
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": columns[0], "n_known": columns[1], "train_tokens": trained, "base_score": columns[2], "score": columns[3]})

    return score


def scored(
    docs: DataFrame, shares: tuple[float, ...] = SHARES, discount: float = DISCOUNT, batch_bytes: int = BATCH_BYTES, segment_bytes: int = SEGMENT_BYTES, bits_per_member: int = BITS_PER_MEMBER
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = docs.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), text_bytes().alias("body"))
    train = rows.where("NOT held_out").select("body")
    filled, segments = filter_table(train, segment_bytes, bits_per_member)
    dealt, batches = batched(rows, batch_bytes)
    asked = dealt.groupBy("batch").applyInArrow(_ask(segments), "part int, batch int, keys binary")
    answered = asked.groupBy("part").cogroup(filled.groupBy("part")).applyInArrow(_answer, "batch int, part int, levels binary")
    sent = dealt.groupBy("batch").applyInArrow(_send_words(batches), "shard int, batch int, words binary, n binary")
    back = sent.groupBy("shard").applyInArrow(_sum_words, "batch int, shard int, c binary, total long, distinct long")
    whole = {f"all_{k}": back.agg(F.sum(k)).scalar() for k in ("total", "distinct")}
    back = back.withColumns(whole).unionByName(answered, allowMissingColumns=True)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"]])
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return dealt.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_score(segments, train.count(), shares, discount), schema)
