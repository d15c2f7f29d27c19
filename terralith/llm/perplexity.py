"""Operator 9: quality classifier by an interpolated modified Kneser-Ney model.

The model is over the bytes of UTF-8, of order 5, so that it holds every script
without folding letters. It is trained on the trusted text: documents labelled
quality 1, all of which are used (a part is kept for the thresholds).
Counts, continuation counts, discounts and context masses are made part by part: a part
is a range of the 5-grams by the two symbols before their last one, which all their
n-grams and contexts of orders 5 to 3 have. Orders 2 and 1 have at most 2^18 n-grams
and go to every part.

Scoring: the documents are dealt into batches; each batch sends its distinct 5-grams
to their parts and gets their probabilities back, in order, to sum up each document's. What a
language's documents may reach at most is a quantile of its trusted documents'
perplexity, times a margin, drawn towards that of all languages as if ``SHRINK``
trusted documents had it; for that comparison every document's perplexity is
taken with PRIOR symbols of usual text added.

Scale: text is shuffled once, compressed in chunks, for learning and scoring; trusted ids
go to the batches of their documents. A part holds its distinct 5-grams of each batch, so a
hot 5-gram is one key a batch; parts and batches grow in number with the text.

Edge cases: null and empty texts are the end symbol alone; languages without
trusted documents take the limit over all languages; without any trusted text
all documents are kept; repeated rows are scored alike; an empty
table gives an empty result. The text is the only input of the score, the
language of the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.llm.common import lean, text_bytes, written

ORDER = 5
#: Bits of a symbol: a byte, the place before a text, or its end.
BITS = 9
START, END = 256, 257
#: The share of trusted documents kept for the thresholds.
HELD_SHARE = 0.25
#: The limit is this quantile of the trusted documents' perplexity, times the margin.
QUANTILE = 0.98
MARGIN = 1.15
#: Symbols of usual text that are added to each document before it is compared, so that short ones aren't judged by a few symbols.
PRIOR = 50
#: A language's limit is drawn to that of all languages by the weight of so many trusted documents.
SHRINK = 30
BATCH_BYTES = 16 << 20
#: Text that is compressed as one, and text whose 5-grams make one part of the tables.
CHUNK_BYTES, PART_BYTES = 256 << 10, 8 << 20
#: n-grams counted at once; a task holds some five times their eight bytes.
COUNTED_AT_ONCE = 1_000_000
_ONE, _PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: An odd number that spreads pairs of symbols over the parts, and its inverse.
_MIX = 0x2545F
_UNMIX = pow(_MIX, -1, 1 << 2 * BITS)
#: Bytes that hold a key, and a count.
KEY_BYTES, COUNT_BYTES = 6, 5
#: Places of kind and key in a fact.
_KIND, _COUNT = 58, 40


def symbols(text: bytes) -> np.ndarray:
    """The text's symbols, with ORDER - 1 starts before and one end after."""
    out = np.full(len(text) + ORDER, START, np.int64)
    out[ORDER - 1 : -1] = np.frombuffer(text, np.uint8)
    out[-1] = END
    return out


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends in each symbol of the text and in its end."""
    s = symbols(text)
    n = len(s) - ORDER + 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER - order, ORDER):
        out = (out << BITS) | s[k : k + n]
    return out


def keyed(found: np.ndarray) -> np.ndarray:
    """5-grams as keys: the two symbols before the last one, mixed, then the last, the second and the first.

    The longer orders' n-grams and contexts all have those two symbols, so a range of keys holds all that its 5-grams need.
    """
    pair = ((found >> BITS) & _PAIR) * _MIX & _PAIR
    return (pair << 3 * BITS) | (found & _ONE) << 2 * BITS | ((found >> 3 * BITS) & _ONE) << BITS | found >> 4 * BITS


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of the texts' 5-grams, how often each occurs)"""
    keys, n, parts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for k, text in enumerate(texts):
        parts.append(keyed(grams(text)))
        held += len(parts[-1])
        if held > COUNTED_AT_ONCE or k == len(texts) - 1:
            new, m = np.unique(np.concatenate(parts), return_counts=True)
            keys, n = merged([keys, new], [n, m])
            parts, held = [], 0
    return keys, n


def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    every, counts = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*n, np.zeros(0, np.int64)])
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    return every[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def _pack(keys: np.ndarray, width: int = KEY_BYTES) -> bytes:
    """Whole numbers of at most ``width`` bytes as compressed byte planes."""
    return zstandard.compress(keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def _unpack(packed: bytes, width: int = KEY_BYTES) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _by_part(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, stop) of the ranges of keys that sorted keys have."""
    part = (keys >> 3 * BITS) * parts >> 2 * BITS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(int(part[a]), a, z) for a, z in zip(cuts, cuts[1:])] if len(part) else []


def discounts(of_count: dict[int, int]) -> list[float]:
    """Discounts of n-grams seen once, twice, and more often (Chen and Goodman)."""
    n = [of_count.get(k, 0) for k in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 0.5 for k in range(3)]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _table(suffix: np.ndarray, context: np.ndarray, n: np.ndarray, d: list[float]) -> tuple:
    """(n-grams, their discounted shares of their contexts' counts, contexts, what those give to the next lower order)."""
    off = np.array(d)[np.minimum(n, 3) - 1]
    contexts, of = np.unique(context, return_inverse=True)
    total = np.bincount(of, weights=n, minlength=len(contexts))
    return suffix, (n - off) / total[of], contexts, np.bincount(of, weights=off, minlength=len(contexts)) / total


def _suffixes(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, context) of keys, from order 5 to 1."""
    pair, last = keys >> 3 * BITS, (keys >> 2 * BITS) & _ONE
    before = pair * _UNMIX & _ONE
    return [(keys, pair << 2 * BITS | keys & _PAIR), (keys >> BITS, pair << BITS | (keys >> BITS) & _ONE), (keys >> 2 * BITS, pair), (before << BITS | last, before), (last, np.zeros_like(last))]


def _orders(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, contexts, counts) of orders 5, 4 and 3 from a part's 5-grams, and of order 2 what the part adds to it: of lower orders, different n-grams count."""
    out = [(*_suffixes(keys)[0], n)]
    for k in (1, 2, 3):
        suffix, context = _suffixes(keys)[k]
        distinct, first, n = np.unique(suffix, return_index=True, return_counts=True)
        out.append((distinct, context[first], n))
        keys = keys[first]
    return out


def _of_count(n: np.ndarray) -> dict[int, int]:
    return {k: int((n == k).sum()) for k in range(1, 5)}


def _trained(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merged([np.cumsum(_unpack(x)) for x in rows.column("keys").to_pylist()], [_unpack(x, COUNT_BYTES) for x in rows.column("n").to_pylist()])


def _facts(key, trained):
    """What all parts need of one: (order, how often, n-grams of that count), and for order 2 (2, n-gram, count)."""
    *long, (pairs, _, n) = _orders(*_trained(trained))
    rows = [(ORDER - k, c, m) for k, (_, _, counts) in enumerate(long) for c, m in _of_count(counts).items()] + list(zip([2] * len(pairs), pairs.tolist(), n.tolist()))
    return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["kind", "key", "n"])


class Tables:
    """The model of a part's 5-grams: all of its orders 5 to 3, and orders 2 and 1 of the whole text, of which there are at most 2^18 n-grams."""

    def __init__(self, trained: pa.Table, facts: np.ndarray):
        kind, key, n = facts >> _KIND, (facts >> _COUNT) & _PAIR, facts & ((1 << _COUNT) - 1)
        long = _orders(*_trained(trained))[:3]
        self.tables = [_table(*rows, discounts({c: m for c, m in zip(key[kind == ORDER - k].tolist(), n[kind == ORDER - k].tolist())})) for k, rows in enumerate(long)]
        pairs, counts = merged([key[kind == 2]], [n[kind == 2]])
        self.tables.append(_table(pairs, pairs >> BITS, counts, discounts(_of_count(counts))))
        last, counts = np.unique(pairs & _ONE, return_counts=True)
        self.tables.append(_table(last, np.zeros_like(last), counts, discounts(_of_count(counts))))

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each 5-gram's probability."""
        p, weight = np.zeros(len(keys)), np.ones(len(keys))
        for (suffix, context), (grams_, kept, contexts, mass) in zip(_suffixes(keys), self.tables):
            p += weight * _looked_up(grams_, kept, suffix, 0.0)
            weight *= _looked_up(contexts, mass, context, 1.0)
        return np.log10(p + weight / (1 << BITS))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _chunks(batches_of: int):
    """(batch, rest, sizes, body): neighbouring texts compressed as one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts, places = b.column("body").to_pylist(), b.column("place").to_pylist()
            if not texts:
                continue
            full = np.cumsum([0, *map(len, texts)]) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(full[:-1])) + 1).tolist(), len(texts)]
            two = list(zip(cuts, cuts[1:]))
            offsets = pa.array(cuts, pa.int32())
            columns = [
                pa.array([xxhash.xxh64_intdigest(places[a].to_bytes(8, "little")) % batches_of for a, _ in two], pa.int32()),
                pa.ListArray.from_arrays(offsets, b.column("rest")),
                pa.ListArray.from_arrays(offsets, pa.array([len(t) for t in texts], pa.int32())),
                pa.array([pack(b"".join(texts[a:z])) for a, z in two], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "rest", "sizes", "body"])

    return chunks


def _texts(rows: pa.Table) -> list[bytes]:
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for body, sizes in zip(rows.column("body").to_pylist(), rows.column("sizes").to_pylist()):
        raw, at = unpack(body), 0
        for n in sizes:
            out.append(raw[at : at + n])
            at += n
    return out


def _rest(rows: pa.Table) -> pa.Array:
    return rows.column("rest").combine_chunks().flatten()


def dealt(docs: DataFrame, batch_bytes: int) -> tuple[DataFrame, int]:
    """(batch, rest, sizes, body) and the bytes of text: ``docs`` in batches of about ``batch_bytes``, chunk by chunk; ``rest`` has all columns but the text.

    ``docs`` is to be read from files, so that rows keep their places when a task is run again.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(text_bytes().alias("body"), rest, F.monotonically_increasing_id().alias("place"))
    total = int(rows.select(F.sum(F.octet_length("body"))).first()[0] or 0)
    n = max(1, -(-total // batch_bytes))
    schema = T.StructType().add("batch", "integer").add("rest", T.ArrayType(rows.schema["rest"].dataType)).add("sizes", T.ArrayType(T.IntegerType())).add("body", "binary")
    return rows.mapInArrow(lean(_chunks(n)), schema).repartition(n, "batch"), total


def _count(parts: int):
    """(part, keys, n): the 5-grams of a batch's documents whose ids are among ``ids``."""

    def count(rows, ids):
        texts, known = _texts(rows), pc.is_in(_rest(rows).field("doc_id"), value_set=ids.column("doc_id").combine_chunks()).to_pylist()
        keys, n = _distinct([t for t, k in zip(texts, known) if k])
        cuts = _by_part(keys, parts)
        columns = [pa.array([c[0] for c in cuts], pa.int32()), *(pa.array(v, pa.binary()) for v in ([_pack(np.diff(keys[a:z], prepend=0)) for _, a, z in cuts], [_pack(n[a:z], COUNT_BYTES) for _, a, z in cuts]))]
        return pa.table(columns, names=["part", "keys", "n"])

    return count


class Model:
    """What the model learns from: the documents of ``docs`` whose ids are in ``ids`` (doc_id)."""

    def __init__(self, docs: DataFrame, ids: DataFrame):
        self.docs, self.ids = docs, ids

    def counts(self, parts: int, batch_bytes: int) -> DataFrame:
        """(part, keys, n) of every batch. The text isn't joined: its ids are, and those that are trusted go to their batch."""
        rows, _ = dealt(self.docs, batch_bytes)
        own = rows.select("batch", F.explode("rest.doc_id").alias("doc_id")).join(self.ids, "doc_id", "left_semi").select(F.col("batch").alias("own"), "doc_id")
        return rows.groupBy("batch").cogroup(own.groupBy("own")).applyInArrow(lean(_count(parts)), "part int, keys binary, n binary")


def _ask(parts: int):
    """(part, batch, keys, facts): the distinct 5-grams of a batch."""

    def ask(key, rows):
        keys, _ = _distinct(_texts(rows))
        cuts = _by_part(keys, parts)
        columns = [pa.array([c[0] for c in cuts], pa.int32()), pa.array([key[0].as_py()] * len(cuts), pa.int32()), pa.array([_pack(np.diff(keys[a:z], prepend=0)) for _, a, z in cuts], pa.binary())]
        return pa.table([*columns, pa.nulls(len(cuts), pa.list_(pa.int64()))], names=["part", "batch", "keys", "facts"])

    return ask


def _answer(asked, trained):
    """(batch, part, logp) of the 5-grams asked of one part, in the order asked."""
    facts = asked.filter(pc.is_null(asked.column("batch"))).column("facts").combine_chunks().flatten().to_numpy()
    asked = asked.filter(pc.is_valid(asked.column("batch")))
    sent = [np.cumsum(_unpack(x)) for x in asked.column("keys").to_pylist()]
    keys, of = np.unique(np.concatenate([*sent, np.zeros(0, np.int64)]), return_inverse=True)
    found = Tables(trained, facts).logp(keys) if len(keys) else np.zeros(0)
    cuts = np.cumsum([0, *map(len, sent)]).tolist()
    return pa.table({"batch": asked.column("batch"), "part": asked.column("part"), "logp": pa.array([found[of[a:z]].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())})


def _score(docs, found):
    texts = _texts(docs)
    keys = _distinct(texts)[0]
    logp = np.frombuffer(b"".join(found.sort_by("part").column("logp").to_pylist()), np.float64)
    total, n = [], []
    for text in texts:
        g = keyed(grams(text))
        total.append(float(logp[np.searchsorted(keys, g)].sum()))
        n.append(len(g))
    return pa.table({"rest": _rest(docs), "n_symbols": pa.array(n, pa.int64()), "logprob": pa.array(total, pa.float64())})


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of all ids labelled quality 1; a hash of the id tells which are held back."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    at = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return good.select("doc_id", (at < HELD_SHARE).alias("held"))


def fitted(docs: DataFrame, ids: DataFrame) -> Model:
    """The model of the documents whose ids are in ``ids`` and aren't held back."""
    return Model(docs, ids.where("NOT held").select("doc_id"))


def scored(docs: DataFrame, model: Model, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``rest`` (a struct of the columns but the text), n_symbols and logprob of every document."""
    rows, total = dealt(docs, batch_bytes)
    parts = min(_PAIR + 1, max(1, -(-total // part_bytes)))
    counts = model.counts(parts, batch_bytes)
    facts = counts.groupBy("part").applyInArrow(lean(_facts), "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")
    one = F.shiftleft("kind", _KIND).bitwiseOR(F.shiftleft("key", _COUNT)).bitwiseOR(F.col("n"))
    every = facts.agg(F.collect_list(one).alias("facts")).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("int").alias("batch"), F.lit(None).cast("binary").alias("keys"), "facts")
    asked = rows.groupBy("batch").applyInArrow(lean(_ask(parts)), "part int, batch int, keys binary, facts array<long>").unionByName(every)
    back = asked.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(lean(_answer), "batch int, part int, logp binary")
    schema = T.StructType().add("rest", rows.schema["rest"].dataType.elementType).add("n_symbols", "long").add("logprob", "double")
    return rows.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(lean(_score), schema)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR) -> DataFrame:
    """doc_id, lang, text_key (a hash of the text), n_symbols, perplexity, smoothed_perplexity, max_perplexity, kept of every document."""
    ids = written(trusted_ids(labels), "trusted")
    slim = docs.select("doc_id", "lang", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    # Learning and scoring deal the same rows, so they share one shuffle of the text.
    found = written(scored(slim, fitted(slim, ids)).select("rest.*", "n_symbols", "logprob"), "logprob")
    held_ids = ids.where("held").select("doc_id")
    usual = (F.sum(-F.col("logprob")) / F.sum("n_symbols")).alias("usual")
    found = _with_language(found, found.join(held_ids, "doc_id", "left_semi"), usual, "usual")
    smooth = F.pow(F.lit(10.0), (prior * F.coalesce("usual", F.lit(0.0)) - F.col("logprob")) / (F.col("n_symbols") + prior))
    found = found.withColumns({"perplexity": F.pow(F.lit(10.0), -F.col("logprob") / F.col("n_symbols")), "smoothed_perplexity": smooth})
    limit = (F.percentile_approx("smoothed_perplexity", quantile, 10_000) * F.lit(margin)).alias("max_perplexity")
    out = _with_language(found, found.join(held_ids, "doc_id", "left_semi"), limit, "max_perplexity")
    kept = F.coalesce(F.col("smoothed_perplexity") <= F.col("max_perplexity"), F.lit(True))
    return out.select("doc_id", "lang", "text_key", "n_symbols", "perplexity", "smoothed_perplexity", "max_perplexity", kept.alias("kept"))


def _with_language(rows: DataFrame, held: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with an aggregate of their language's held-back documents, drawn to that of all by the weight of SHRINK documents."""
    whole = F.lit(held.agg(value).first()[0]).cast("double")
    own = held.groupBy("lang").agg(value, F.count("*").alias("n")).select(F.col("lang").alias("l_lang"), ((F.col("n") * F.col(name) + SHRINK * whole) / (F.col("n") + SHRINK)).alias("l_value"))
    joined = rows.join(own, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    return joined.withColumn(name, F.coalesce("l_value", whole)).drop("l_lang", "l_value")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, in the columns of ``docs``."""
    bad = judged(docs, labels).where("NOT kept").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    key = F.xxhash64(F.coalesce("doc.text", F.lit("")))
    left = whole.join(bad, F.col("doc.doc_id").eqNullSafe(F.col("bad_id")) & (key == F.col("bad_key")), "left_anti")
    return left.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op9 returns."""
    return judged(docs, labels).select("doc_id", "lang", "n_symbols", "perplexity", "smoothed_perplexity", "max_perplexity", "kept")
