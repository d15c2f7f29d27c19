"""Operator 4: toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words of the examples, and those word beginnings of 4 to 7 letters
that occur in more toxic than other examples (chi-square). A term weighs its count
in the text times its idf times a small constant plus its relevance, which grows
with its chi-square; words that no example has count in the text's norm, and one
further term is the number of words, so that a direction also tells how dense
relevant words are. Where a text has relevant terms they decide what is near it, and
otherwise its other words do.

An inverted index holds each term's postings (entry, weight) in blocks of entries with
each block's largest weight. Frequent terms give all entries a score at first, many queries
at once in single precision; with the blocks' largest weights that bounds every block, and
blocks whose bound reaches the k-th of those scores are scored. Entries that may be among the
k nearest then get their cosines in double precision, so the search is exact. The votes of the k nearest entries, weighted by closeness, are calibrated by isotonic
regression on the examples themselves, each without the entry of its own text.

Examples are at most about ``MAX_EXAMPLES`` labelled documents outside the held
out fold, sampled by a hash; that bounds the vocabulary, the index and what is
broadcast (some tens of MB). Scoring is map-only over all documents, whole texts.

Edge cases: null and empty texts have no terms and get the calibrated share of
examples without any; unlabelled or null labels aren't examples; ids labelled
twice are toxic if any label says so; without examples all scores are 0;
repeated rows get equal scores, since the score depends on the text alone; ids may
be of any type; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import batched, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terralith.llm.common import id_fold, text_bytes, written

FOLDS, HELD = 4, 2
MAX_EXAMPLES = 6_000
#: Relevant terms are in so many examples at least, with such a chi-square at least.
MIN_DOCS, MIN_CHI = 6, 30.0
#: A relevance of one half.
HALF_CHI = 100.0
#: The weight of terms without relevance.
FLOOR = 0.02
PREFIXES = range(4, 8)
#: So many words weigh as much as one relevant term that all examples hold.
WORDS_PER_TERM = 50.0
NEIGHBOURS = 25
BLOCK = 64
#: Queries whose frequent terms are multiplied at once.
RUN = 64
#: More than single precision changes a product of unit vectors of less than 1,000 frequent terms, by 2^-24 of it a term.
SLACK = 1e-4
#: Terms that more of the entries hold have a place for every entry.
FREQUENT = 0.04
THRESHOLD = 0.3
REMEMBERED, REMEMBERED_TEXTS = 500_000, 20_000
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _bare(word: bytes) -> str:
    """A word without marks at its ends, in lower case."""
    return word.strip(_EDGES).decode("utf-8", "replace").lower()


def word_terms(word: bytes) -> list[str]:
    """The terms of a word: itself and its beginnings."""
    bare = _bare(word)
    return ["=" + bare, *(bare[:k] for k in PREFIXES if len(bare) >= k)] if bare else []


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, clean, toxic): the examples of a batch, of both labels, that have each term."""
    for b in batches:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(b.column("body").to_pylist(), b.column("toxic").to_pylist()):
            n[toxic > 0].update({t for w in set(text.lower().split()) for t in word_terms(w)})
        terms = sorted(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([n[k][t] for t in terms], pa.int64()) for k in (0, 1))], names=["term", "clean", "toxic"])


def vocabulary(examples: DataFrame) -> tuple[dict[str, int], np.ndarray, float]:
    """(number of each term, their weights per occurrence, weight of a word that no example has): all words, and relevant beginnings."""
    size = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)).alias("toxic")).first()
    n, share = size["n"], (size["toxic"] / size["n"] if size["n"] else 0.0)
    counted = examples.mapInArrow(_term_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, df = F.col("toxic").cast("double"), (F.col("toxic") + F.col("clean")).cast("double")
    spread = df * F.lit(share * (1 - share)) * (1 - df / F.lit(float(max(n, 1))) + 1e-9)
    chi = F.try_divide(F.pow(a - df * F.lit(share), 2), spread)
    relevant = (df >= MIN_DOCS) & (a > df * F.lit(share)) & (chi >= MIN_CHI)
    relevance = F.when(relevant, chi / (chi + HALF_CHI)).otherwise(0.0)
    kept = counted.select("term", df.alias("df"), F.coalesce(relevance, F.lit(0.0)).alias("relevance")).where(F.col("term").startswith("=") | (F.col("relevance") > 0)).orderBy("term").toArrow()
    weights = np.log(1 + n / kept.column("df").to_numpy()) * (FLOOR + kept.column("relevance").to_numpy()) if len(kept) else np.zeros(0)
    return {t: k for k, t in enumerate(kept.column("term").to_pylist())}, weights, math.log(1 + n) * FLOOR


class Terms(dict):
    """A code for each word, remembered: its term's number, ``UNKNOWN``, or for a word of several terms less; the number of words is the last term."""

    UNKNOWN = -1

    def __init__(self, numbers: dict[str, int], weights: np.ndarray, unknown: float):
        #: Keys are UTF-8, so that most words are looked up as they are.
        self.numbers, self.weights, self.unknown = {t.encode(): n for t, n in numbers.items()}, weights, unknown
        #: The first letters of the beginnings that are terms: few words have any.
        self.heads = {t[: PREFIXES[0]].encode() for t in numbers if t[0] != "="}
        #: Terms of the words with code -2, -3 and so on.
        self.several: list[tuple[int, ...]] = []

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_EDGES)
        if bare.isascii():
            head = bare[: PREFIXES[0]]
        else:
            bare = _bare(word)
            head, bare = bare[: PREFIXES[0]].encode(), bare.encode()
        if head in self.heads:
            code = self._several(tuple(self.numbers[t] for t in map(str.encode, word_terms(word)) if t in self.numbers))
        else:
            code = self.numbers.get(b"=" + bare, self.UNKNOWN)
        self[word] = code
        return code

    def _several(self, terms: tuple[int, ...]) -> int:
        if len(terms) < 2:
            return terms[0] if terms else self.UNKNOWN
        self.several.append(terms)
        return -1 - len(self.several)

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and TF-IDF weights of the unit vector; nothing for a text without words."""
        words = Counter(text.lower().split())
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        codes = self._codes(words)
        n = np.fromiter(words.values(), np.float64, len(words))
        more = np.flatnonzero(codes < self.UNKNOWN)
        found = [self.several[-2 - c] for c in codes[more].tolist()]
        known = codes >= 0
        flat = np.concatenate([codes[known], np.fromiter(chain.from_iterable(found), np.int64)])
        counts = np.concatenate([n[known], np.repeat(n[more], list(map(len, found)))])
        terms, inverse = np.unique(flat, return_inverse=True)
        weights = np.bincount(inverse, weights=counts, minlength=len(terms)) * self.weights[terms]
        unknown = float((n[codes == self.UNKNOWN] ** 2).sum())
        length = float(n.sum()) / WORDS_PER_TERM * math.log(2)
        norm = math.sqrt(float(weights @ weights) + unknown * self.unknown**2 + length * length)
        return np.append(terms, len(self.weights)), np.append(weights, length) / norm

    def _codes(self, words: Counter) -> np.ndarray:
        """The words' codes. All is forgotten between texts only, as codes below ``UNKNOWN`` are places."""
        if len(self) + len(words) > REMEMBERED:
            self.clear()
            self.several.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places from each start up to its stop, the number of the range each is of)."""
    n = stops - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n - starts, n), of


class BlockMaxIndex:
    """Postings of entries' unit vectors: by term, in blocks of entries, with each block's largest weight.

    The postings of terms that over ``FREQUENT`` of the entries hold are stored with a place for every entry.
    """

    def __init__(self, terms: np.ndarray, entries: np.ndarray, weights: np.ndarray, n_terms: int, n_entries: int):
        self.n_entries, self.n_blocks = n_entries, -(-n_entries // BLOCK)
        often = np.bincount(terms, minlength=n_terms) > FREQUENT * n_entries
        #: The row of a frequent term, -1 for others.
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        full = often[terms]
        #: The weights of each entry's frequent terms.
        self.whole = np.zeros((self.n_blocks * BLOCK, int(often.sum())))
        self.whole[entries[full], self.row[terms[full]]] = weights[full]
        #: The same by term in single precision; made where it is used, never sent.
        self.rough = None
        terms, entries, weights = terms[~full], entries[~full], weights[~full]
        order = np.lexsort((entries, terms))
        terms, self.entries, self.weights = terms[order], entries[order], weights[order]
        block = self.entries // BLOCK
        new = np.concatenate([np.ones(min(len(terms), 1), bool), (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])
        #: Of each block of a term's postings: where it begins (and the end of all), which block of entries, the largest weight.
        self.begins = np.append(np.flatnonzero(new), len(terms)).astype(np.int64)
        self.block = block[new]
        self.most = np.maximum.reduceat(self.weights, self.begins[:-1]) if len(terms) else np.zeros(0)
        #: Where each term's blocks begin, and the end of all.
        self.of_term = np.searchsorted(terms[new], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k nearest, nearest first, ties by place."""
        return next(self.nearest_of([(terms, weights)], k))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``nearest`` gives each of the queries, whichever they come with."""
        if self.rough is None:
            self.rough = np.ascontiguousarray(self.whole.T, np.float32)
        heavy = np.zeros((len(queries), len(self.rough)), np.float32)
        rows = [self.row.take(terms) for terms, _ in queries]
        for given, row, (_, weights) in zip(heavy, rows, queries):
            given[row[row >= 0]] = weights[row >= 0]
        slack = SLACK * max(1.0, len(self.rough) / 1000)
        for score, row, (terms, weights) in zip(heavy @ self.rough, rows, queries):
            often = row >= 0
            yield self._nearest(score, row[often], weights[often], terms[~often], weights[~often], k, slack)

    def _nearest(self, score: np.ndarray, rows: np.ndarray, heavy: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """``score``: about what the frequent terms give every entry. A block's bound is the most of that and of its other postings."""
        at, of = _ranges(self.of_term.take(terms), self.of_term.take(terms + 1))
        block, weight = self.block.take(at), weights.take(of)
        bounds = np.bincount(block, weights=weight * self.most.take(at), minlength=self.n_blocks) + score.reshape(-1, BLOCK).max(axis=1)
        reached = np.partition(score, -k)[-k] if len(score) > k else 0.0
        chosen = bounds >= reached - 2 * slack
        if not chosen.all():
            open_ = np.flatnonzero(chosen.take(block))
            at, weight = at.take(open_), weight.take(open_)
        starts, stops = self.begins.take(at), self.begins.take(at + 1)
        place, of = _ranges(starts, stops)
        rest = np.bincount(self.entries.take(place), weights=self.weights.take(place) * weight.take(of), minlength=len(score))
        about = score + rest
        reached = np.partition(about, -k)[-k] if len(about) > k else 0.0
        # Of the blocks left out no entry reaches that.
        maybe = np.flatnonzero(about >= reached - 2 * slack)
        exact = (self.whole[maybe[:, None], rows] * heavy).sum(axis=1) + rest[maybe]
        found = np.round(exact, 12)
        best = np.argsort(-found, kind="stable")[:k]
        best = best[found[best] >= 1e-12]
        return maybe[best], found[best]


class Classifier:
    """What scoring needs; bounded by the examples, small enough to broadcast."""

    def __init__(self, terms: Terms, rows: pa.Table):
        self.terms = terms
        sizes = np.array([len(x) for x in rows.column("terms")], np.int64)
        flat = rows.column("terms").combine_chunks().flatten().to_numpy() if len(rows) else np.zeros(0, np.int64)
        weights = rows.column("weights").combine_chunks().flatten().to_numpy() if len(rows) else np.zeros(0)
        # Entries next to each other share their heaviest term, so blocks differ.
        starts = np.cumsum(sizes) - sizes
        heaviest = np.array([flat[s : s + n - 1][np.argmax(weights[s : s + n - 1])] if n > 1 else -1 for s, n in zip(starts, sizes)], np.int64)
        order = np.lexsort((rows.column("text_key").to_numpy(), heaviest)) if len(rows) else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.seen: dict[int, tuple] = {}
        self.index = BlockMaxIndex(flat, np.repeat(place, sizes), weights, len(terms.weights) + 1, len(order))
        self.n, self.toxic, self.keys = (rows.column(c).to_numpy()[order] for c in ("n", "toxic", "text_key"))
        self.ids = rows.column("doc_id").take(pa.array(order)).to_pylist()

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], text_keys: list[int], k: int = NEIGHBOURS) -> Iterator[tuple[float | None, list]]:
        """For each query (terms, weights) the toxic share of the nearest entries' votes, leaving out the entry of the very same text, and the evidence."""
        for some in batched(zip(queries, text_keys), RUN):
            near = self.index.nearest_of([q for q, _ in some if len(q[0])], k + 1) if len(self.ids) else None
            for (terms, _), text_key in some:
                yield self._vote(*next(near), text_key, k) if near and len(terms) else (None, [])

    def _vote(self, place: np.ndarray, cosine: np.ndarray, text_key: int, k: int) -> tuple[float | None, list]:
        other = self.keys[place] != text_key
        place, cosine = place[other][:k], cosine[other][:k]
        if not len(place):
            return None, []
        # An entry votes by its label share; many examples of one text count by the root of their number.
        weight = np.sqrt(self.n[place]) / (1 - np.minimum(cosine, 1.0) + 0.02)
        evidence = [(self.ids[p], float(c)) for p, c in zip(place[:3].tolist(), cosine)]
        return float((weight * self.toxic[place] / self.n[place]).sum() / weight.sum()), evidence

    def scored(self, texts: list[bytes], text_keys: list[int]) -> list[tuple[float | None, list]]:
        """The votes on texts; those on some are remembered, for copies."""
        fresh = {k: t for t, k in zip(texts, text_keys) if k not in self.seen}
        found = {k: self.seen[k] for k in text_keys if k not in fresh}
        for keys in batched(fresh, RUN):
            found.update(zip(keys, self.votes([self.terms.vector(fresh[k]) for k in keys], list(keys))))
        if len(self.seen) + len(fresh) > REMEMBERED_TEXTS:
            self.seen.clear()
        self.seen.update((k, found[k]) for k in islice(fresh, REMEMBERED_TEXTS))
        return [found[k] for k in text_keys]


def calibrated(vote: float | None, curve: tuple[list[float], list[float]], blank: float) -> float:
    if vote is None or not curve[0]:
        return blank
    return min(1.0, max(0.0, curve[1][max(0, bisect_right(curve[0], vote) - 1)]))


def isotonic(votes: list[float], toxic: list[int], n: list[int]) -> tuple[list[float], list[float]]:
    """Starts and levels of the best rising step function through toxic / n (pool adjacent violators), with half a pseudo-count in each pool."""
    pools: list[list[float]] = []
    for vote, label, many in sorted(zip(votes, toxic, n)):
        if pools and pools[-1][0] == vote:
            pools[-1][1] += label
            pools[-1][2] += many
        else:
            pools.append([vote, label, many])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a, n = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += n
    return [p[0] for p in pools], [(p[1] + 0.25) / (p[2] + 0.5) for p in pools]


def _vectors(shared):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for b in batches:
            found = [terms.vector(t) for t in b.column("body").to_pylist()]
            kept = [b.column(c) for c in ("doc_id", "text_key", "toxic", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t for t, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float64()))], names=["doc_id", "text_key", "toxic", "n", "terms", "weights"])

    return vectors


def _votes(shared):
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            queries = [(t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(b.column("terms"), b.column("weights"))]
            found = [vote for vote, _ in shared.value.votes(queries, b.column("text_key").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), b.column("toxic"), b.column("n")], names=["vote", "toxic", "n"])

    return votes


def examples_of(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id (the least), text_key, body, toxic, n of the distinct texts of a bounded sample of the labelled documents outside the held out fold."""
    kind = dict(docs.dtypes)["doc_id"]
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(id_fold(F.col("doc_id"), FOLDS) != HELD).groupBy(F.col("doc_id").try_cast(kind).alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, max_examples / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), text_bytes().alias("body")).join(F.broadcast(sample), "doc_id")
    return written(rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("body").alias("body"), F.sum("toxic").cast("int").alias("toxic"), F.count("*").cast("int").alias("n")), "examples")


def fitted(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES):
    """(the broadcast index, calibration curve, score of texts without words); driver and workers hold vectors of the bounded sample only."""
    context = docs.sparkSession.sparkContext
    examples = examples_of(docs, labels, max_examples)
    terms = Terms(*vocabulary(examples))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_key long, toxic int, n int, terms array<long>, weights array<double>"
    vectors = written(examples.mapInArrow(_vectors(context.broadcast(terms)), schema), "vectors")
    some = vectors.where(F.size("terms") > 0)
    shared = context.broadcast(Classifier(terms, some.toArrow()))
    blank = vectors.where(F.size("terms") == 0).agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    votes = some.mapInArrow(_votes(shared), "vote double, toxic int, n int").where("vote IS NOT NULL").collect()
    curve = isotonic(*([r[c] for r in votes] for c in ("vote", "toxic", "n")))
    return shared, curve, (blank["toxic"] + 0.25) / (blank["n"] + 0.5) if blank["n"] else 0.0


def _scores(shared, curve, blank: float, kind: pa.DataType):
    entry = pa.list_(pa.struct([("doc_id", kind), ("cosine", pa.float64())]))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = model.scored(b.column("body").to_pylist(), b.column("text_key").to_pylist())
            score = pa.array([calibrated(vote, curve, blank) for vote, _ in found], pa.float64())
            evidence = pa.array([[{"doc_id": d, "cosine": c} for d, c in e] for _, e in found], entry)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), score, evidence], names=["doc_id", "score", "evidence"])

    return scores


def scored(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, score and evidence (the nearest examples' ids and cosines) of every document."""
    shared, curve, blank = fitted(docs, labels, max_examples)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), text_bytes().alias("body"))
    field = docs.schema["doc_id"].dataType
    return rows.mapInArrow(_scores(shared, curve, blank, to_arrow_type(field)), f"doc_id {field.simpleString()}, score double, evidence array<struct<doc_id: {field.simpleString()}, cosine: double>>")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op4 returns."""
    held = (id_fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    return scored(docs, labels).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
