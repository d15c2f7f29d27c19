"""Operator 12: exact Jaccard join of word shingles by adaptive multi-match prefixes.

A document's tokens are the 64-bit hashes of its distinct word shingles, in the order
(documents that hold the token, hash). Two sets whose Jaccard similarity reaches the
limit s share at least max(t, t') tokens, t = ceil(s |set|). So for every l both
l-prefixes, the first |set| - t + l tokens, share at least l tokens: the l-th common
token has t - l common ones behind it. Each document takes the l of the least estimated
cost: an index hit for every other document of its prefix's tokens, and a comparison for
every l hits. Prefixes contain the shorter ones, so a pair is compared if the prefixes
share at least the smaller l of its two documents.

Counts of all tokens come from the corpus: batches send their distinct tokens as sorted
32-bit keys to the segments of the hash space and get the counts back. Tokens of one
document only, which most are, can't be shared: they take places of the prefix but
are never indexed or compared.

Groups of near copies would make all pairs. So at first each document meets only the
most central one of every bucket. That gives links, and clusters of documents around
a centre (``NEAR`` percent). Then pairs that aren't joined yet are sought: those of
different clusters by their tokens, those inside a cluster cell by cell (``CELL`` documents
against as many) with the same prefixes in numpy, where a cell pair returns at most one
link a document. Clusters of one component are skipped. No pair of similar documents is
left out: what isn't compared lies in one component already.

Scale: texts are shuffled once, compressed and without the copies that a task sees; a token
that all documents hold is one key a batch. The part left quadratic is a cluster whose members
are not similar to its centre: its cells are compared, a group of m documents in
(m / CELL)^2 / 2 independent tasks.

Edge cases: a null or empty text, or one without words, has no shingles and is linked with
nothing; of fewer words than a shingle the whole sequence is the one shingle; equal texts
and repeated rows are one class; component_id is null only where all ids of the component
are; an empty table gives an empty result. A very long text is held as some 30 bytes a word
by the task that reads it. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.llm.common import bodies, hashed_shingles, lean, text_bytes, words_of, written
from terralith.llm.graph import components
from terralith.llm.ngram_filter import _by_segment, _first, _pack, _unpack, places

SHINGLE, PERCENT = 5, 80
#: Similarity, in percent, to a centre that makes a cluster. Low, since copies of a group that lie far from its centre
#: on different sides share tokens with all the others; it decides where pairs are compared, never whether.
NEAR = 30
#: Documents of a cell.
CELL = 256
#: The longest prefix takes so many tokens more than the shortest.
LONGEST = 16
#: A comparison costs as much as so many index hits per token of the set.
COMPARE = 0.25
BATCH_BYTES, SEGMENT_BYTES = 8 << 20, 8 << 20


def needed(n, percent: int = PERCENT):
    """The least number of tokens a set of n shares with any similar one."""
    return -(-n * percent // 100)


def _digest(text: bytes) -> bytes:
    return xxhash.xxh128_digest(b" ".join(text.lower().split()))


@F.pandas_udf(T.BinaryType())
def same_words(texts: pd.Series) -> pd.Series:
    """The digest of each text's words (UTF-8): equal where texts differ in white space and in A-Z's case only."""
    return texts.map(_digest)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = pa.array([_digest(t) for t in b.column("body").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), same], names=["doc_id", "same"])


def _texts(parts: int):
    """(batch, same, body): each text that the task hasn't seen yet, compressed."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for b in batches:
            rows = []
            for text in b.column("body").to_pylist():
                same = _digest(text)
                if same not in seen:
                    seen.add(same)
                    rows.append((xxhash.xxh64_intdigest(same) % parts, same, pack(text)))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["batch", "same", "body"])

    return texts


def _sets(rows: pa.Table, shingle: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(class, tokens of all classes one after the other, number of each) of a batch's distinct texts."""
    same = rows.column("same").to_pylist()
    first = list({s: k for k, s in reversed(list(enumerate(same)))}.values())
    first.sort()
    texts = bodies(rows.take(pa.array(first, pa.int64())))
    found = [hashed_shingles(w, shingle) if len(w) else np.zeros(0, np.uint64) for w in words_of(texts)]
    return [same[k] for k in first], np.concatenate([*found, np.zeros(0, np.uint64)]), np.array([len(x) for x in found], np.int64)


def _planes(n: np.ndarray) -> bytes:
    return n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _ask(segments: int, shingle: int):
    """Rows (part, batch, keys, n): the distinct tokens of a batch and how many of its classes hold each."""

    def ask(key, rows):
        ordered = np.sort(places(_sets(rows, shingle)[1], segments))
        starts = np.flatnonzero(_first(ordered))
        distinct, n = ordered[starts], np.diff(np.append(starts, len(ordered)))
        low = distinct.astype(np.uint32)
        cuts = list(_by_segment(distinct)) if len(distinct) else []
        columns = ([s for s, _, _ in cuts], [key[0].as_py()] * len(cuts), [_pack(low[a:z]) for _, a, z in cuts], [_planes(n[a:z]) for _, a, z in cuts])
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "batch", "keys", "n"])

    return ask


def _answer(key, table):
    """The counts over all batches of each batch's keys of one segment, in the order sent."""
    sent = [_unpack(x) for x in table.column("keys").to_pylist()]
    cuts = np.cumsum([0, *map(len, sent)]).tolist()
    keys = np.concatenate(sent)
    del sent
    order = np.argsort(keys)
    first = _first(keys[order])
    n = np.concatenate([_from_planes(x) for x in table.column("n").to_pylist()])
    df = np.empty(len(keys), np.uint32)
    df[order] = np.minimum(np.add.reduceat(n[order], np.flatnonzero(first), dtype=np.int64), 0xFFFFFFFF).astype(np.uint32)[np.cumsum(first, dtype=np.uint32) - 1]
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "df": pa.array([_planes(df[a:z]) for a, z in zip(cuts, cuts[1:])], pa.binary())})


def best_length(n: int, df: np.ndarray, alone: int, percent: int = PERCENT, longest: int = LONGEST) -> tuple[int, int]:
    """(l, tokens of the l-prefix to index) of a set of n, ``df`` of whose shared tokens rise; ``alone`` tokens come before them.

    No token is left for the index where the set can't have a similar one.
    """
    least = needed(n, percent)
    lengths = np.arange(1, max(1, min(longest, least)) + 1)
    taken = np.clip(n - least + lengths - alone, 0, len(df))
    if not taken[0]:
        return 1, 0
    hits = np.append(0, np.cumsum(df - 1))[taken]
    k = int(np.argmin(hits * (1 + COMPARE * n / lengths)))
    return int(lengths[k]), int(taken[k])


SETS = "same binary, c long, n int, l int, prefix int, tokens array<long>"


def _order(segments: int, shingle: int, percent: int):
    """Of each class of a batch: its size, l, and shared tokens in order where its prefix has any."""

    def order(rows, found):
        same, tokens, n = _sets(rows, shingle)
        place = places(tokens, segments)
        by_place = np.argsort(place)
        df = np.empty(len(tokens), np.int64)
        answers = found.sort_by("part").column("df").to_pylist()
        if len(tokens):
            df[by_place] = np.concatenate([_from_planes(x) for x in answers]).astype(np.int64)[np.cumsum(_first(place[by_place])) - 1]
        owner = np.repeat(np.arange(len(n)), n)
        shared = np.flatnonzero(df > 1)
        shared = shared[np.lexsort((tokens[shared], df[shared], owner[shared]))]
        ends = np.cumsum(np.bincount(owner[shared], minlength=len(n)))
        values, counts = tokens[shared].view(np.int64), df[shared]
        batch = rows.column("batch")[0].as_py() if len(rows) else 0
        l_, prefix, lists, a = [], [], [], 0
        for size, z in zip(n.tolist(), ends.tolist()):
            length, taken = best_length(size, counts[a:z], size - (z - a), percent) if z > a else (1, 0)
            l_.append(length)
            prefix.append(taken)
            lists.append(values[a:z] if taken else None)
            a = z
        c = (np.int64(batch) << 32) | np.arange(len(n))
        return pa.table([pa.array(same, pa.binary()), pa.array(c), pa.array(n, pa.int32()), pa.array(l_, pa.int32()), pa.array(prefix, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["same", "c", "n", "l", "prefix", "tokens"])

    return order


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, batch_bytes: int = BATCH_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row for each distinct text: same (its digest), c (a number), n, l, prefix, tokens; the tokens it shares with
    others, those of its prefix first, are null where it can't be similar to any."""
    rows = docs.select(text_bytes().alias("body"))
    total = int(rows.select(F.sum(F.octet_length("body"))).first()[0] or 0)
    parts, segments = max(1, -(-total // batch_bytes)), max(1, -(-total // segment_bytes))
    dealt = rows.mapInArrow(lean(_texts(parts)), "batch int, same binary, body binary").repartition(parts, "batch")
    asked = dealt.groupBy("batch").applyInArrow(lean(_ask(segments, shingle)), "part int, batch int, keys binary, n binary")
    answered = asked.groupBy("part").applyInArrow(lean(_answer), "batch int, part int, df binary")
    return written(dealt.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(lean(_order(segments, shingle, percent)), SETS), "sets")


class Links:
    """Links between the classes of ``sets``, as many as their components need."""

    def __init__(self, sets: DataFrame, percent: int = PERCENT, near: int = NEAR, cell: int = CELL):
        self.sets, self.percent, self.near, self.cell = sets.where("tokens IS NOT NULL").drop("same"), percent, near, cell
        index = self.sets.select("c", "n", "l", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token"))
        buckets = index.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
        #: (token, c, n, l, held): the prefixes' tokens that several classes have in theirs.
        self.index = written(index.join(buckets, "token"), "index")

    def compared(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs (a, b) whose similarity is at least ``percent``, and ``shared`` and ``either``, the sizes of intersection and union."""
        side = lambda name: self.sets.select(F.col("c").alias(name), F.col("tokens").alias(f"{name}_set"), F.col("n").alias(f"{name}_n"))
        shared = F.size(F.array_intersect("a_set", "b_set"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", shared.alias("shared"), (F.col("a_n") + F.col("b_n")).alias("both"))
        # Counted once: a filter on the sizes would otherwise count them again.
        return written(both, "compared").select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("either")).where(100 * F.col("shared") >= percent * F.col("either"))

    def with_centres(self) -> DataFrame:
        """(a, b, centre): each class with the most central class of every bucket, the one whose own buckets hold most."""
        weight = self.index.groupBy("c").agg(F.sum("held").alias("weight"))
        centres = self.index.select("token", "c").join(weight, "c").groupBy("token").agg(F.max(F.struct("weight", F.col("c").alias("centre"))).alias("top"))
        met = self.index.select("token", "c").join(centres, "token").where("c <> top.centre")
        return met.select(F.least("c", "top.centre").alias("a"), F.greatest("c", "top.centre").alias("b"), F.col("top.centre").alias("centre"), F.col("top.weight").alias("weight")).distinct()

    def _named(self, links: DataFrame, name: str) -> DataFrame:
        """(c, name): the component of each class of the index."""
        known = components(links).select(F.col("node").alias("c"), F.col("root").alias("root"))
        return self.index.select("c").distinct().join(known, "c", "left").select("c", F.coalesce("root", "c").alias(name))

    def across(self, place: DataFrame) -> DataFrame:
        """Candidates (a, b) of different clusters and components, by the tokens of their prefixes."""
        posted = self.index.join(place, "c")
        each = posted.groupBy("token", "cluster").agg(F.count("*").alias("members"))
        mixed = each.groupBy("token").agg(F.count("*").alias("clusters")).where("clusters > 1")
        each = written(each.join(mixed, "token", "left_semi").select("token", "cluster"), "mixed")
        two = each.select("token", F.col("cluster").alias("ka")).join(each.select("token", F.col("cluster").alias("kb")), "token").where("ka < kb")
        side = lambda s: posted.select("token", F.col("cluster").alias(f"k{s}"), F.col("c").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("l").alias(f"l{s}"), F.col("comp").alias(f"comp{s}"))
        sizes = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        met = two.join(side("a"), ["token", "ka"]).join(side("b"), ["token", "kb"]).where(F.col("compa") != F.col("compb")).where(sizes)
        counted = met.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("hits"), F.first(F.least("la", "lb")).alias("l"))
        return counted.where("hits >= l").select("a", "b")

    def within(self, place: DataFrame) -> DataFrame:
        """Links (a, b) inside clusters of several components."""
        open_ = place.groupBy("cluster").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        cells = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(self.cell))).cast("int")
        rows = place.join(open_.select("cluster", cells.alias("cells")), "cluster").withColumn("cell", F.pmod(F.xxhash64("c"), F.col("cells")).cast("int"))
        rows = rows.join(self.sets, "c").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        rows = rows.select("cluster", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "c", "comp", "n", "l", "prefix", "tokens")
        return rows.groupBy("cluster", "i", "j").applyInArrow(_cell_links(self.percent), "a long, b long")

    def all(self, joined: DataFrame | None = None) -> DataFrame:
        """(a, b), a < b; ``joined``: links known before, by which pairs may be joined already; they are among the result."""
        near = written(self.compared(self.with_centres().select("a", "b"), self.near), "near")
        links = near.where(100 * F.col("shared") >= self.percent * F.col("either")).select("a", "b")
        if joined is not None:
            links = links.unionByName(joined)
        # Each class joins the cluster of the heaviest centre near it.
        centred = self.with_centres().join(near, ["a", "b"]).withColumn("c", F.when(F.col("a") == F.col("centre"), F.col("b")).otherwise(F.col("a")))
        best = centred.groupBy("c").agg(F.max(F.struct("weight", "centre")).alias("top")).select(F.least("c", "top.centre").alias("a"), F.greatest("c", "top.centre").alias("b"))
        place = written(self._named(links, "comp").join(self._named(best, "cluster"), "c"), "place")
        across = self.compared(self.across(place), self.percent).select("a", "b")
        return written(links.unionByName(across).unionByName(self.within(place)).distinct(), "links")


def _lists(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places from each start to its end."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Index:
    """Which of some rows hold each token; tokens are numbers from 0."""

    def __init__(self, tokens: np.ndarray, rows: np.ndarray, top: int):
        self.rows = rows[np.argsort(tokens, kind="stable")]
        self.ends = np.cumsum(np.bincount(tokens, minlength=top))

    def hits(self, tokens: np.ndarray, rows: int) -> np.ndarray:
        """How many of the tokens each row holds."""
        ends = self.ends[tokens]
        starts = np.where(tokens > 0, self.ends[tokens - 1], 0)
        return np.bincount(self.rows[_lists(starts, ends)], minlength=rows)


def _cell_links(percent: int):
    """Links of two cells' documents, or of one cell's: those that join components."""

    def links(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        c, n, l_, prefix, cell = (table.column(k).to_numpy() for k in ("c", "n", "l", "prefix", "cell"))
        comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        lists = table.column("tokens").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        tokens = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        begins = np.cumsum(size) - size
        owner, top = np.repeat(np.arange(len(c)), size), int(tokens.max(initial=-1)) + 1
        in_prefix = np.arange(len(tokens)) - begins[owner] < prefix[owner]
        right = cell[owner] == j
        index, short = _Index(tokens[right], owner[right], top), _Index(tokens[right & in_prefix], owner[right & in_prefix], top)
        found = []
        for x in np.flatnonzero(cell == i).tolist():
            own = tokens[begins[x] : begins[x] + size[x]]
            hits = short.hits(own[: prefix[x]], len(c))
            maybe = (hits >= np.minimum(l_[x], l_)) & (hits > 0) & (comp != comp[x]) & (100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n))
            if not maybe.any():
                continue
            maybe = np.flatnonzero(maybe)
            shared = index.hits(own, len(c))[maybe]
            for y in maybe[100 * shared >= percent * (n[x] + n[maybe] - shared)].tolist():
                if comp[y] != comp[x]:
                    found.append((min(c[x], c[y]), max(c[x], c[y])))
                    comp[comp == comp[y]] = comp[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    members = written(docs.select("doc_id", text_bytes().alias("body")).mapInArrow(_members, f"doc_id {kind}, same binary"), "members")
    sets = shingle_sets(docs, shingle, percent)
    least = members.groupBy("same").agg(F.min("doc_id").alias("least"))
    classes = written(sets.select("same", "c", "n").join(least, "same"), "classes")
    root = components(Links(sets, percent).all()).select(F.col("node").alias("c"), "root")
    joined = classes.join(root, "c")
    own = joined.groupBy("root").agg(F.min("least").alias("component"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "least"))
    info = classes.join(joined.select("c", "root").join(own, "root").select("c", "component"), "c", "left").select("same", F.col("n").cast("long").alias("n_shingles"), component.alias("component"))
    return members.join(info, "same").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _oracle(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) END) AS g FROM texts
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.g = y.g AND x.r <> y.r GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= {percent} * (x.n + y.n - k)
), reached AS (
  SELECT r, r AS q FROM texts UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.q
)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(u.doc_id) AS component_id
FROM texts t LEFT JOIN sizes ON sizes.r = t.r JOIN reached ON reached.r = t.r JOIN texts u ON u.r = reached.q GROUP BY t.r, t.doc_id, n
"""


ORACLE = _oracle()
