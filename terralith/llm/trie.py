"""Operator 13: the prefix trie of rebuilt conversations from composable fingerprints.

A conversation c is rebuilt from the first h turns of another one, its base, and its own
turns after the first h. No rebuilt text is ever made. A sequence of turns has the
fingerprint sum(t_i B^(n-i)) modulo a prime, t_i being a turn's hash, so sequences form a
monoid: (x, n)(y, m) = (x B^m + y, n + m). Stored turns carry the products of all turns
before and up to them; a product of turns from h to k is after_k - after_h B^(k-h), and a
rebuilt prefix is the base's head times such a product.

Rebuilt prefixes of equal depth and fingerprint are one node. Equality is then verified:
every stored turn refers to the first stored turn of the very same role and text, and
all members of a node must share the reference of their last turn and the parent's
fingerprint, so by induction the whole sequence. If any node fails, the trie is built again with
the next of ``HASHES``.

Sums over a subtree need no recursion: every node belongs to the smallest of its members,
and its ancestors are that member's prefixes. So each conversation adds, to each of its
prefixes, what the nodes it owns from there on hold; prefixes are grouped by node.

Scale: turns are numbered after one range sort by (conversation, turn), so a conversation
of any length spreads over many tasks: each multiplies its part, and products of parts
before are composed in. Everything else is grouped by node with partial sums; sums along
a conversation run in blocks of ``BLOCK`` turns. The conversations that end in a node are
sorted by ranges into pieces of text, and one task streams a node's pieces through SHA-256.

Edge cases: null role or text is empty; a null turn comes first; of equal turns the order is
that of role, then text; rows without conv_id belong to no conversation and are left out;
repeated rows are turns of their own; a base that is absent, or that equals the conversation,
needs no care; an empty table has no root and gives an empty result; a very long text is held
as it is by the task that hashes it. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralith.llm.common import written

#: Conversations of a family share the head of the first one.
FAMILY = 5
#: A head has fewer turns than this.
HEADS = 9
#: (base, prime) of the fingerprints; the next pair serves if the one before fails.
HASHES = ((0x3C6EF372FE94F82BA54FF53A5F1D36F1, (1 << 127) - 1), (0x510E527FADE682D19B05688C2B3E6C1F, (1 << 127) - 1), (0x1F83D9ABFB41BD6B5BE0CD19137E2179, (1 << 127) - 1))
BLOCK = 1024
#: Characters of a piece of the text that lists a node's conversations.
PIECE = 1 << 16
NODE = ["depth", "f1", "f2"]


@lru_cache(4096)
def _power(base: int, n: int, prime: int) -> int:
    return pow(base, n, prime)


def product(x: int, y: int, turns: int, base: int, prime: int) -> int:
    """The fingerprint of a sequence x followed by a sequence y of so many turns."""
    return (x * _power(base, turns, prime) + y) % prime


def rest(whole: int, head: int, turns: int, base: int, prime: int) -> int:
    """The fingerprint of the last ``turns`` turns of a sequence, whose other turns are ``head``."""
    return (whole - head * _power(base, turns, prime)) % prime


def turn_hash(role: str, text: str, prime: int) -> int:
    role = role.encode()
    return xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "little") + role + text.encode()) % (prime - 1) + 1


def _halves(values: list[int]) -> list[pa.Array]:
    """128-bit numbers as two columns of longs."""
    both = np.frombuffer(b"".join(v.to_bytes(16, "little") for v in values), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (1, 0)]


def _whole(high: pa.Array, low: pa.Array) -> list[int]:
    columns = [np.asarray(c.fill_null(0).to_numpy(zero_copy_only=False), np.int64) for c in (low, high)]
    raw = np.ascontiguousarray(np.stack(columns, axis=1)).tobytes()
    return [int.from_bytes(raw[k : k + 16], "little") for k in range(0, len(raw), 16)]


NUMBERED = "part int, number long, conv_id long, local long, n_bytes long, s1 long, s2 long, e1 long, e2 long, role string, text string"


def _number(base: int, prime: int):
    """Of each sorted turn: its place among those of its conversation in this task, and the products before and up to it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, local, value, row = TaskContext.get().partitionId(), None, 0, 0, 0
        for b in batches:
            places, before, after = [], [], []
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, local, value = c, 0, 0
                places.append(local)
                before.append(value)
                value = product(value, turn_hash(role, text, prime), 1, base, prime)
                after.append(value)
                local += 1
            rows = np.arange(row, row + len(b))
            row += len(b)
            columns = [pa.array(np.full(len(b), part, np.int32)), pa.array((np.int64(part) << 40) | rows), b.column("conv_id"), pa.array(places, pa.int64()), b.column("n_bytes"), *_halves(before), *_halves(after), b.column("role"), b.column("text")]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "conv_id", "local", "n_bytes", "s1", "s2", "e1", "e2", "role", "text"])

    return number


def _parts_before(base: int, prime: int):
    """(conv_id, part, b_n, b1, b2): turns and product of a conversation's parts in tasks before."""

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, values = [], []
            for c, parts in zip(b.column("conv_id").to_pylist(), b.column("parts").to_pylist()):
                n, value = 0, 0
                for p in parts:
                    rows.append((c, p["part"], n))
                    values.append(value)
                    own = (p["e1"] << 64) | (p["e2"] & (1 << 64) - 1)
                    n, value = n + p["n"], product(value, own, p["n"], base, prime)
            columns = [pa.array(x, k) for x, k in zip(list(zip(*rows)) or [(), (), ()], (pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *_halves(values)], names=["conv_id", "part", "b_n", "b1", "b2"])

    return before


def _carried(base: int, prime: int):
    """Turns with their place and products in the whole conversation."""

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            local, behind = b.column("local").to_numpy(), np.asarray(b.column("b_n").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            carry = _whole(b.column("b1"), b.column("b2"))
            whole = []
            for (high, low), more in ((("s1", "s2"), 0), (("e1", "e2"), 1)):
                own = _whole(b.column(high), b.column(low))
                whole += _halves([product(x, y, n + more, base, prime) if x else y for x, y, n in zip(carry, own, local.tolist())])
            columns = [b.column("conv_id"), pa.array(local + behind), b.column("n_bytes"), *whole, b.column("ref")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "pos", "n_bytes", "s1", "s2", "e1", "e2", "ref"])

    return carried


def stored_turns(conversations: DataFrame, hashing: tuple[int, int] = HASHES[0]) -> DataFrame:
    """conv_id, pos (from 0), n_bytes, s1 and s2 (the product of the turns before), e1 and e2 (that up to it), ref (the
    number of the first stored turn of the same role and text)."""
    filled = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("role", "text")]
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), *filled)
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    turns = turns.withColumn("n_bytes", F.octet_length("text").cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(turns.mapInArrow(_number(*hashing), NUMBERED), "numbered")
    first = numbered.groupBy("role", "text").agg(F.min("number").alias("ref"))
    parts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max("local").alias("local"))
    parts = parts.join(numbered.select("conv_id", "part", "local", "e1", "e2"), ["conv_id", "part", "local"])
    # A conversation has a part a task at most.
    several = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "e1", "e2"))).alias("parts")).where(F.size("parts") > 1)
    before = several.mapInArrow(_parts_before(*hashing), "conv_id long, part int, b_n long, b1 long, b2 long")
    whole = numbered.join(first, ["role", "text"]).drop("role", "text", "number").join(before, ["conv_id", "part"], "left")
    return written(whole.mapInArrow(_carried(*hashing), "conv_id long, pos long, n_bytes long, s1 long, s2 long, e1 long, e2 long, ref long"), "turns")


def _composed(base: int, prime: int):
    """Own turns as turns of the rebuilt conversation: the base's head times the product from h on."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, cuts = _whole(b.column("h1"), b.column("h2")), _whole(b.column("c1"), b.column("c2"))
            out = []
            for (high, low), less in ((("e1", "e2"), 0), (("s1", "s2"), 1)):
                whole = _whole(b.column(high), b.column(low))
                turns = [k - less for k in b.column("k").to_pylist()]
                out += _halves([product(head, rest(x, cut, k, base, prime), k, base, prime) for head, cut, x, k in zip(heads, cuts, whole, turns)])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), *out, b.column("ref"), b.column("n_bytes"), b.column("ends")], names=["conv_id", "depth", "f1", "f2", "p1", "p2", "ref", "n_bytes", "ends"])

    return composed


PATHS = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, ref long, n_bytes long, ends boolean"


def rebuilt_paths(turns: DataFrame, hashing: tuple[int, int] = HASHES[0], family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """A row for every prefix of every rebuilt conversation: conv_id, depth, f1 and f2 (its fingerprint), p1 and p2 (its
    parent's), ref and n_bytes of its last turn, ends (whether it is the whole)."""
    # At most heads - 1 turns of a conversation are collected.
    head = F.sort_array(F.collect_list(F.when(F.col("pos") < heads - 1, F.struct("pos", "s1", "s2", "e1", "e2", "ref", "n_bytes")))).alias("head")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), head)
    c = F.col("conv_id")
    own = convs.select(c, "n", F.col("head").alias("own"), (c - c % family).alias("of"), F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(heads)).alias("h"))
    base = convs.select(c.alias("base_id"), F.col("n").alias("base_n"), F.col("head").alias("base"))
    params = own.join(base, F.col("of") == F.col("base_id"), "left").withColumn("hh", F.least("h", F.coalesce("base_n", F.lit(0))))
    params = params.withColumn("length", F.col("hh") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    at = lambda column, k, name: F.when(k > 0, F.get(F.col(column), (k - 1).cast("int"))[name]).otherwise(F.lit(0))
    fp = [at("base", F.col("hh"), e).alias(a) for e, a in (("e1", "h1"), ("e2", "h2"))] + [at("own", F.least("h", "n"), e).alias(a) for e, a in (("e1", "c1"), ("e2", "c2"))]
    params = written(params.select(c, "h", "hh", "length", "base", *fp), "rebuilt")
    zero = F.lit(0).cast("long")
    root = params.select(c, zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("p1"), zero.alias("p2"), zero.alias("ref"), zero.alias("n_bytes"), (F.col("length") == 0).alias("ends"))
    taken = params.where("hh > 0").select(c, "length", F.explode(F.slice("base", F.lit(1), F.col("hh").cast("int"))).alias("t"))
    depth = F.col("t.pos") + 1
    taken = taken.select(c, depth.alias("depth"), "t.e1", "t.e2", "t.s1", "t.s2", "t.ref", "t.n_bytes", (F.col("length") == depth).alias("ends")).toDF(*root.columns)
    after = turns.join(params.drop("base"), "conv_id").where("pos >= h").withColumn("k", F.col("pos") - F.col("h") + 1).withColumn("depth", F.col("hh") + F.col("k"))
    after = after.withColumn("ends", F.col("depth") == F.col("length")).mapInArrow(_composed(*hashing), PATHS)
    return written(root.unionByName(taken).unionByName(after), "paths")


def verified(paths: DataFrame) -> tuple[DataFrame, bool]:
    """(the nodes: depth, f1, f2, p1, p2, conv_id, n_convs, n_bytes; whether the members of each share the last turn and the parent)."""
    ends = [f(k).alias(f"{name}_{k}") for k in ("ref", "p1", "p2") for name, f in (("low", F.min), ("high", F.max))]
    nodes = written(paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), *ends), "nodes")
    differ = " OR ".join(f"low_{k} <> high_{k}" for k in ("ref", "p1", "p2"))
    return nodes.select(*NODE, F.col("low_p1").alias("p1"), F.col("low_p2").alias("p2"), "conv_id", "n_convs", "n_bytes"), nodes.where(differ).isEmpty()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, the first conversation, piece): sorted conversations of a node as text of limited length."""
    key, ids, size = None, [], 0
    for b in batches:
        out = []
        for *own, c in zip(*(b.column(k).to_pylist() for k in (*NODE, "conv_id"))):
            if own != key or size > PIECE:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids, size = own, [], 0
            ids.append(c)
            size += len(str(c)) + 1
        yield _piece_rows(out)
    if ids:
        yield _piece_rows([(*key, ids[0], ",".join(map(str, ids)))])


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*NODE, "first", "piece"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sha256) of the node's pieces, which come in order."""
    names = [*NODE, "ends_sha256"]
    row = lambda key, sha: pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([sha.hexdigest()])], names=names)
    key, sha = None, None
    for b in batches:
        out = []
        for *own, piece in zip(*(b.column(k).to_pylist() for k in (*NODE, "piece"))):
            if own == key:
                sha.update(b",")
            else:
                if sha is not None:
                    out.append(row(key, sha))
                key, sha = own, hashlib.sha256()
            sha.update(piece.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if sha is not None:
        yield row(key, sha)


def ends_of(paths: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 of the nodes in which conversations end."""
    rows = paths.where("ends").select(*NODE, "conv_id")
    pieces = rows.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_pieces, "depth long, f1 long, f2 long, first long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_streamed, "depth long, f1 long, f2 long, ends_sha256 string")


def _saved(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, f1, f2, saved_tokens of nodes with several members."""
    shared = nodes.where("n_convs > 1").select(*NODE, F.col("conv_id").alias("owner"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("worth"))
    held = paths.join(shared, NODE).select("conv_id", *NODE, F.when(F.col("owner") == F.col("conv_id"), F.col("worth")).otherwise(0).alias("worth"))
    held = held.withColumn("block", F.floor(F.col("depth") / BLOCK))
    blocks = held.groupBy("conv_id", "block").agg(F.sum("worth").alias("in_block"))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("in_block").over(behind), F.lit(0)).alias("later"))
    own = F.sum("worth").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    onward = held.withColumn("own", own).join(blocks, ["conv_id", "block"])
    return onward.groupBy(*NODE).agg(F.sum(F.col("own") + F.col("later")).alias("saved_tokens"))


def trie(conversations: DataFrame, hashes: tuple[tuple[int, int], ...] = HASHES, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Every node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for hashing in hashes:
        paths = rebuilt_paths(stored_turns(conversations, hashing), hashing, family, heads)
        nodes, sound = verified(paths)
        if sound:
            break
    else:
        raise ValueError("every hash has different sequences of one fingerprint")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # A leaf is the end of its smallest member's path, so a conversation stands for one leaf at most.
    leaves = paths.join(nodes.where("n_children = 0").select("conv_id"), "conv_id", "left_semi").groupBy(*NODE).agg(F.count("*").alias("n_leaves"))
    found = nodes.join(parents, ["depth", "p1", "p2"], "left").join(leaves, NODE, "left").join(_saved(paths, nodes), NODE, "left").join(ends_of(paths), NODE, "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: Prefixes are lists of (role, text) here; crc32 bit by bit, as SQL has none.
ORACLE = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, c - c % 5 AS base,
  xor(list_reduce(list_transform(range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, (i + 1)::INT, 1))::BIGINT),
    lambda a, x: list_reduce(range(8)::BIGINT[], lambda b, k: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h FROM ids),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
parts AS (SELECT h.c, 0 AS part, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.c = h.base AND t.pos <= h.h
  UNION ALL SELECT h.c, 1, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.pos > h.h),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, role, text FROM parts),
paths AS (SELECT c, depth, sha256(string_agg(sha256(length(role)::VARCHAR || ':' || role || text), '' ) OVER (PARTITION BY c ORDER BY depth)) AS node, strlen(text) AS bytes FROM rebuilt
  UNION ALL SELECT c, 0, 'root', 0 FROM ids),
steps AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (SELECT node, min(depth) AS depth, min(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS worth,
  sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM steps GROUP BY node),
kids AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
tree AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node),
below AS (SELECT p.node, sum(t.worth) AS saved, sum((t.n_children = 0)::INT) AS leaves FROM tree t JOIN paths p ON p.c = t.conv_id AND p.depth <= t.depth GROUP BY p.node)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, t.ends_sha256
FROM tree t JOIN below b USING (node) LEFT JOIN nodes p ON p.node = t.parent
"""
