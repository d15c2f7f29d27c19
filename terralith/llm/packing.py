"""Operator 7: packing token sequences by bin completion.

Documents become token ids followed by an end id; only documents longer than a
sequence are cut. The pieces are dealt at random into groups of about
``GROUP`` pieces, and each group is packed on its own: best-fit decreasing gives
the incumbent, and a branch-and-bound fills bin after bin around the largest
piece left, trying undominated fillings and dropping branches whose waste is
more than the number of bins looked for allows - first the lower bound's, then
one more, up to the incumbent's. Its bins are the result; the incumbent's stay
where ``nodes`` run out first, and ``made_by`` and ``fewest`` tell which. With
``nodes=None`` the search has no limit and is exact.

Scale: tokenising is map-only and leaves rows of a few numbers, which are
written once; one shuffle deals them into groups. Groups are even whatever ids
or texts repeat, since the deal depends on a row's place in that written table.
The part-filled sequences that each group leaves are few; their pieces are packed
again together, so there isn't one of them for every group.

Edge cases: null and empty texts are a piece of one id, the end; a null doc_id
is kept as it is; repeated rows are packed each; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import environment_guard, text_bytes, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a group.
GROUP = 8192
#: Steps of the branch-and-bound in a group before it keeps the incumbent; None: no limit.
NODES = 300_000
#: Steps of a short search.
SHORT = 25_000
#: By short search: how many even shares of the waste allowed a bin may take at once, and the
#: fillings looked at for such a one before the one of least waste is tried.
SEARCHES = ((2, 64), (4, 16), (1, 1024))
#: A sequence with more than this part of it empty is part-filled.
PART_FILLED = 32
#: Words a worker remembers at most in each of two generations, some 100 bytes a word twice.
REMEMBERED = 400_000


class WordIds(dict):
    """Ids of a whitespace-free unit as little-endian bytes, remembered.

    The tokenizer drops white space and never merges across it, so a text's ids
    are its units' ids in a row. Units differing by A-Z case or by one trailing
    stop or comma after a letter share their ids' parts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        environment_guard()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: The words of the generation before; those still used come back from it.
        self.before: dict[bytes, bytes] = {}

    def bound(self) -> None:
        """Begin a new generation once this one is full: frequent words stay, rare ones are forgotten."""
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()

    def __missing__(self, unit: bytes) -> bytes:
        ids = self.before.get(unit)
        if ids is not None:
            self[unit] = ids
            return ids
        word = unit.decode()
        if len(unit) > 1 and unit[-1] in b".," and word[-2] < "ɐ" and word[-2].isalpha() and len(word[-2].lower()) == 1:
            ids = self[unit[:-1]] + self[unit[-1:]]
        elif unit.isascii() and (low := unit.lower()) != unit:
            ids = self[low]
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[unit] = ids
        return ids


_WORDS: dict[str, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    """This worker's units for a tokenizer, by path or by public name."""
    if tokenizer not in _WORDS:
        import public_tokenizers

        _WORDS[tokenizer] = WordIds(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
    return _WORDS[tokenizer]


def _cut(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = word_ids(tokenizer)
            which, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(b.column("body").to_pylist()):
                known.bound()
                whole = b"".join(map(known.__getitem__, text.split())) + end
                for at in range(0, len(whole), 4 * capacity):
                    part = whole[at : at + 4 * capacity]
                    which.append(k)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = {"doc_id": b.column("doc_id").take(pa.array(which, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return cut


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), schema)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences needed at least: for each size a, pieces over capacity - a stand
    alone, those over half take one each, and pieces from a on fill what is left."""
    lengths = sorted(lengths)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    half = bisect_right(lengths, capacity // 2)
    best = max(-(-int(sums[-1]) // capacity), len(lengths) - half)
    for a in sorted(set(lengths[:half])):
        top = max(half, bisect_right(lengths, capacity - a))
        low = bisect_right(lengths, a - 1)
        middle, small = int(sums[top] - sums[half]), int(sums[half] - sums[low])
        spare = (top - half) * capacity - middle
        best = max(best, len(lengths) - half + max(0, -(-(small - spare) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over counts per length; the lengths of each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for length in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[length])):
            if above := rooms >> length:
                room = length + (above & -above).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
                bins[at].append(length)
            else:
                room, at = capacity, len(bins)
                bins.append([length])
            left = room - length
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


class OutOfNodes(Exception):
    """The search has used all the nodes it was given."""


class Completion:
    """Branch-and-bound that completes one bin at a time, around the largest piece left."""

    def __init__(self, counts: np.ndarray, capacity: int, nodes: int | None, shares: int, probe: int):
        self.capacity, self.nodes, self.shares, self.probe = capacity, nodes, shares, probe
        self.left = counts.astype(int).tolist()
        self.total = self.open = sum(n * k for n, k in enumerate(self.left))
        #: Bit n is set where pieces of length n are left.
        self.there = sum(1 << n for n, k in enumerate(self.left) if k)

    def take(self, lengths: list[int], by: int) -> None:
        self.open -= by * sum(lengths)
        for length in lengths:
            self.left[length] -= by
            if self.left[length]:
                self.there |= 1 << length
            else:
                self.there &= ~(1 << length)

    def fillings(self, room: int, top: int, waste: int) -> Iterator[list[int]]:
        """Fillings of ``room`` from lengths up to ``top`` that waste at most ``waste``, larger lengths first."""
        if self.nodes is not None:
            self.nodes -= 1
            if self.nodes < 0:
                raise OutOfNodes
        fits = self.there & ((1 << (min(room, top) + 1)) - 1)
        if not fits:
            if room <= waste:
                yield []
            return
        while fits:
            length = fits.bit_length() - 1
            fits ^= 1 << length
            for n in range(min(self.left[length], room // length), 0, -1):
                for rest in self.fillings(room - n * length, length - 1, waste):
                    yield [length] * n + rest

    def options(self, room: int, top: int, waste: int) -> Iterator[list[int]]:
        """All fillings: of the first ``probe`` one that wastes little or else by waste, then the others."""
        little = self.shares * waste * self.capacity // max(self.open, 1)
        found, stream = [], self.fillings(room, top, waste)
        for filling in stream:
            if room - sum(filling) <= little:
                yield filling
                break
            found.append(filling)
            if len(found) == self.probe:
                break
        yield from sorted(found, key=sum, reverse=True)
        yield from stream

    def undominated(self, filling: list[int], room: int) -> bool:
        """Whether no single piece left may replace one of the filling's, or two of them together, and fill more."""
        slack = room - sum(filling)
        if not slack:
            return True
        sizes = sorted(set(filling))
        parts = set(sizes) | {a + b for i, a in enumerate(sizes) for b in sizes[i + 1 :]}
        return not any((self.there >> (part + 1)) & ((1 << slack) - 1) for part in parts)

    def solve(self, bins: int) -> list[list[int]] | None:
        """At most so many bins for all pieces; None if there is no such packing."""
        allowed = bins * self.capacity - self.total
        done: list[list[int]] = []
        stack: list[tuple[int, Iterator[list[int]], int]] = []
        while self.there and allowed >= 0:
            if len(stack) == len(done):
                largest = self.there.bit_length() - 1
                self.take([largest], 1)
                stack.append((largest, self.options(self.capacity - largest, largest, allowed), allowed))
            largest, options, before = stack[-1]
            room, chosen = self.capacity - largest, None
            for filling in options:
                self.take(filling, 1)
                if self.undominated(filling, room):
                    chosen = filling
                    break
                self.take(filling, -1)
            if chosen is not None:
                allowed = before - (room - sum(chosen))
                done.append([largest, *chosen])
                continue
            stack.pop()
            self.take([largest], -1)
            if not stack:
                return None
            self.take(done.pop()[1:], -1)
            allowed = stack[-1][2]
        return None if self.there else done


def fewest_bins(counts: np.ndarray, capacity: int, nodes: int | None = NODES) -> tuple[list[list[int]], str, bool]:
    """(bins, what made them, whether fewer are known to be impossible).

    Best fit is the incumbent. Short searches look for the lower bound's number of bins,
    then for one more, up to the incumbent's number, and their bins take its place. A long
    one then tries what is still open below.
    """
    best, made_by = best_fit(counts, capacity), "best_fit"
    least = lower_bound(np.repeat(np.arange(len(counts)), counts).tolist(), capacity)
    left = nodes

    def search(bins: int, shares: int, probe: int, limit: int | None) -> list[list[int]] | None:
        nonlocal left
        limit = limit if left is None else left if limit is None else min(limit, left)
        work = Completion(counts, capacity, limit, shares, probe)
        try:
            return work.solve(bins)
        finally:
            left = left if left is None else left - (limit - max(work.nodes, 0))

    for bins in range(least, len(best) + 1):
        for how in SEARCHES:
            try:
                found = search(bins, *how, SHORT)
            except OutOfNodes:
                continue
            if found is not None:
                best, made_by = found, "completion"
            else:
                least = bins + 1
            break
        if len(best) == bins and made_by == "completion":
            break
    try:
        for bins in range(least, len(best)):
            if (found := search(bins, *SEARCHES[0], None)) is not None:
                return found, "completion", True
    except OutOfNodes:
        return best, made_by, False
    return best, made_by, True


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, nodes: int | None = NODES) -> tuple[np.ndarray, np.ndarray, str, bool]:
    """(bin and offset of each piece, what made the bins, whether they are known to be the fewest)."""
    sizes = np.asarray(lengths, np.int64)
    counts = np.bincount(sizes, minlength=capacity + 1)
    bins, made_by, proven = fewest_bins(counts, capacity, nodes)
    nexts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable").tolist()
    for k, members in enumerate(bins):
        at = 0
        for length in members:
            i = order[nexts[length]]
            nexts[length] += 1
            number[i], offset[i] = k, at
            at += length
    return number, offset, made_by, proven


def _pack(capacity: int, nodes: int | None, turn: int):
    def pack(key, table):
        lengths = table.column("length").to_numpy()
        number, offset, made_by, proven = pack_lengths(lengths, capacity, nodes)
        room = capacity - np.bincount(number, weights=lengths).astype(np.int64)
        added = {
            "sequence_id": pa.array(number + (turn << 56 | int(key[0].as_py()) << 24), pa.int64()),
            "offset": pa.array(offset, pa.int64()),
            "made_by": pa.array([made_by] * len(number), pa.string()),
            "fewest": pa.array([proven] * len(number), pa.bool_()),
            "part_filled": pa.array((room * PART_FILLED > capacity)[number], pa.bool_()),
        }
        out = table.drop_columns(["pack_group"])
        for name, column in added.items():
            out = out.append_column(name, column)
        return out

    return pack


def packed(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nodes: int | None = NODES) -> DataFrame:
    """``pieces`` (a written table with a column ``length``) with sequence_id, offset, made_by and fewest.

    Groups leave a part-filled sequence or a few; the pieces of those are packed again
    together, in fewer groups each time, until there is one group or no fewer.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    schema = f"{fields}, sequence_id long, offset long, made_by string, fewest boolean, part_filled boolean"
    closed, turn, n = None, 0, max(1, -(-pieces.count() // group))
    while True:
        dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
        found = dealt.groupBy("pack_group").applyInArrow(_pack(capacity, nodes, turn), schema)
        found = found if n == 1 else written(found, "packed")
        again = 1 if n == 1 else -(-found.where("part_filled").count() // group)
        settled = found if n == 1 or again >= n or again == 0 else found.where("NOT part_filled")
        closed = settled if closed is None else closed.unionByName(settled)
        if settled is found:
            return closed.drop("part_filled")
        pieces, n, turn = found.where("part_filled").select(*pieces.columns), again, turn + 1


def packed_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset, made_by, fewest of every piece."""
    return packed(written(tokenised(docs, tokenizer, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary) of packed pieces that have ids: the pieces' ids in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
