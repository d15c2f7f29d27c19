"""Map extracts as Arrow batches: one pass over a file finds its nodes, ways and relations."""

from __future__ import annotations

import bz2
import gc
import gzip
import re
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS = ("node", "way", "relation")
#: A row per element; what its kind doesn't have is null.
SCHEMA = "patch_id string, kind string, id string, lat double, lon double, refs array<string>, members array<struct<type:string,ref:string,role:string>>, tags map<string,string>"
#: Elements of a batch, and bytes parsed at once.
BATCH, CHUNK = 20_000, 1 << 20
#: What is cut off at both ends of an attribute's value, as Spark's XML reader does.
BLANK = "".join(map(chr, range(33)))
#: Where an element begins, or what may hold the text of one that is none.
BEGIN = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(node|way|relation)(?=[\s/>])", re.DOTALL)
START_TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")


class _Found:
    """Elements of one kind: their attributes, where the parts of each begin, and tags by their places. The last one may still be open."""

    def __init__(self) -> None:
        self.attributes: list[dict] = []
        self.starts: list[int] = []
        self.parts: list[dict] = []
        self.tags: dict[int, dict] = {}

    def batch(self, patch: str, kind: str) -> pa.RecordBatch:
        n = len(self.attributes)
        ends = [*self.starts, len(self.parts)]
        lats = lons = pa.nulls(n, pa.float64())
        refs, members = pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, MEMBERS)
        if kind == "node":
            lats, lons = (_numbers(_texts(self.attributes, name)) for name in ("lat", "lon"))
        elif kind == "way":
            refs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _texts(self.parts, "ref"))
        else:
            flat = pa.StructArray.from_arrays([_texts(self.parts, k) for k in ("type", "ref", "role")], names=["type", "ref", "role"])
            some = [s if t > s else None for s, t in zip(ends, ends[1:])]  # a relation without members has no list
            members = pa.ListArray.from_arrays(pa.array([*some, ends[-1]], pa.int32()), flat)
        size = np.zeros(n + 1, np.int32)
        size[np.fromiter(self.tags, np.int64, len(self.tags)) + 1] = [len(t) for t in self.tags.values()]
        pairs = [_trimmed(pa.array([x for t in self.tags.values() for x in side(t)], pa.string())) for side in (dict.keys, dict.values)]
        tags = pa.MapArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), *pairs)
        columns = {"patch_id": pa.repeat(patch, n), "kind": pa.repeat(kind, n), "id": _texts(self.attributes, "id"), "lat": lats, "lon": lons, "refs": refs, "members": members, "tags": tags}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


MEMBERS = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("role", pa.string())]))


def _trimmed(values: pa.Array) -> pa.Array:
    return pc.utf8_trim(values, characters=BLANK)


def _texts(rows: list[dict], name: str) -> pa.Array:
    return _trimmed(pa.array([a.get(name) for a in rows], pa.string()))


def _numbers(texts: pa.Array) -> pa.Array:
    """Texts as numbers; null where one is none."""
    try:
        return pc.cast(texts, pa.float64())
    except pa.ArrowInvalid:
        return pa.array([_number(v) for v in texts.to_pylist()], pa.float64())


def _number(text: str | None) -> float | None:
    try:
        return None if text is None or "_" in text else float(text)
    except ValueError:
        return None


def _parsed(data: bytes, patch: str, kinds: Iterable[str]) -> list[pa.RecordBatch]:
    """Batches of a well-formed file's elements."""
    out: list[pa.RecordBatch] = []
    found = {k: _Found() for k in kinds}
    within, own = "", _Found()

    def start(name: str, a: dict) -> None:
        nonlocal within, own
        if name == "nd":
            if within == "way":
                own.parts.append(a)
        elif name in found:
            within, own = name, found[name]
            if len(own.attributes) >= BATCH:
                out.append(own.batch(patch, name))
                own = found[name] = _Found()
            own.attributes.append(a)
            own.starts.append(len(own.parts))
        elif name == "tag":
            if within and "k" in a:
                own.tags.setdefault(len(own.attributes) - 1, {})[a["k"]] = a.get("v")
        elif name == "member":
            if within == "relation":
                own.parts.append(a)
        elif name in KINDS:
            within = ""

    def end(name: str) -> None:
        nonlocal within
        if name == within:
            within = ""

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    for at in range(0, len(data), CHUNK):
        parser.Parse(data[at : at + CHUNK], False)
    parser.Parse(b"", True)
    return out + [f.batch(patch, k) for k, f in found.items() if f.attributes]


def _rescued(data: bytes, patch: str, kinds: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """Of a file that isn't well-formed the elements that are; one that can be told apart but not parsed is a row of nulls, one without an end none."""
    at = 0
    while begin := BEGIN.search(data, at):
        if begin[1] is None:
            at = begin.end()
            continue
        kind, tag = begin[1].decode(), START_TAG.match(data, begin.start())
        if tag is None:
            return
        close = b"</" + begin[1] + b">"
        end = tag.end() if tag[0].endswith(b"/>") else data.find(close, tag.end()) + len(close)
        if end < tag.end():
            return
        if kind in kinds:
            try:
                yield from _parsed(data[begin.start() : end], patch, (kind,))
            except expat.ExpatError:
                empty = _Found()
                empty.attributes.append({})
                empty.starts.append(0)
                yield empty.batch(patch, kind)
        at = end


def parsed(data: bytes, patch: str, kinds: Iterable[str] = KINDS) -> Iterator[pa.RecordBatch]:
    """Elements (see ``SCHEMA``) of a map extract's bytes, which may be compressed with gzip or bzip2.

    Attributes have no cycles, so nothing is lost by not looking for any among half a million of them.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    elif data[:3] == b"BZh":
        data = bz2.decompress(data)
    looked = gc.isenabled()
    gc.disable()
    try:
        batches = _parsed(data, patch, kinds)
    except expat.ExpatError:
        batches = _rescued(data, patch, kinds)
    finally:
        if looked:
            gc.enable()
    yield from batches


def elements(batches: Iterator[pa.RecordBatch], kinds: Iterable[str] = KINDS) -> Iterator[pa.RecordBatch]:
    """Elements of batches of files (patch_id, content)."""
    for batch in batches:
        for patch, content in zip(batch.column("patch_id"), batch.column("content")):
            yield from parsed(content.as_py(), patch.as_py(), kinds)
