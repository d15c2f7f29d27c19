"""Operator 13 against rebuilt texts."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import reduce

import pytest

from terralith.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, ref string"


def corpus(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(90):
        if c % 11 == 10:
            continue
        same = c % 3 == 0
        for t in range(rng.randrange(0, 14)):
            text = f"turn {t % 4}" if same else f"{c} says {rng.randrange(3)} ü"
            rows.append((c, t, ("user", "assistant")[t % 2], text, 1, "x"))
    rows += [(40, None, None, None, 0, "y"), (40, None, "user", None, 0, "y"), (41, 0, "", "", 0, None), (None, 0, "user", "nobody", 0, "z"), (41, 0, "", "", 0, None)]
    rows += [(200, t, "user", f"long {t // 2}", 2, "") for t in range(3000)] + [(201, t, "user", f"long {t // 2}", 2, "") for t in range(2500)]
    rows += [(-7, 1, "us", "er"), (-8, 1, "u", "ser"), (1000, 3, "user", "a" * 100_000)]
    rows = [(*r, None, None)[:6] for r in rows]
    rng.shuffle(rows)
    return rows


def rebuild(rows):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, turns in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = convs.get(base, [])[:h] + own[h:]
    return rebuilt


def nodes(rows):
    """Every node as the operator returns it, by walking a trie of dictionaries."""
    rebuilt = rebuild(rows)
    new = lambda depth, parent, text: {"depth": depth, "parent": parent, "members": [], "ends": [], "kids": {}, "bytes": len(text.encode())}
    root = new(0, None, "")
    every = [root]
    for c in sorted(rebuilt):
        node = root
        node["members"].append(c)
        for role, text in rebuilt[c]:
            if (role, text) not in node["kids"]:
                node["kids"][role, text] = new(node["depth"] + 1, node, text)
                every.append(node["kids"][role, text])
            node = node["kids"][role, text]
            node["members"].append(c)
        node["ends"].append(c)
    if not rebuilt:
        return []
    for node in reversed(every):
        node["leaves"] = sum(k["leaves"] for k in node["kids"].values()) or 1
        node["saved"] = (len(node["members"]) - 1) * node["bytes"] + sum(k["saved"] for k in node["kids"].values())
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(n["members"]), n["depth"], min(n["parent"]["members"]) if n["parent"] else None, len(n["members"]), len(n["kids"]), n["leaves"], n["saved"], sha(n["ends"])) for n in every]


def ordered(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("block, piece", [(1024, 1 << 16), (3, 4)])
def test_nodes(spark, monkeypatch, block, piece):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = corpus()
    assert ordered(trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(nodes(rows))


def test_false_fingerprints_are_found(spark):
    """A prime too small for so many prefixes: members differ, and the next hash is taken."""
    rows = [r for r in corpus() if r[0] is not None and r[0] < 200]
    table = spark.createDataFrame(rows, SCHEMA)
    small = (3, 61)
    assert not trie.verified(trie.rebuilt_paths(trie.stored_turns(table, small), small))[1]
    assert ordered(trie.trie(table, (small, trie.HASHES[1])).collect()) == ordered(nodes(rows))
    with pytest.raises(ValueError):
        trie.trie(table, (small,))


def test_products_compose():
    base, prime = trie.HASHES[0]
    turns = [trie.turn_hash("user", f"text {k}", prime) for k in range(9)]
    of = lambda part: reduce(lambda x, t: trie.product(x, t, 1, base, prime), part, 0)
    for cut in range(10):
        head, tail = of(turns[:cut]), of(turns[cut:])
        assert trie.product(head, tail, 9 - cut, base, prime) == of(turns) and trie.rest(of(turns), head, 9 - cut, base, prime) == tail


def test_empty_table(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "")], SCHEMA)).collect() == []
