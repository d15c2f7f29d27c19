"""Operator 12 against all pairs."""

import random

import numpy as np
import pytest

from terralith.llm import jaccard
from terralith.llm.jaccard import best_length, needed

SCHEMA = "doc_id long, text string, tokens int, same string"


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [None, "", "   \n\t ", "one", "ONE", "one two", "one two three four", "one two three four five", "One\ttwo  three four FIVE", "a b c d e a b c d e a b c d e"]
    base = [word() for _ in range(150)]
    for k in range(120):  # one group of near copies, some of them too far from its centre
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            own[rng.randrange(len(own))] = word()
        rows.append(" ".join(own))
    for size, extra in ((300, 66), (100, 25), (40, 8), (12, 2)):  # appended, cut, moved
        own = [word() for _ in range(size)]
        rows += [" ".join(own), " ".join(own + [word() for _ in range(extra)]), " ".join(own[extra // 2 :]), " ".join(own[extra:] + own[:extra])]
    chain = [word() for _ in range(200)]
    for _ in range(12):  # each like the next, ends unlike
        rows.append(" ".join(chain))
        chain = chain[12:] + [word() for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    rows += [f"{passage} {' '.join(word() for _ in range(rng.randrange(5, 200)))}" for _ in range(60)]
    rows += [rows[12]] * 3 + ["one"] * 2
    rows.append(" ".join(base * 40))
    return [(None if k == 5 else k * 7 % 1000, t, k, "x") for k, t in enumerate(rows)]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset([b" ".join(words)] if 0 < len(words) < 5 else [b" ".join(words[k : k + 5]) for k in range(len(words) - 4)])


def plain(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b in range(a):
            shared = len(x & sets[b])
            if x and 100 * shared >= 80 * len(x | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    least = {}
    for (i, *_), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(x), least.get(r, i)) for (i, *_), x, r in zip(rows, sets, root)]


def ordered(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("cell, longest", [(256, 16), (16, 16), (16, 1)])
def test_components(spark, monkeypatch, cell, longest):
    monkeypatch.setattr(jaccard.Links.__init__, "__defaults__", (80, jaccard.NEAR, cell))
    monkeypatch.setattr(jaccard, "LONGEST", longest)
    monkeypatch.setattr(best_length, "__defaults__", (80, longest))
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert ordered(jaccard.linked(docs).collect()) == ordered(plain(rows))


def test_counts_of_tokens(spark):
    """Batches and segments agree on the number of texts that hold each token."""
    rows = [(k, t) for k, t in enumerate(sorted({t for _, t, *_ in corpus() if t}))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard.shingle_sets(docs, batch_bytes=4000, segment_bytes=9000).collect()
    whole = jaccard.shingle_sets(docs).collect()
    pick = lambda rows: sorted((bytes(r.same), r.n, r.l, r.prefix, r.tokens) for r in rows)
    assert pick(found) == pick(whole) and len({r.c for r in found}) == len(found)


def test_prefixes_share_enough():
    """Two sets that share what they need have their shorter prefix's number of tokens in common there."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 60, 2)
        shared = max(needed(n), needed(m))
        if shared > min(n, m):
            continue
        order = rng.permutation(300)
        common, rest = order[:shared], order[shared:]
        x, y = (np.sort(np.concatenate([common, part])) for part in (rest[: n - shared], rest[100 : 100 + m - shared]))
        for length in range(1, min(needed(n), needed(m), 16) + 1):
            a, b = x[: n - needed(n) + length], y[: m - needed(m) + length]
            assert len(np.intersect1d(a, b)) >= length


def test_length_follows_cost():
    assert best_length(10, np.array([], np.int64), 10) == (1, 0)
    assert best_length(10, np.array([5]), 9) == (1, 0)
    rare = best_length(100, np.full(100, 2), 0)
    frequent = best_length(100, np.r_[np.full(24, 2), np.full(76, 10**6)], 0)
    assert rare[0] > 1 and frequent == (4, 24) and rare[1] == 20 + rare[0]


def test_empty_table(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []
