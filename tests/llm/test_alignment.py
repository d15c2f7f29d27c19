"""Operator 11 against a plain version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terralith.llm import alignment
from terralith.llm.alignment import Alignment, planes, scores_of, tokenizers

SCHEMA = "doc_id long, text string, pairs int, chunk string"


def texts():
    prose = ["The quick brown fox, isn't it?  Über 1,234 ﬁ naïve — “quoted” <|endoftext|> <s> <0x41>", "日本語のテキスト и русский текст\n\n\ttabs", " leading and trailing ", "a", " ", "\n", "▁odd▁", "x\x00y", "é́ combining é"]
    long = " ".join(f"word{k % 37} and{k % 11}, the" for k in range(4000))
    return [None, "", *prose, *prose, long, "the the the the the, the", "no" * 3000]


def plain(rows):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 by loops over tokens."""
    known = tokenizers(alignment.TOKENIZER_A, None, alignment.TOKENIZER_B)
    found, counts = [], Counter()
    for i, text in rows:
        a = known.slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = known.pieces.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(names[x] for x in ids) != whole for ids, names in ((a, known.bytes_a), (b, known.bytes_b))):
            found.append((i, [], [], [], []))
            continue
        ends_a, ends_b = {}, {}
        for ids, names, ends in ((a, known.bytes_a, ends_a), (b, known.bytes_b, ends_b)):
            at = 0
            for k, x in enumerate(ids):
                at += len(names[x])
                ends[at] = k
        links, groups, last = [], [], (0, 0)
        for at in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a[at], ends_b[at]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[last[0] : x + 1])) + "|" + ",".join(map(str, b[last[1] : y + 1])))
            last = (x + 1, y + 1)
        counts.update(links)
        found.append((i, a, b, links, groups))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, a, b, links, groups in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out, counts, Counter(p for _, _, _, links, _ in found for p in set(links))


def ordered(rows):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 300])
def test_documents(spark, chunk_bytes):
    rows = [(None if k == 3 else k % 20, t, 7, "odd") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = Alignment(docs, segments=5, chunk_bytes=chunk_bytes)
    want, counts, holders = plain([(r[0], r[1]) for r in rows])
    assert ordered(found.documents().collect()) == ordered(want)
    assert {(r.a_id, r.b_id): (r.n_docs, r.n_links) for r in found.pairs().collect()} == {p: (holders[p], n) for p, n in counts.items()}


def test_chunks_are_summed_in_groups(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNKS", 2)
    rows = [(k, t) for k, t in enumerate(texts())]
    found = Alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), segments=3, chunk_bytes=200)
    assert found.salts > 2
    assert ordered(found.documents().collect()) == ordered(plain(rows)[0])


def test_empty_table(spark):
    assert alignment.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fast_and_slow_agree():
    known = tokenizers(alignment.TOKENIZER_A, alignment.RANKS_A, alignment.TOKENIZER_B)
    every = "".join(chr(k) for k in range(1, 0x250)) + "‐‑‒–—―‘’“”€ 's 'LL don't  \n \t\r\x0b\x0c\x85\xa0 x 12 ³¼ "
    for text in (every, every[::-1], " ".join(every), "  ".join(every)):
        assert known.fast.encode_ordinary(text) == known.slow.encode(text, add_special_tokens=False).ids


def test_planes_return_what_went_in():
    rng = np.random.default_rng(5)
    pair, doc = rng.integers(0, 9, 4000) ** 2, rng.integers(0, 100, 4000)
    # A pair in every document, and one many times in one.
    pair, doc = np.concatenate([pair, np.full(100, 200), np.full(3000, 201)]), np.concatenate([doc, np.arange(100), np.full(3000, 42)])
    pairs, found = planes(pair, doc.astype(np.uint16), 100)
    n, short, long = zip(*found)
    block = {"docs": 100, "pairs": pairs.astype(np.uint32).tobytes(), "counts": [x.astype(np.uint32).tobytes() for x in n], "short": [x.tobytes() for x in short], "long": [x.tobytes() for x in long]}
    assert any(len(x) for x in long) and any(len(x) for x in short)
    score = {p: p + 3 for p in pairs.tolist()}
    want = np.zeros(100, np.int64)
    for p, d in zip(pair.tolist(), doc.tolist()):
        want[d] += score[p]
    assert scores_of(block, np.array([[score[p]] for p in pairs.tolist()]))[:, 0].tolist() == want.tolist()
    docs, links = alignment.counted(block)
    assert links.tolist() == [int((pair == p).sum()) for p in pairs] and docs.tolist() == [len(set(doc[pair == p].tolist())) for p in pairs]
