import hashlib
import random
import re

import numpy as np
from edgeloom.llm import anchors, substrings, suffixes


def repeated(units, window, seen):
    gone = set()
    for i in range(len(units) - window + 1):
        k = tuple(units[i : i + window])
        gone.update(range(i, i + window) if k in seen else ())
        seen.add(k)
    return gone


def test_words_against_brute_force(edge_docs, distinct_docs):
    got = {r["doc_id"]: r for r in substrings.dedup(edge_docs).collect()}
    assert len(got) == len(distinct_docs)
    seen = set()
    for key, text in distinct_docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = repeated(w, 20, seen)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[key]["n_units"], got[key]["n_removed"], got[key]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_bytes_against_brute_force(edge_docs, distinct_docs):
    got = {r["doc_id"]: r for r in suffixes.dedup(edge_docs).collect()}
    seen = set()
    for key, text in distinct_docs:
        b = text.encode()
        gone = repeated(b, 100, seen)
        spans = sum(i - 1 not in gone for i in gone)
        assert (got[key]["n_units"], got[key]["n_removed"], got[key]["n_spans"]) == (len(b), len(gone), spans)
        assert got[key]["kept_sha256"] == hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()


def test_empty_tables(edge_docs):
    assert substrings.dedup(edge_docs.limit(0)).count() == 0
    assert suffixes.dedup(edge_docs.limit(0)).count() == 0


def test_long_texts_are_cut_between_windows():
    data = np.random.default_rng(2).integers(97, 100, 5000).astype(np.uint8)

    def windows(pieces):
        out = []
        for shift, part, offs in pieces:
            _, at, count, anchor = suffixes.segments(part, offs, 100, 40)
            out += [(shift + a + i, int(x)) for a, n, x in zip(at.tolist(), count.tolist(), anchor) for i in range(n)]
        return out

    whole = np.array([0, len(data)])
    assert len(want := windows([(0, data, whole)])) == 4901
    for most in (1, 7, 1000, 4900, 4901, 5000):
        assert windows(suffixes.parts(data, whole, 100, most)) == want


def test_a_text_of_256_mb(monkeypatch):
    monkeypatch.setattr(anchors, "PLACE_BITS", 12)
    data = np.random.default_rng(2).integers(97, 123, 10000).astype(np.uint8)
    cut = list(suffixes.parts(data, np.array([0, len(data)]), 100, 2000))
    assert sum(int(suffixes.segments(part, offs, 100, 40)[2].sum()) for _, part, offs in cut) == 9901
    assert suffixes.PART + 1000 < 1 << 28


def test_segments_of_more_than_255_windows(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, base[i * 100 :] + str(i) + base[: 1500 - i]) for i in range(6)]
    got = {r["doc_id"]: r for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 400, 40).collect()}
    seen = set()
    for key, text in rows:
        gone = repeated(text.encode(), 400, seen)
        assert (got[key]["n_removed"], got[key]["kept_sha256"]) == (len(gone), hashlib.sha256(bytes(x for i, x in enumerate(text.encode()) if i not in gone)).hexdigest())
