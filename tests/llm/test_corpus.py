"""Whole small tables against brute force."""

import hashlib
import os

import pytest
from edgeloom.llm import common, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="session")
def texts(spark):
    rows = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def test_repeated_bytes(spark, texts):
    got = {r["doc_id"]: r for r in queries.op6(spark, SF).collect()}
    seen = set()
    for key, text in texts:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = bytes(gone).replace(b"\0", b" ").split()
        kept = bytes(x for x, y in zip(b, gone) if not y)
        assert tuple(got[key][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest())
    assert sum(r["n_removed"] for r in got.values()) > 0


def test_many_small_bins_change_nothing(spark, monkeypatch):
    from edgeloom.llm import repeats, substrings, suffixes

    docs = common.table(spark, SF, "documents")
    for op in (substrings.dedup, suffixes.dedup):
        want = sorted(map(tuple, op(docs).select("doc_id", "n_removed", "kept_sha256").collect()))
        with monkeypatch.context() as m:
            m.setattr(repeats, "BIN_BYTES", 20_000)
            assert sorted(map(tuple, op(docs).select("doc_id", "n_removed", "kept_sha256").collect())) == want
        assert sum(x[1] for x in want) > 0


def test_token_files_of_the_corpus(spark, texts):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op7(spark, SF).collect()}
    for key, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert got[key] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def fingerprint_by_loops(text):
    """One-permutation hashing as stated, a bin at a time."""
    import numpy as np
    from edgeloom.llm import fingerprint as f
    from edgeloom.llm import tokens as t

    raw = np.frombuffer(text.encode(), np.uint8)
    values, _ = t.shingles(raw, np.array([0, len(raw)]), 5)
    least, width = {}, 64 - f.BINS.bit_length() + 1
    for v in map(int, values):
        b = v >> width
        least[b] = min(least.get(b, 1 << 64), v & ((1 << width) - 1))
    if not least:
        return ""
    out = []
    for b in range(f.BINS):
        at, attempt = b, 0
        while at not in least:
            attempt += 1
            key = np.array([(b * t.BASE + attempt * t.BASE2) % t.M64], np.uint64)
            at = int(t.mix(key)[0]) % f.BINS
        out.append(int(t.mix(np.array([least[at]], np.uint64))[0]) & 255)
    return bytes(out).hex()


def test_fingerprints_of_the_corpus(spark, texts):
    import re

    got = {r["doc_id"]: r for r in queries.op3(spark, SF).collect()}
    sets = []
    for _, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    off = []
    for i, (key, text) in enumerate(texts):
        j = (i + 1) % len(texts)
        k = len(text) // 2
        edited = text[: len(text) - k] + texts[j][1][:k]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint_by_loops(text), fingerprint_by_loops(edited))
        both = len(sets[i] | sets[j])
        off.append(abs(r["near_next"] - (len(sets[i] & sets[j]) / both if both else 1.0)))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03


def near_by_loops(texts):
    """doc_id -> (set size, smallest id that links reach)."""
    import re

    sets, holders = {}, {}
    for key, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[key]:
            holders.setdefault(s, []).append(key)
    top = {k: k for k in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for pair in {(x, y) for v in holders.values() if len(v) > 1 for x in v for y in v if x < y}:
        x, y = (sets[k] for k in pair)
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted(map(find, pair))
            top[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("paired", [256, 2])
def test_near_duplicates_of_the_corpus(spark, texts, monkeypatch, paired):
    from edgeloom.llm import near

    monkeypatch.setattr(near, "PAIRED", paired)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10(spark, SF).collect()}
    assert got == near_by_loops(texts) and any(k != c for k, (_, c) in got.items())


def decontaminated_by_loops(text, items):
    """None: contaminated; else the text without its long hit spans."""
    import re

    from edgeloom.llm.decontam import WORD

    found = list(WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text)))
    words, hit = [m[0] for m in found], set()
    for item in items:
        n = min(13, len(item))
        for i in range(len(words) - n + 1) if n else ():
            if any(words[i : i + n] == item[j : j + n] for j in range(len(item) - n + 1)):
                hit.update(range(i, i + n))
    if hit and 20 * len(hit) >= len(words):
        return None
    begins, out, i = [m.start() for m in found] + [len(text)], "", 0
    spans = []
    while i < len(words):
        j = i
        while j in hit:
            j += 1
        if j - i >= 13:
            spans.append((begins[i], begins[j]))
        i = max(j, i + 1)
    at = 0
    for a, b in spans:
        out += text[at:a]
        at = b
    return out + text[at:]


def test_the_whole_pipeline(spark, texts, monkeypatch):
    import re

    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    import regex
    from edgeloom.llm import langid, pieces
    from edgeloom.llm.decontam import words

    monkeypatch.setattr(langid, "STEPS", 30)  # what language a text gets changes no row of the result
    left = [(k, t) for k, t in texts if regex.search(r"\p{L}", t)]
    comp = near_by_loops(left)
    left = [(k, t) for k, t in left if comp[k][1] == k]
    seen, cut = set(), []
    for key, text in left:
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", text), set()
        for i in range(len(w) - 19):
            s = tuple(w[i : i + 20])
            gone.update(range(i, i + 20) if s in seen else ())
            seen.add(s)
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
        if text or not gone:
            cut.append((key, text))
    items = [words(r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        machine = pieces.load(f.read())
    want = {}
    for key, text in cut:
        text = decontaminated_by_loops(text, items)
        if text is not None:
            ids = machine.encode(text)
            want[key] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) < len(texts)


def test_pipeline_edges(spark, edge_docs, tmp_path, monkeypatch):
    import corpus_pipeline
    from edgeloom.llm import langid

    monkeypatch.setattr(langid, "STEPS", 5)
    bench = spark.createDataFrame([(1, "nothing of it"), (2, None)], "item_id long, text string")
    for name, docs in (("edges", edge_docs), ("none", edge_docs.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "edges")).collect()]
    # 1 is a copy of 0, and 5 and the one without an id are like it; 2 to 4 have no letter; 7 loses all but its first window.
    assert len(got) == len(set(got)) and {6, 7, 8, -9} <= set(got) and not {1, 2, 3, 4} & set(got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
