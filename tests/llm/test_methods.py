"""What the operators' methods promise, on small inputs."""

import itertools
import random

import numpy as np
import pytest
from edgeloom.llm import anchors, chat, common, decontam, langid, license, near, pieces, substrings, suffixes, units

SF = "/root/testdata/sf0.01"


def thue_morse(n, swap):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x.translate(str.maketrans("ab", "ba")) if swap else x


def test_long_words_that_weak_hashes_confuse(spark):
    x, y = thue_morse(1024, False), thue_morse(1024, True)
    first = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{first} {x}"), (2, f"{first} {y}"), (3, x), (4, y)], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.dedup(df).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    assert [r["component_id"] for r in near.near_duplicates(df).orderBy("doc_id").collect()] == [1, 1, 3, 4]  # 15 of 17 shingles are shared by 1 and 2


def by_column(strings):
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    return suffixes.column_wise(data, np.cumsum(size) - size, size)


@pytest.mark.parametrize("seed", range(4))
def test_column_wise_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab" if seed < 2 else b"abcdefgh") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    strings += strings[:3]
    common_, owner, length = by_column(strings)
    found = [strings[o][len(strings[o]) - n :] for o, n in zip(owner.tolist(), length.tolist())]
    assert found == sorted(s[i:] for s in strings for i in range(len(s)))
    for a, b, n in zip(found, found[1:], common_[1:].tolist()):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == same


def test_subtree_leaves_and_depths():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, 400).astype(np.int32)
    at, size = np.array([0, 100, 250]), np.array([90, 150, 150])
    string, offset, depth = substrings.subtree(x, at, size, 20)
    leaves = [tuple(x[at[s] + o : at[s] + o + 20].tolist()) for s, o in zip(string, offset)]
    assert leaves == sorted(leaves) and len(leaves) == (size - 19).sum()
    for a, b, n in zip(leaves, leaves[1:], depth[1:]):
        assert n == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), 20)


def test_least_between():
    rng = np.random.default_rng(6)
    v = rng.integers(0, 200, 500).astype(np.uint8)
    a = rng.integers(0, 499, 300)
    b = np.minimum(500, a + rng.integers(1, 200, 300))
    assert suffixes.least_between(v, a, b).tolist() == [v[i:j].min() for i, j in zip(a, b)]


def test_what_may_repeat_is_kept():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    text = suffixes.Bytes(data, np.array([0, 3000, 6000]))
    row, at, count, anchor, value = anchors.all_segments(text.seed, data, text.offs, 24, 8)
    keep = np.zeros(len(at), bool)
    for v in np.unique(value):
        k = np.flatnonzero(value == v)
        keep[k] = anchors.may_repeat(data, at[k], count[k] + 23, anchor[k] - at[k], 8, 24)
    windows = {}
    for i, (a, n) in enumerate(zip(at.tolist(), count.tolist())):
        for j in range(a, a + n):
            windows.setdefault(data[j : j + 24].tobytes(), set()).add(i)
    assert all(keep[list(s)].all() for s in windows.values() if len(s) > 1) and not keep.all()


def test_least_cost_of_all_segmentations():
    rng = random.Random(8)
    letters = "abc "
    for _ in range(20):
        made = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(8)} | {pieces.SPACE, pieces.SPACE + rng.choice("abc")}
        vocabulary = [(p, 300 + i, -rng.random() * 5 - 0.1) for i, p in enumerate(sorted(made))]
        machine = pieces.Transducer(vocabulary, list(range(256)))
        cost = {pieces.readings(p): -s for p, _, s in vocabulary}
        of = {i: c for (_, i, _), c in zip(vocabulary, (-s for _, _, s in vocabulary))}
        for _ in range(20):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
            whole = " " + text
            best = min(
                sum(cost.get(whole[a:b], machine.fallback if b - a == 1 else float("inf")) for a, b in zip(cuts, cuts[1:]))
                for r in range(len(whole)) for inner in itertools.combinations(range(1, len(whole)), r) for cuts in [(0, *inner, len(whole))]
            )
            ids = machine.encode(text)
            assert machine.decode(ids) == text and abs(sum(of.get(i, machine.fallback) for i in ids) - best) < 1e-9


def test_store_forgets_and_remembers():
    asked = []
    store = units.Store(lambda xs: asked.extend(xs) or [x * 4 for x in xs], 3)
    for _ in range(3):
        for x in (b"a", b"b", b"c", b"d", b"e"):
            assert store.ids([x, x + b"?"]) == [x * 4, (x + b"?") * 4]
    assert len(store.seen) <= 5 and len(store.old) <= 5 and asked.count(b"a") >= 1


def test_numerals_are_no_letters(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 10)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("½ ² 123", "x"), ("Ⅷ", "x"), ("hello there", "x"), ("ʰ", "y"), ("guten tag", "y"), ("123 a", "y")] * 2)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, False, False, False, False] * 2
    assert all(0 <= r["score"] <= 1 for r in got)


def test_scoring_is_the_network():
    rng = np.random.default_rng(9)
    h = langid.HIDDEN
    p = {"in": rng.normal(0, 0.3, (2, 256, 3 * h)).astype("f4"), "re": rng.normal(0, 0.3, (2, h, 3 * h)).astype("f4"), "out": rng.normal(0, 0.3, (2 * h, 3)).astype("f4"), "bias": rng.normal(0, 1, 3).astype("f4")}
    texts = [b"", b"a", rng.integers(32, 120, 200).astype(np.uint8).tobytes()]
    got = langid.text_probabilities(p, texts)
    for text, row in zip(texts, got):
        x = np.zeros((len(text) + 2 * langid.CONTEXT, 1), np.uint8)
        x[langid.CONTEXT : langid.CONTEXT + len(text), 0] = np.frombuffer(text, np.uint8)
        want = langid.probabilities(p, langid.states(p, x)[0])[langid.CONTEXT : langid.CONTEXT + len(text), 0]
        assert np.allclose(row, want.mean(0) if len(text) else 0, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = common.table(spark, SF, "documents")
    made = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = made.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 100 and right >= 0.95 * n


def test_a_benchmark_in_parts(spark, edge_docs, monkeypatch):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(words[a : a + rng.choice([1, 5, 13, 20])])) for i, a in enumerate(rng.choices(range(45), k=40))] + [(3, "one two"), (None, "w1 w2"), (99, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontam.digest(decontam.scan(edge_docs, bench)).collect()))
    spans = sorted(map(str, decontam.scan(edge_docs, bench).select("doc_id", "spans").collect()))
    monkeypatch.setattr(decontam, "PART_BYTES", 300)
    assert sorted(map(str, decontam.digest(decontam.scan(edge_docs, bench)).collect())) == whole
    assert sorted(map(str, decontam.scan(edge_docs, bench).select("doc_id", "spans").collect())) == spans


def test_license_filters_drop_no_result(spark, monkeypatch):
    rng = random.Random(11)
    words = sorted({x for s in license.TEMPLATES.values() for x in s.split()})
    rows = []
    for i in range(150):
        text = ["x"] * rng.randrange(9)
        for x in rng.choice(list(license.TEMPLATES.values())).split():
            text += [x] * (rng.random() < 0.85) + [rng.choice(["x", *words]) for _ in range(rng.choice([0, 0, 1, 2]))]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, license.scan(df).collect()))
    every = "filter(sequence(0, size(w) - 1), p -> get(w, p) = token)"
    blocks = f"transform(sequence(greatest(p - {license.BLOCK - 1}, 0), p), q -> slice(w, q + 1, {license.BLOCK}))"
    monkeypatch.setattr(license, "BEST", license.BEST.replace(license.PLACES, every).replace(license.BLOCKS, blocks))
    assert sorted(map(str, license.scan(df).collect())) == want and "mit" in "".join(want)


def test_chat_of_long_texts_and_other_columns(spark):
    said = "</s>[INST]\\x" * 200_000
    rows = [(1, 0, "user", "é", "a", 5), (1, 1, "assistant", said, "b", 6), (1, 1, "assistant", said, "b", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, mask_start int")
    got = chat.read_back(chat.format(df)).first()
    assert (got["n_turns"], got["loss_chars"]) == (3, 2 * len(said))


def test_languages_of_equal_probability(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 0)
    monkeypatch.setattr(langid, "text_probabilities", lambda p, texts: np.full((len(texts), 2), 0.5))
    got = langid.identify(spark.createDataFrame([(i, "some words", x) for i, x in enumerate("baab")], "doc_id long, text string, lang string"))
    assert {r["score"] for r in got.collect()} <= {0.5} or {r["lang_pred"] for r in got.collect()} == {"a"}
