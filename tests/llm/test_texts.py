import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from edgeloom.llm import binout, chat, decontam, fingerprint, langid, license, pieces

P = pytest.importorskip("public_tokenizers")


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 61, 2000):
        ids = rng.integers(0, 2**62, n).astype(np.uint64) >> rng.integers(0, 62, n).astype(np.uint64)
        words, at, values = binout.encode(ids)
        assert (binout.decode(words, n, at, values) == ids).all()


def test_token_files(spark, edge_docs, distinct_docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in binout.read(spark, binout.write(edge_docs, path)).collect()}
    t, start = Tokenizer.from_file(path), 0
    for key, text in distinct_docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(got[key])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert binout.read(spark, binout.write(edge_docs.limit(0), path)).count() == 0


def test_pieces_round_trip(edge_docs, distinct_docs):
    path = P.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r["text"] for r in pieces.encode(edge_docs, path).collect()}
    assert got == dict(distinct_docs)
    assert pieces.digest(pieces.encode(edge_docs.limit(0), path)).count() == 0


def test_shortest_path_takes_the_least_cost():
    t = pieces.Transducer([("a", 300, -1.0), ("b", 301, -1.0), ("ab", 302, -3.0), ("bc", 303, -0.5), ("c", 304, -4.0), (pieces.SPACE, 305, 0.0)], list(range(256)))
    assert t.encode("abc") == [305, 300, 303]
    assert t.decode(t.encode("aßb")) == "aßb"


def test_decontamination(spark, edge_docs):
    item = " ".join(f"w{i}" for i in range(10, 30))
    bench = spark.createDataFrame([(1, item), (2, "ONE two"), (3, None), (4, ""), (None, "w1 w2 w3")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.digest(decontam.scan(edge_docs, bench)).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["n_items"], got[0]["contaminated"]) == (60, 23, 1, True)
    assert (got[8]["n_hit"], got[8]["items_sha256"]) == (2, hashlib.sha256(b"2").hexdigest())
    assert (got[2]["n_words"], got[2]["n_hit"], got[2]["contaminated"]) == (0, 0, False)
    assert decontam.scan(edge_docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.scan(edge_docs.limit(0), bench).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "a<s>\\[/INST]<\\s>"), (1, 0, "user", None), (1, 1, "assistant", "a<s>\\[/INST]<\\s>"), (None, None, None, "x"), (2, 0, "as[INST]", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format(df)).collect()}
    said = "a<s>\\[/INST]<\\s>"
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n\nassistant\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2 * len(said), hashlib.sha256((said * 2).encode()).hexdigest())
    assert got[2]["turns_sha256"] == hashlib.sha256(b"as[INST]\n</s>\n").hexdigest() and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format(df.limit(0))).count() == 0


def test_license(spark, edge_docs):
    rows = [(1, "All Rights RESERVED. cc by all rights reserved"), (2, "x " * 50 + license.TEMPLATES["mit-text"]), (3, None), (4, "cc byx")]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert tuple(got[1])[1:7] == (8, 3, 0, 5, "cc-by,reserved", "cc-by,reserved")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "mit-text", 1.0)
    assert tuple(got[3])[1:] == (0, 0, None, None, "", "", 0.0) and got[4]["labels"] == ""
    assert license.scan(edge_docs).count() == 11 and license.scan(edge_docs.limit(0)).count() == 0


def test_fingerprints(edge_docs, distinct_docs):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(edge_docs).collect()}
    for i, (key, text) in enumerate(distinct_docs):
        edited = fingerprint.edit(text, distinct_docs[(i + 1) % len(distinct_docs)][1])
        assert (got[key]["n_chars"], got[key]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(edge_docs.limit(0)).count() == 0


def test_gradients_are_the_differences(monkeypatch):
    monkeypatch.setattr(langid, "HIDDEN", 3)
    rng = np.random.default_rng(0)
    p = {"in": rng.normal(size=(2, 256, 9)), "re": rng.normal(size=(2, 3, 9)), "out": rng.normal(size=(6, 3)), "bias": np.zeros(3)}
    x, y = rng.integers(0, 256, (5, 4)), rng.integers(0, 3, 4)
    _, g = langid.gradients(p, x, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss = []
        for step in (1e-3, -2e-3):
            p[k][at] += step
            loss.append(langid.gradients(p, x, y)[0])
        p[k][at] += 1e-3
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][at]) < 1e-3


def test_language_edges(edge_docs, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 20)
    got = {r["doc_id"]: r for r in langid.identify(edge_docs).collect()}
    assert len(got) == 11 and all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4))
    assert got[0]["held_out"] == (zlib.crc32(b"0") % 5 == 0)
    assert {r["lang_pred"] for r in langid.identify(edge_docs.limit(0).union(edge_docs.where("doc_id = 8"))).collect()} == {"und"}


def license_brute(text):
    """Labels and best share over the blocks at every word."""
    w, out = license_words(text), {}
    for name, template in license.TEMPLATES.items():
        tokens = set(template.split())
        n = max((len(tokens & set(w[i : i + license.BLOCK])) for i in range(len(w))), default=0)
        if 100 * n >= license.CONTAINMENT * len(tokens):
            out[name] = n / len(tokens)
    return ",".join(sorted(out)), max(out.values(), default=0.0)


def license_words(text):
    return re.findall(license.WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def test_license_words(spark):
    rows = ["".join(map(chr, range(300))), " a  B\x00c\u2003d\tİK\U0001f600-_9 ", "", " ", "\x7fé"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"]: r["w"] for r in license.words(df).collect()} == {i: license_words(x) for i, x in enumerate(rows)}


def test_license_blocks_at_every_word(spark):
    rng = random.Random(5)
    rows = []
    for gap in (7, 8):
        first, rest = license.TEMPLATES["apache-2.0-text"].split()[:4], license.TEMPLATES["apache-2.0-text"].split()[4:]
        passage = [*first, *("between" for _ in range(gap)), *rest]
        rows += [" ".join(["x"] * before + passage + ["y"] * 40) for before in range(33)]
    words = sorted({x for s in license.TEMPLATES.values() for x in s.split()})
    for _ in range(200):
        text = ["x"] * rng.randrange(40)
        for _ in range(rng.randrange(1, 4)):
            for x in rng.choice(list(license.TEMPLATES.values())).split():
                if rng.random() < 0.9:
                    text += [x, *(rng.choice(["x", rng.choice(words)]) for _ in range(rng.choice([0, 0, 0, 1, 2, 3])))]
            text += ["x"] * rng.randrange(20)
        rows.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license.scan(df).where("n_base = 0").collect()}
    want = {i: license_brute(rows[i]) for i in got}
    assert len(got) > 200 and got == want
    assert all(got[i] == ("apache-2.0-text", 1.0) for i in range(66))


def test_long_hit_spans_are_removed(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    item = [f"W{i}" for i in range(300)]
    filler = lambda n: [f"f{rng.randrange(9999)}" for _ in range(n)]
    rows = [
        (1, " ".join([*filler(4000), *item, *filler(4000)])), (2, " ".join(filler(50) + item)), (3, "free, text."), (4, None), (None, "İ, " * 9000 + ", ".join(item) + "; é"),
        (5, " ".join([*filler(400), *item[:13], *filler(9), *item[20:32], "f", "one", "two", *filler(5), *item[40:60]] + filler(400))),
    ]
    bench = spark.createDataFrame([(1, " ".join(item).lower()), (2, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 4, None, 5}
    for key, text in rows:
        if key in got:
            w = (text or "").split(" ")
            want = {1: w[:4000] + w[4300:], None: w[:9000] + ["é"], 5: w[:400] + w[413:442] + w[462:]}.get(key, w)
            assert (got[key]["text"] or "") == " ".join(want)
            assert got[key]["n_chars"] == (7 if key in (3, 4) else len(" ".join(want)))
    left = decontam.scan(docs.sparkSession.createDataFrame([(k, r["text"]) for k, r in got.items()], "doc_id long, text string"), bench)
    assert left.selectExpr("explode(spans) s").where("s[1] - s[0] >= 13").count() == 0


def test_repeated_template_words_are_one_token(spark):
    df = spark.createDataFrame([(1, "permission hereby " * 16)], "doc_id long, text string")
    assert license.scan(df).first()["score"] == 0.0
