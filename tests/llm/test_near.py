import random
import re

from edgeloom.llm import near


def brute(docs):
    sets = {}
    for key, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and x and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)), key=lambda v: (v is not None, v or 0))
                parent[q] = p
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(df).collect()}


def test_edges(edge_docs, distinct_docs):
    got, want = result(edge_docs), brute(distinct_docs)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert result(edge_docs.limit(0)) == {}


def test_chains_and_crowded_lists(spark):
    """Texts that drift word by word, so that many share values yet only neighbours are alike."""
    rng = random.Random(3)
    rows, words = [], [f"a{i}" for i in range(40)]
    for key in range(120):
        rows.append((key, " ".join(words)))
        for _ in range(2):
            at = rng.randrange(40)
            words[at] = f"b{key}x{at}" if rng.random() < 0.5 else words[at]
        if key % 10 == 9:
            words = [f"a{i}" for i in range(25)] + [f"c{key}x{i}" for i in range(15)]
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows_sorted := sorted(rows)) and rows_sorted
