"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

The automaton holds every word sequence that stands in an item. Words of a document are streamed through it and the
length of the longest item sequence ending at each word is tracked: a length of ``window`` or more ends an occurrence
of a window. Items shorter than a window count only as a whole.

The automaton is broadcast, so it takes at most PART_BYTES of item texts: a larger benchmark is dealt into parts by a hash
of the item, the documents are scanned once for each, and the spans and items of the parts are put together. The result is
the same.

A document of which a 1/share or more is hit is contaminated as a whole; from the others, hit spans of ``longest`` words
or more are removed.

Texts and items of any length are taken whole. Null or empty texts have no words; items without words are ignored; an empty benchmark hits nothing; an item_id on
several rows is one item that has the windows of each row. Repeated rows of one doc_id are one document in scan() and
digest(); clean() keeps rows as they come, judged alike. An empty table of documents gives an empty table.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
PART_BYTES = 2 << 20
LONGEST = 13
SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<array<int>>, contaminated boolean"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the root."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.grams: dict[tuple, set] = {}
        self.short: dict[int, dict[tuple, set]] = {}
        for name, item in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in item]
            if 0 < len(seq) < window:
                self.short.setdefault(seq[-1], {}).setdefault(tuple(seq), set()).add(name)
                continue
            last = 0
            for s in seq:
                last = self._extend(last, s)
            for i in range(len(seq) - window + 1):
                self.grams.setdefault(tuple(seq[i : i + window]), set()).add(name)

    def _state(self, nxt, link, length):
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p, q, s):
        """A copy of q for the sequences through p that are too short for q."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(s) == q:
            self.next[p][s] = copy
            p = self.link[p]
        return copy

    def _extend(self, p, s):
        if s in self.next[p]:
            q = self.next[p][s]
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, s)
        new = self._state({}, 0, self.length[p] + 1)
        while p != -1 and s not in self.next[p]:
            self.next[p][s] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][s]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, s)
        return new

    def scan(self, text_words: list[str]):
        """Hit spans (merged word ranges) and the items whose windows occur."""
        state = matched = 0
        spans, items = [], set()
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        seq = [self.ids.get(w, -1) for w in text_words]
        for i, s in enumerate(seq):
            begin = -1
            if s < 0:
                state = matched = 0
                continue
            while state and s not in nxt[state]:
                state = link[state]
                matched = length[state]
            if s in nxt[state]:
                state = nxt[state][s]
                matched += 1
            else:
                state = matched = 0
            if matched >= window:
                begin = i + 1 - window
                items |= self.grams[tuple(seq[begin : i + 1])]
            if s in short:
                for whole, names in short[s].items():
                    at = i + 1 - len(whole)
                    if at >= 0 and tuple(seq[at : i + 1]) == whole:
                        items |= names
                        begin = at if begin < 0 else min(begin, at)
            if begin >= 0:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, i + 1])
        return spans, items


def automaton(benchmark: DataFrame, window: int = 13) -> Automaton:
    b = benchmark.selectExpr("cast(item_id as string) item_id", "text")
    return Automaton([(r["item_id"], words(r["text"])) for r in b.orderBy("item_id", "text").collect()], window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per document: words, hit words, items, hit spans; contaminated if a 1/share of its words or more is hit."""
    size = benchmark.selectExpr("sum(octet_length(text)) n").first()["n"] or 0
    parts = -(-size // PART_BYTES) or 1
    d = c.documents(docs)
    if parts == 1:
        return _scan(d, benchmark, window, share)
    mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = [_scan(d, benchmark.where(mine == i), window, share) for i in range(parts)]
    last = "element_at(x, -1)"
    merged = f"aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<array<int>>), (x, y) -> if(size(x) > 0 and y[0] <= {last}[1], concat(slice(x, 1, size(x) - 1), array(array({last}[0], greatest({last}[1], y[1])))), concat(x, array(y))))"
    both = functools.reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.expr("array_sort(array_distinct(flatten(collect_list(item_ids))))").alias("item_ids"), F.expr(merged).alias("spans"))
    hit = both.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x[1] - x[0])"))
    return hit.select("doc_id", "n_words", "n_hit", "item_ids", "spans", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words").alias("contaminated"))


def _scan(d: DataFrame, benchmark: DataFrame, window: int, share: int) -> DataFrame:
    shared = d.sparkSession.sparkContext.broadcast(automaton(benchmark, window))

    def rows(batches):
        a = shared.value
        for batch in batches:
            out = []
            for key, text in zip(c.column(batch, "doc_id").to_pylist(), c.column(batch, "text").to_pylist()):
                w = words(text)
                spans, items = a.scan(w)
                hit = sum(e - s for s, e in spans)
                out.append((key, len(w), hit, sorted(x for x in items if x is not None), spans, hit > 0 and share * hit >= len(w)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.bool_()))],
                names=["doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated"],
            )

    return c.own_id(d.mapInArrow(rows, SCHEMA))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.selectExpr("doc_id", "n_words", "n_hit", "cast(size(item_ids) as long) n_items", "sha2(concat_ws(',', array_sort(item_ids)), 256) items_sha256", "contaminated")


def without(text: str, spans: list, longest: int) -> str:
    """The text without its hit spans of that many words or more, from their first word to the next word after them.

    A span at the end goes with what follows its last word.
    """
    begins = [m.start() for m in WORD.finditer(text.translate(ASCII_LOWER))] + [len(text)]
    out, at = [], 0
    for s, e in spans:
        if e - s >= longest:
            out.append(text[at : begins[s]])
            at = begins[e]
    return "".join(out) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, longest: int = LONGEST) -> DataFrame:
    """The documents that are not contaminated, with all their columns; ``text`` without the long hit spans."""
    spark = docs.sparkSession
    found = scan(docs, benchmark, window, share).where("n_hit > 0").selectExpr("doc_id _id", "contaminated _bad", "spans _spans")
    schema = docs.schema

    def rows(batches):
        for batch in batches:
            text, spans = c.column(batch, "text"), c.column(batch, "_spans")
            if spans.null_count < len(spans):
                cut = [x and without(x, s, longest) if s else x for x, s in zip(text.to_pylist(), spans.to_pylist())]
                text = pa.array(cut, text.type)
            yield pa.RecordBatch.from_arrays([text if n == "text" else c.column(batch, n) for n in schema.names], names=schema.names)

    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left").where("_bad is null or not _bad")
    return joined.select(*schema.names, "_spans").mapInArrow(rows, schema)
