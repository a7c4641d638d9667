"""Near-duplicate documents by bottom-k sketches from one hash function.

A document of n shingles keeps the first k = n - ceil(3n / 4) + 1 + floor(n / 10) of their hashes in one global order (for a
similarity of 75 %). The order puts hashes from crowded buckets of a fixed count table behind the others and goes by hash
otherwise; whatever the table says it is the same for all documents. Of two documents that are that alike, with c retained
values in common, the union of both sketches ends where the shorter one ends, so what they share beyond it is at most what
that document has not retained: c + max(n_a - k_a, n_b - k_b) is no less than the intersection that is needed. It follows
that both share floor(n / 10) or more of their values with others, so that

1. documents of equal sets (equal 128-bit digests of all hashes) form a class, and only its smallest id goes on;
2. inverted lists of retained values tell which values stand in more than one sketch, and documents with too few of those
   go, before any set is moved;
3. of the rest, documents go of which less than 75 % of the whole set stands in others;
4. each list links its smallest id with the others; the full sets of these pairs are compared, and components follow, so
   that a group of thousands of copies is settled by about as many pairs;
5. in lists that still hold several components, overlaps are counted for pairs of different components, the bound above
   drops pairs by what the union of their sketches lets them share, and the rest are confirmed on full sets;
6. in lists of more than PAIRED documents nothing is counted: each counts as one that a pair may share, and pairs that share
   such lists alone come from the few of them that a prefix filter leaves, under the same bound.

No candidate is dropped but by these bounds, so no link is lost. Lists, links and components are tables; only the count
table and a filter of set members, both of fixed size, pass through the driver.

Null, empty and blank texts have empty sets and are linked with nothing; texts of fewer words than a shingle are one
shingle; texts of any length are taken whole. Ties go to the smallest id, a null id being smallest. Repeated rows of one
doc_id are one document. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from . import repeats as r
from . import tokens as t

BUCKETS = 1 << 21
SLABS = 64
SPREAD = 10
BIN_VALUES = 1 << 20
FILTER_BITS = 1 << 25
PAIRED = 256
KEY_DDL = "doc_id long, n long, h1 long, h2 long, slab int, counts binary"


def shingle_sets(data, offs, words):
    """Sorted distinct shingle hashes of each document."""
    g, at = t.shingles(data, offs, words)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield np.unique(g[a:b])


def retained(n, percent: int):
    """How many values a sketch of an n-element set keeps."""
    return np.minimum(n, n - -(-percent * n // 100) + 1 + n // SPREAD)


def bucket(values: np.ndarray) -> np.ndarray:
    return (values >> t.U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and a digest (h1, h2) of each document's set; beside them the counts of all buckets, by slab."""

    def rows(batches):
        total = np.zeros(BUCKETS, np.int64)
        names = [x.split()[0] for x in KEY_DDL.split(", ")]
        for batch, lo, hi, data, offs in c.text_slices(batches):
            got = list(shingle_sets(data, offs, words))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in got]
            made = dict(zip(digests, got))
            if made:
                total += np.bincount(bucket(np.concatenate(list(made.values()))), minlength=BUCKETS)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            n = len(got)
            cols = [c.column(batch, "doc_id")[lo:hi], pa.array([len(x) for x in got], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        blocks = [c.pack(x) for x in np.split(total, SLABS)] if total.any() else []
        empty = [pa.nulls(len(blocks), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*empty, pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=names)

    return docs.mapInArrow(rows, KEY_DDL)


def merged(df: DataFrame, how) -> dict[int, np.ndarray]:
    """Packed arrays by slab, those of one slab put together: as much as a fixed table holds."""

    def one(table: pa.Table) -> pa.Table:
        total = functools.reduce(how, (c.unpack(b)[0] for b in table["counts"].to_pylist()))
        return pa.table({"slab": table["slab"][:1], "counts": pa.array([c.pack(total)], pa.binary())})

    return {x["slab"]: c.unpack(x["counts"])[0] for x in df.select("slab", "counts").groupBy("slab").applyInArrow(one, "slab int, counts binary").collect()}


def crowded(keys: DataFrame) -> np.ndarray:
    """How crowded each bucket of shingle hashes is: 0 up to twice the mean, else the power of two above the mean."""
    total = np.zeros((SLABS, BUCKETS // SLABS), np.int64)
    for slab, counts in merged(keys.where("slab is not null"), np.add).items():
        total[slab] = counts
    total = total.reshape(-1)
    mean = max(total.mean(), 1e-9)
    return np.where(total > 2 * mean + 8, np.clip(np.log2(np.maximum(total, 1) / mean), 1, 31), 0).astype(np.uint8)


def sketches(docs: DataFrame, shared, words: int, percent: int) -> DataFrame:
    """(doc_id, n, kept): the retained values of each document that has any, in the global order."""

    def rows(batches):
        level = shared.value
        for batch, lo, hi, data, offs in c.text_slices(batches):
            docs_, n, kept = c.longs(batch, "doc_id")[lo:hi], [], []
            for x in shingle_sets(data, offs, words):
                order = np.sort((level[bucket(x)].astype(np.uint64) << t.U(59)) | (x & t.U((1 << 59) - 1)))
                n.append(len(x))
                kept.append(order[: int(retained(len(x), percent))].tobytes())
            some = np.array(n) > 0
            cols = [pa.array(docs_), pa.array(n, pa.int32()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "kept"]).filter(pa.array(some))

    return docs.mapInArrow(rows, "doc_id long, n int, kept binary")


def shared_values(sketched: DataFrame, bins: int, enough, schema: str = "value long, doc long, n int") -> DataFrame:
    """(value, doc, n): values in more than one sketch, of the documents that have enough(n) of them or more.

    With another schema, only those of its columns, once for each document. A value that several sketches of a slice hold is sent to its list once, so that a list is no longer than there are
    slices.
    """

    def deal(batches):
        for batch in batches:
            kept, offs = c.utf8(c.column(batch, "kept"))
            for lo, hi in c.slices(offs, 2 << 20):
                value = kept[offs[lo] : offs[hi]].view("<u8")
                count = np.diff(offs[lo : hi + 1]) // 8
                doc, n = np.repeat(c.longs(batch, "doc_id")[lo:hi], count), np.repeat(c.longs(batch, "n")[lo:hi], count).astype(np.int32)
                order = np.argsort(value, kind="stable")
                value, doc, n = value[order], doc[order], n[order]
                same = value[1:] == value[:-1]
                again = np.concatenate([[False], same])
                known = again | np.concatenate([same, [False]])
                yield r.rows_by_bin(1, c.bin_of(doc[known], bins), value[known], doc[known], n[known])
                one = ~again
                yield r.rows_by_bin(0, (value[one] % t.U(bins)).astype(np.int32), value[one], doc[one], n[one], known[one])

    def lists(table: pa.Table) -> pa.Table:
        table, blocks = r.settled(table)
        if not blocks:
            return table
        value, doc, n, known = (np.concatenate(x) for x in zip(*map(c.unpack, blocks)))
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        found = np.zeros(len(value), bool)
        found[order[1:]] |= same
        found[order[:-1]] |= same
        found &= ~known.astype(bool)
        return pa.concat_tables([table, pa.Table.from_batches([r.rows_by_bin(1, c.bin_of(doc[found], bins), value[found], doc[found], n[found])])])

    names = schema.split()[::2]

    def by_document(table: pa.Table) -> pa.Table:
        value, doc, n = (np.concatenate(x) for x in zip(*map(c.unpack, table["block"].to_pylist())))
        _, first, which, count = np.unique(doc, return_index=True, return_inverse=True, return_counts=True)
        stay = count[which] >= enough(n.astype(np.int64))
        if "value" not in names:
            once = np.zeros(len(doc), bool)
            once[first] = True
            stay &= once
        return pa.table({"value": value[stay].view(np.int64), "doc": doc[stay], "n": n[stay]}).select(names)

    dealt = sketched.mapInArrow(deal, r.BLOCK_DDL).groupBy(r.key(bins)).applyInArrow(lists, r.BLOCK_DDL)
    return dealt.groupBy("bin").applyInArrow(by_document, schema)


def filter_places(ids: np.ndarray) -> np.ndarray:
    h = t.mix(ids.view(np.uint64) + t.U(t.BASE))
    return np.stack([h % t.U(FILTER_BITS), (h >> t.U(32)) % t.U(FILTER_BITS)]).astype(np.int64)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, kept): the whole sets of the documents named in ids, made anew from their texts.

    A filter of fixed size says which texts to look at; it lets some others through, and none of those asked for is lost.
    """

    def mark(batches):
        bits = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            bits[filter_places(c.longs(batch, "doc")).reshape(-1)] = 1
        if bits.any():
            parts = np.split(np.packbits(bits), SLABS)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([c.pack(x) for x in parts], pa.binary())], names=["slab", "counts"])

    slabs = merged(ids.mapInArrow(mark, "slab int, counts binary"), np.bitwise_or)
    table = np.concatenate([slabs.get(i, np.zeros(FILTER_BITS // 8 // SLABS, np.uint8)) for i in range(SLABS)])
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches):
        bits = shared.value
        for batch in batches:
            at = filter_places(c.longs(batch, "doc_id"))
            here = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)
            part = batch.filter(pa.array(here))
            for _, lo, hi, data, offs in c.text_slices([part]):
                made = [x.tobytes() for x in shingle_sets(data, offs, words)]
                n = pa.array([len(x) // 8 for x in made], pa.int32())
                yield pa.RecordBatch.from_arrays([c.column(part, "doc_id")[lo:hi], n, pa.array(made, pa.binary())], names=["doc_id", "n", "kept"])

    return docs.mapInArrow(rows, "doc_id long, n int, kept binary").where("n > 0")


def alike(p, q, percent) -> bool:
    z = np.concatenate([p, q])
    z.sort(kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(z) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    x = sets.selectExpr("doc_id a", "kept x")
    y = sets.selectExpr("doc_id b", "kept y")

    def rows(batches):
        for batch in batches:
            one, two = (c.utf8(c.column(batch, k)) for k in ("x", "y"))
            keep = [
                alike(one[0][one[1][i] : one[1][i + 1]].view("<u8"), two[0][two[1][i] : two[1][i + 1]].view("<u8"), percent)
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        c.tidy()

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) for every document with a link: the smallest id that links reach."""
    both = c.through_table(links.unionByName(links.selectExpr("b a", "a b")).distinct(), "links")
    table = c.through_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("comp")), "labels")
    label = table
    while True:
        near = both.join(label.selectExpr("doc b", "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = label.join(near, label["doc"] == near["a"]).select("doc", F.least("comp", "m").alias("low"), "comp")
        far = label.selectExpr("doc low", "comp far")
        new = c.through_table(low.join(far, "low", "left").select("doc", F.least("low", F.coalesce("far", "low")).alias("new"), "comp"), "labels")
        c.drop(table)
        table, label = new, new.selectExpr("doc", "new comp")
        if not new.where("new <> comp").limit(1).count():
            c.drop(both)
            return label


def opened(lists: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, doc, n, comp, size, top, long): the lists that hold documents of several components; and its scratch table.

    top is the component that most documents of the list are of; long is how many lists of more than PAIRED documents the
    document stands in.
    """
    now = lists.join(label, "doc", "left").select("value", "doc", "n", F.coalesce("comp", "doc").alias("comp"))
    by_value = now.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp").alias("top"))
    left = c.through_table(now.join(by_value.where("lo < hi").drop("lo", "hi"), "value"), "open")
    out = left.join(left.groupBy("doc").agg(F.sum((F.col("size") > PAIRED).cast("long")).alias("long")), "doc")
    return out, left


def links_of(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc, comp) of the documents with a link. lists: see shared_values()."""
    fits = f"100L * least(n, pn) >= {percent}L * greatest(n, pn)"
    first = lists.groupBy("value").agg(F.min(F.struct("doc", "n")).alias("p")).selectExpr("value", "p.doc pd", "p.n pn")
    stars = lists.join(first, "value").where("doc <> pd").where(fits).selectExpr("pd a", "doc b").distinct()
    links = c.through_table(verify(stars, sets, percent), "confirmed")
    label = components(links)

    left, table = opened(lists, label)
    hidden = lambda n: f"({n} - least({n}, {n} - cast(ceil({percent}L * {n} / 100) as long) + 1 + {n} div {SPREAD}))"

    def enough(count: str, n: str, pn: str) -> str:
        """Whether that many shared values, and what both have not retained, can make two documents alike."""
        return f"{100 + percent}L * ({count} + greatest({hidden(n)}, {hidden(pn)})) >= {percent}L * ({n} + {pn})"

    def pairs(part: DataFrame) -> DataFrame:
        """Of the documents of a list, those of different components; those of its top component only with others."""
        other = part.selectExpr("value", "doc pd", "n pn", "comp pc", "long pl")
        return part.where("comp <> top").join(other, "value").where("comp <> pc and (pc = top or doc < pd)").where(fits)

    # Overlaps in lists of bounded size; each longer list may add one.
    one, two = "struct(doc, n, long)", "struct(pd as doc, pn as n, pl as long)"
    both = pairs(left.where(F.col("size") <= PAIRED)).selectExpr(f"least({one}, {two}) x", f"greatest({one}, {two}) y")
    counted = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("count"))
    near = counted.where(enough("count + least(x.long, y.long)", "x.n", "y.n")).selectExpr("x.doc a", "y.doc b")
    # Pairs that share values of longer lists alone: enough of them, so one of the first in an order of these lists.
    least = F.expr(f"greatest(1, n div {SPREAD})")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("size", "value"))
    long_ = left.where(F.col("size") > PAIRED).where(F.col("long") >= least).withColumn("nth", nth).where(F.col("nth") <= F.col("long") - least + 1)
    far = pairs(long_).where(enough("least(long, pl)", "n", "pn")).select(F.least("doc", "pd").alias("a"), F.greatest("doc", "pd").alias("b"))
    found = c.through_table(verify(near.unionByName(far).distinct(), sets, percent), "confirmed")
    out = components(links.unionByName(found)) if found.limit(1).count() else label
    c.drop(table, links, found)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    spark = docs.sparkSession
    d = c.documents(docs)
    keys = c.through_table(set_keys(d, words), "keys")
    every = keys.where("slab is null").select("doc_id", "n", "h1", "h2")
    some = every.where("n > 0")
    classes = some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # One class may hold a third of all rows: it is dealt to 16 keys.
    salted = some.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(16)))
    classes = classes.drop("copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    copies = c.through_table(salted.join(classes, ["h1", "h2", "n", "salt"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")

    shared = spark.sparkContext.broadcast(crowded(keys))
    values = every.agg(F.sum("n")).first()[0] or 0
    bins = max(c.partitions(spark), int(values * (100 - percent + 100 // SPREAD) // 100 // BIN_VALUES))
    # Written, so that no task runs two Python workers at once.
    sketched = c.through_table(sketches(d, shared, words, percent).join(copies.select("doc_id"), "doc_id", "left_anti"), "sketches")
    lists = c.through_table(shared_values(sketched, bins, lambda n: np.maximum(1, n // SPREAD)), "lists")
    c.drop(sketched)
    sets = c.through_table(full_sets(d, lists.select("doc").distinct(), words), "sets")
    alive = c.through_table(shared_values(sets, bins, lambda n: -(-percent * n // 100), "doc long"), "alive")
    label = links_of(lists.join(alive, "doc", "left_semi"), sets, percent)
    c.drop(lists, sets, alive)

    rep = every.join(copies, "doc_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("doc"))
    out = rep.join(label, "doc", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return c.own_id(c.own_id(out, "component_id"))
