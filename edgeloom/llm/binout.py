"""Token ids in Simple-8b blocks.

A 64-bit word holds a selector (its 4 high bits) and as many ids of equal width as fit into 60 bits. Ids of 2**60 or
more are escapes: the block stores their places and values apart and a zero in the stream. Blocks hold whole documents
in ascending doc_id order, with the lengths of each and the offset of the block's first id, so that any block decodes
alone. Null texts are empty and get the end id only; an empty table gives no blocks.

Where no token of a tokenizer can span a space (see ``apart_at_spaces``), the ids of a text are those of its units: the
stretches between ASCII white space; ASCII stretches without an apostrophe or a control character fall apart further into
runs of letters, digits and runs of other characters, with A-Z lowered, as the tokenizer does itself. Each distinct unit
of a batch is encoded once by the library and the ids are remembered in a bounded store. Texts that hold the beginning
of an added token, and all texts of other tokenizers, are encoded whole. Both give the same ids.

Texts of any length are taken whole (a block holds one document at least). Repeated rows of one doc_id are one document.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import tokens as t
from . import units as u
from .units import LONGEST_REMEMBERED  # noqa: F401

#: Bits of an id for each selector; a word holds 60 // bits ids.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // WIDTHS
BLOCK_IDS = 1 << 16
BLOCK = "part int, block long, first long, ids_n long, doc_ids binary, lengths binary, n_words long, words binary, escapes binary"
SLICE = 4 << 20

# The steps known to treat the stretches between ASCII spaces apart.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: What a byte is: ASCII white space, a digit, a letter, another printable character, or one that keeps a stretch whole.
BLANK, DIGIT, LETTER, OTHER, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = OTHER
KIND[[32, *range(9, 14)]] = BLANK
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[ord("'")] = ODD


def apart_at_spaces(tokenizer: str) -> bool:
    """Whether the ids of a text are those of its stretches between spaces, one after the other.

    So it is where the normaliser looks at single characters or composes them (nothing composes with an ASCII space),
    and the first split keeps only matches of a pattern that holds no space.
    """
    t = json.loads(tokenizer)
    normal, pre = t.get("normalizer") or {}, t.get("pre_tokenizer") or {}
    if any(t.get(x) for x in ("truncation", "padding", "post_processor")) or pre.get("type") != "Sequence" or normal.get("type") != "Sequence":
        return False
    first, *rest = pre["pretokenizers"]
    return (
        all(x in NORMALIZERS for x in normal["normalizers"])
        and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
        and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or set(a["content"]) & set(" \t\n\r") for a in t["added_tokens"])
    )


class Encoder:
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.apart = apart_at_spaces(tokenizer)
        self.added = [x["content"][:2].lower().encode() for x in json.loads(tokenizer).get("added_tokens", ())]
        self.store = u.Store(self.units)
        # Tokens at the end of a word: the last one of each unit that is one match of SPLIT.
        suffix = (json.loads(tokenizer).get("model") or {}).get("end_of_word_suffix") or ""
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit: many at once, apart at their last tokens, where each unit is one word to the tokenizer."""
        made: list[bytes | None] = [None] * len(units)
        alone = self.words_among(units)
        for lo in range(0, len(alone), 4096):
            part = alone[lo : lo + 4096]
            joined = [b" ".join([units[i] for i in part[k : k + 64]]).decode() for k in range(0, len(part), 64)]
            ids = np.frombuffer(b"".join(self.whole(joined)), "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part) and last[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * last).tolist()
                for i, a, b in zip(part, [0, *ends], ends):
                    made[i] = raw[a:b]
        rest = [i for i, x in enumerate(made) if x is None]
        for i, x in zip(rest, self.whole([units[i].decode() for i in rest])):
            made[i] = x
        return made

    @staticmethod
    def words_among(units: list[bytes]) -> list[int]:
        size = np.fromiter(map(len, units), np.int64, len(units))
        odd = np.concatenate([[0], np.cumsum(KIND[np.frombuffer(b"".join(units), np.uint8)] == ODD)])
        ends = np.cumsum(size)
        return np.flatnonzero(odd[ends] == odd[ends - size]).tolist()

    @property
    def seen(self) -> dict[bytes, bytes]:
        return self.store.seen

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, at = self.ids_of(*c.utf8(pa.array(texts, pa.large_string())))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])]

    def ids_of(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after the other, and where each text's begin; data, offs: their bytes."""
        n = len(offs) - 1
        low = t.LOWER[data]
        raw = low.tobytes()
        plain = np.full(n, self.apart)
        for x in self.added:
            at = raw.find(x)
            while at >= 0:
                row = int(np.searchsorted(offs, at, "right")) - 1
                plain[row] = False
                at = raw.find(x, int(offs[row + 1]))
        kind = KIND[low]
        first = np.zeros(len(data), bool)
        first[offs[:-1][np.diff(offs) > 0]] = True
        cut = first.copy()
        cut[1:] |= kind[1:] != kind[:-1]
        cut |= kind == DIGIT
        word = kind != BLANK
        begins = first & word
        begins[1:] |= word[1:] & ~word[:-1]
        stretch = np.cumsum(begins, dtype=np.int32) - 1
        odd = np.zeros(int(stretch[-1]) + 2 if n and len(data) else 1, bool)
        odd[stretch[kind == ODD]] = True
        whole = odd[stretch] & word
        cut &= ~whole | begins
        units = np.where(whole, data, low)
        bounds = np.append(np.flatnonzero(cut), len(data))
        ids, at = u.gathered(units, bounds, word[bounds[:-1]], self.store)
        at = at[np.searchsorted(bounds, offs)]
        if plain.all():
            return ids, at
        texts = [data[offs[i] : offs[i + 1]].tobytes().decode() for i in np.flatnonzero(~plain)]
        made = iter(self.whole(texts))
        parts = [ids[at[i] : at[i + 1]] if plain[i] else np.frombuffer(next(made), "<u4") for i in range(n)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@functools.lru_cache(maxsize=1)
def encoder(tokenizer: str) -> Encoder:
    """One for each Python worker, which keeps what it remembers from task to task."""
    return Encoder(tokenizer)


def narrowest(values: np.ndarray) -> np.ndarray:
    """The first selector whose width holds each value."""
    return np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), values, "right").astype(np.int8)


SMALL = narrowest(np.arange(1 << 16, dtype=np.uint64))


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escape places, escape values)."""
    ids = np.asarray(ids, np.uint64)
    at = np.flatnonzero(ids >> np.uint64(60))
    plain = ids.copy()
    plain[at] = 0
    n = len(ids)
    padded = np.concatenate([plain, np.zeros(60, np.uint64)])
    least = SMALL[(padded & np.uint64(0xFFFF)).astype(np.uint16)]
    large = np.flatnonzero(padded >> np.uint64(16))
    least[large] = narrowest(padded[large])
    # The widest id among the next 1, 2, 4, .. 32 ones; any run is two of those.
    runs = [least]
    while len(runs) < 6:
        half = 1 << len(runs) - 1
        runs.append(np.maximum(runs[-1][:-half], runs[-1][half:]))
    best = np.full(n, len(WIDTHS) - 1, np.int8)
    for k in range(len(WIDTHS) - 2, -1, -1):
        count = int(COUNTS[k])
        run = runs[min(len(runs), count.bit_length()) - 1]
        size = 1 << min(len(runs), count.bit_length()) - 1
        best[np.maximum(run[:n], run[count - size : count - size + n]) <= k] = k
    step, starts, i = COUNTS[best].astype(np.uint8).tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    chosen = best[starts] if n else np.zeros(0, np.int8)
    out = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        rows = np.flatnonzero(chosen == k)
        for j in range(COUNTS[k]):
            out[rows] |= padded[starts[rows] + j] << np.uint64(j * WIDTHS[k])
    return out, at, ids[at]


def decode(words: np.ndarray, n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(COUNTS[selector])]).astype(np.int64)
    out = np.zeros(int(begin[-1]), np.uint64)
    for k in np.unique(selector):
        rows = np.flatnonzero(selector == k)
        for j in range(COUNTS[k]):
            out[begin[rows] + j] = (words[rows] >> np.uint64(j * WIDTHS[k])) & np.uint64((1 << int(WIDTHS[k])) - 1)
    out = out[:n]
    out[at] = values
    return out


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> str:
    """Encode every text and write the blocks; returns the folder."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    path = path or c.scratch(spark, "ids")

    def rows(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        machine = encoder(model.value)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        keys, parts, lengths, size = [], [], [], 0

        def flush():
            nonlocal block, first, keys, parts, lengths, size
            ids = np.concatenate(parts)
            words, at, values = encode(ids)
            made = (part, block, first, len(ids), np.concatenate(keys).astype("<i8").tobytes(), np.concatenate(lengths).astype("<i8").tobytes(), len(words), words.astype("<u8").tobytes(), c.pack(at.astype("<i8"), values))
            block, first, keys, parts, lengths, size = block + 1, first + len(ids), [], [], [], 0
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            names = ["part", "block", "first", "ids_n", "doc_ids", "lengths", "n_words", "words", "escapes"]
            return pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip(made, types)], names=names)

        for batch, lo, hi, data, offs in c.text_slices(c.joined(batches, SLICE), SLICE):
            docs_ = c.longs(batch, "doc_id")[lo:hi]
            ids, at = machine.ids_of(data, offs)
            ids = np.insert(ids.astype(np.uint64), at[1:], np.uint64(end_id))
            at = at + np.arange(len(at))
            i = 0
            while i < len(docs_):
                j = min(len(docs_), max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_IDS - size))))
                keys.append(docs_[i:j])
                parts.append(ids[at[i] : at[j]])
                lengths.append(np.diff(at[i : j + 1]))
                size += int(at[j] - at[i])
                i = j
                if size >= BLOCK_IDS:
                    yield flush()
        if keys:
            yield flush()

    d = c.documents(docs)
    d = d.repartitionByRange(c.partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    d.mapInArrow(rows, BLOCK).write.mode("overwrite").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the written blocks."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("ids_n").alias("n")).collect()}
    before, run = {}, 0
    for p in sorted(totals):
        before[p], run = run, run + totals[p]

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode(np.frombuffer(r["words"], "<u8"), r["ids_n"], *c.unpack(r["escapes"])).astype("<u4")
                lengths, keys = np.frombuffer(r["lengths"], "<i8"), np.frombuffer(r["doc_ids"], "<i8")
                ends = np.cumsum(lengths)
                begin = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(begin + r["first"] + before[r["part"]]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return c.own_id(blocks.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long"))
