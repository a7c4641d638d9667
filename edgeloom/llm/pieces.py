"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled once. The normaliser has one state: it reads a character and writes it, but for a space,
which it writes as U+2581, and for a U+2581, for which it writes nothing that a piece could read. The lexicon is a trie
of the pieces, with the piece's id and cost at its final states. Byte fallback reads any character and writes its byte
pieces at a cost above every piece's. Normaliser and lexicon are composed at compile time, so that the trie's arcs read
the text itself. Composed with an input, the shortest path in the tropical semiring (least total cost; ties: the longer
last piece) is the encoding. A space is put before each text that is not empty; decoding takes it away again.

No path crosses a place whose two neighbouring bytes never stand next to each other in a piece, so a text falls apart
there into units, and each distinct unit is solved once for a batch and remembered in a bounded store.

The vocabulary was made for merging by rank and has ranks in place of log probabilities, so a piece of rank r costs
4 + ln(20 + r): few pieces first, then frequent ones. The least total isn't always what merging gives, so ids can
differ from the merging encoder's of the same vocabulary (see README for the share); both decode to the same text.

Null is an empty text: no ids. A text of any length is taken whole. Repeated rows of one doc_id are one document. An
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from . import units as u

SPACE = "\u2581"
SLICE = 2 << 20
REMEMBERED = 100_000
SCHEMA = "doc_id long, ids array<int>, text string"


def normalised(ch: str) -> str | None:
    """What the normaliser writes for a character; None: nothing that a piece reads."""
    return {" ": SPACE, SPACE: None}.get(ch, ch)


def readings(piece: str) -> str:
    """The text that the normaliser turns into this piece."""
    return piece.replace(SPACE, " ")


class Transducer:
    """Normaliser o lexicon, and byte fallback beside it; see the module."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        self.trie: list[dict] = [{}]
        self.final: list[tuple[int, float] | None] = [None]
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True  # never inside a character
        for piece, i, score in pieces:
            text = readings(piece)
            if any(normalised(x) != y for x, y in zip(text, piece)):
                raise ValueError(f"no text is normalised to piece {piece!r}")
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} spans words")
            state = 0
            for ch in text:
                nxt = self.trie[state].get(ch)
                if nxt is None:
                    nxt = self.trie[state][ch] = len(self.trie)
                    self.trie.append({})
                    self.final.append(None)
                state = nxt
            self.final[state] = (i, -score)
            raw = text.encode()
            for x, y in zip(raw, raw[1:]):
                self.joined[x, y] = True
        self.fallback = 10.0 + max((-s for _, _, s in pieces), default=0.0)
        self.byte_ids = byte_ids
        raw = {i: readings(p).encode() for p, i, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        size = np.array([len(raw.get(i, b"")) for i in range(max(raw) + 1)], np.int64)
        self.size, self.begin = size, np.cumsum(size) - size
        self.raw = np.frombuffer(b"".join(raw.get(i, b"") for i in range(len(size))), np.uint8)
        self.store = u.Store(lambda units: [np.array(self.shortest(x.decode()), "<u4").tobytes() for x in units], REMEMBERED)

    def shortest(self, unit: str) -> list[int]:
        n = len(unit)
        trie, final = self.trie, self.final
        cost = [0.0] + [float("inf")] * n
        back: list = [None] * (n + 1)
        for i in range(n):
            here, state, j = cost[i], 0, i
            while j < n:
                state = trie[state].get(unit[j])
                if state is None:
                    break
                j += 1
                end = final[state]
                if end is not None and here + end[1] < cost[j]:
                    cost[j], back[j] = here + end[1], (i, end[0])
            if here + self.fallback < cost[i + 1]:
                raw = unit[i].encode()
                if here + self.fallback * len(raw) < cost[i + 1]:
                    cost[i + 1], back[i + 1] = here + self.fallback * len(raw), (i, [self.byte_ids[b] for b in raw])
        out, at = [], n
        while at:
            at, made = back[at]
            out.append(made)
        flat: list[int] = []
        for made in reversed(out):
            flat += made if isinstance(made, list) else [made]
        return flat

    def encode_all(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after the other, and where each text's begin; data, offs: their bytes."""
        some = np.flatnonzero(np.diff(offs))
        data = np.insert(data, offs[some], 32)
        begin = offs[some] + np.arange(len(some))
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined[data[:-1], data[1:]]
        cut[begin] = True
        bounds = np.append(np.flatnonzero(cut), len(data))
        ids, at = u.gathered(data, bounds, np.ones(len(bounds) - 1, bool), self.store)
        count = np.zeros(len(offs) - 1, np.int64)
        count[some] = np.diff(np.append(at[np.searchsorted(bounds, begin)], len(ids)))
        return ids, np.concatenate([[0], np.cumsum(count)])

    def decode_all(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts that have these ids, and where each text's begin."""
        size = self.size[ids]
        data = self.raw[u.spread_out(self.begin[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[offs]
        some = np.flatnonzero(np.diff(ends))
        data = np.delete(data, ends[some])
        return data, ends - np.searchsorted(some, np.arange(len(ends)))

    def encode(self, text: str) -> list[int]:
        return self.encode_all(*c.utf8(pa.array([text])))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode()


@functools.lru_cache(maxsize=1)
def load(model_bytes: bytes) -> Transducer:
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_proto=model_bytes)
    ids = range(m.get_piece_size())
    pieces = [(m.id_to_piece(i), i, -(4 + math.log(20 - m.get_score(i)))) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    by_byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
    return Transducer(pieces, [by_byte[b] for b in range(256)])


def made(docs: DataFrame, model_path: str, columns, schema: str) -> DataFrame:
    """doc_id and columns(ids, where each text's begin, decoded bytes, where each text's begin)."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches):
        machine = load(model.value)
        for batch, lo, hi, data, offs in c.text_slices(batches, SLICE):
            ids, at = machine.encode_all(data, offs)
            cols = {"doc_id": c.column(batch, "doc_id")[lo:hi]} | columns(ids, at, *machine.decode_all(ids, at))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return c.own_id(c.documents(docs).mapInArrow(rows, schema))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, and the text decoded from the ids."""

    def columns(ids, at, data, offs):
        lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
        texts = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
        return {"ids": lists, "text": texts.cast(pa.string())}

    return made(docs, model_path, columns, SCHEMA)


def each_sha256(data: bytes, offs: list[int]) -> pa.Array:
    view = memoryview(data)
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offs, offs[1:])], pa.string())


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """digest(encode()) in one pass, without sending ids and texts through the engine."""

    def columns(ids, at, data, offs):
        return {"n_tokens": pa.array(np.diff(at)), "ids_sha256": each_sha256(ids.astype("<u4").tobytes(), (4 * at).tolist()), "decoded_sha256": each_sha256(data.tobytes(), offs.tolist())}

    return made(docs, model_path, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, the digest of the ids (little-endian unsigned 32-bit) and of the decoded text."""

    def rows(batches):
        for batch in batches:
            made = c.column(batch, "ids")
            n, sha = [], []
            for x in made:
                v = x.values.to_numpy().astype("<u4")
                n.append(len(v))
                sha.append(hashlib.sha256(v.tobytes()).hexdigest())
            text = [hashlib.sha256(x.encode()).hexdigest() for x in c.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([c.column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
