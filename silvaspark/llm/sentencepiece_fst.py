"""SentencePiece encoding and decoding by weighted finite-state transducers.

Four machines are compiled from a model file:

* the *normaliser*, a deterministic transducer over characters (``NORMALISER``): a space becomes U+2581, the
  prefix comes first, and extra spaces go if the model asks for it;
* the *pieces*, a trie whose states are beginnings of pieces and whose final arcs emit a piece and return to the root;
* the *byte fallback*, arcs that read one character that is no piece and emit the pieces of its UTF-8 bytes;
* for BPE models the *order of merges*, an acceptor of piece sequences: it reads b after a with weight 0 if merging the
  characters of ab by the model's scores ends in exactly (a, b), and with infinite weight otherwise. A sequence all of
  whose neighbours agree is the one that merging the whole input gives. It is compiled lazily, arc by arc.

Encoding composes the input with the normaliser, the result with the closure of pieces and fallback (``lattice``) and that
with the order of merges, and takes the shortest path in the tropical semiring (``shortest``). Pieces of a unigram
model weigh minus their score, those of a BPE model nothing. Decoding is the inverse of pieces and fallback.

Where no piece holds U+2581 after another character, every path passes a cut before every such
place; the shortest paths between cuts are remembered by their input, within a bound of bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.llm import words as W

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(b: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            c = b[at]
            at += 1
            x |= (c & 127) << shift
            if c < 128:
                return x
            shift += 7

    while at < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, b[at : at + n]
            at += n


class Model:
    """Pieces, scores, types and switches of a serialised model."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for k, v in _fields(data):
            if k == 1:
                f = dict(_fields(v))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normalizer = dict(_fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        if trainer.get(24, 0):
            raise ValueError("white space as a suffix is not supported")
        if normalizer.get(2):
            raise ValueError("a model with its own character map is not supported")
        self.add_prefix = bool(normalizer.get(3, 1))
        self.remove_extra = bool(normalizer.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is not supported")


#: The normaliser that drops extra spaces, by state: (next state on a space, output) and (next state on another
#: character, output before it). States: 0 nothing read, 1 within a word, 2 spaces after a word.
NORMALISER = {0: ((0, ""), (1, "")), 1: ((2, ""), (1, "")), 2: ((2, ""), (1, SPACE))}


class Trie:
    """The transducer of the pieces: states are their beginnings, 0 is the root."""

    def __init__(self, pieces: dict[str, int]):
        self.step: list[dict[str, int]] = [{}]
        self.emit = [-1]
        for p, i in pieces.items():
            at = 0
            for c in p:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.emit.append(-1)
                at = self.step[at][c]
            self.emit[at] = i


def shortest(arcs: list[list[tuple[int, int, float]]], follows=None, once: bool = False) -> list[tuple[int, int, int]]:
    """Arcs (from, to, label) of the path of least weight through a lattice whose state k has the arcs (to, label,
    weight) ``arcs[k]``, all of them forward; the last state is final. ``follows(a, b)`` is the weight that another
    acceptor gives to arc b after arc a (a is None at the start): its states are the last arcs, so composed
    states are pairs of a place and the arc that led to it. ``once`` says that no place has more than one of finite
    weight; then arcs into a place that has one need no look. Of equal paths the one with the longer last arc is taken.
    """
    n = len(arcs)
    inf = float("inf")
    # by place: states (weight, arc into it, state before), one if no acceptor tells arcs apart
    reached: list[list[tuple[float, tuple[int, int, int] | None, tuple | None]]] = [[] for _ in range(n)]
    reached[0].append((0.0, None, None))
    for k in range(n):
        for state in reached[k]:
            for to, label, weight in arcs[k]:
                if once and reached[to]:
                    continue
                arc = (k, to, label)
                w = state[0] + weight + (follows(state[1], arc) if follows else 0.0)
                if w == inf:
                    continue
                if follows:
                    reached[to].append((w, arc, state))
                elif not reached[to]:
                    reached[to].append((w, arc, state))
                elif w < reached[to][0][0]:
                    reached[to][0] = (w, arc, state)
    if not reached[-1]:
        raise ValueError("no path of finite weight")
    at = min(reached[-1], key=lambda x: x[0])
    out = []
    while at[1] is not None:
        out.append(at[1])
        at = at[2]
    return out[::-1]


class Transducer:
    """The compiled transducers of a model; encodes and decodes."""

    #: Bytes of inputs and outputs that each table of remembered paths and arcs may hold, about.
    limit = 80 << 20

    def __init__(self, data: bytes):
        m = self.model = Model(data)
        self.piece = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t in (NORMAL, USER)}
        self.scores = m.scores
        self.trie = Trie(self.piece)
        self.unknown = m.types.index(UNKNOWN) if UNKNOWN in m.types else 0
        self.byte = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE}
        self.penalty = 10.0 - min((s for s, t in zip(m.scores, m.types, strict=True) if t == NORMAL), default=0.0)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece)
        #: paths by input; what is not asked for while one table fills is forgotten with the one before it
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        self.held = [0, 0]
        #: neighbours that some piece holds; between others no piece and no merge can reach
        self.inner = {p[k : k + 2] for p in self.piece for k in range(len(p) - 1)}
        output = [self._bytes(i) for i in range(len(m.pieces))]
        self.flat = np.frombuffer(b"".join(output), np.uint8)
        self.size = np.array([len(x) for x in output], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def normalise(self, text: str) -> str:
        """The output of the normaliser. Where it keeps all spaces it has one state, and is a replacement."""
        if not self.model.remove_extra:
            return (SPACE if self.model.add_prefix else "") + text.replace(" ", SPACE) if text else ""
        state, out = 0, []
        for part in re.split("( +)", text):
            if part:
                state, lead = NORMALISER[state][part[0] != " "]
                if part[0] != " ":
                    out += (lead, part)
        return (SPACE if self.model.add_prefix else "") + "".join(out) if out else ""

    def _fallback(self, ch: str) -> list[int]:
        """Output of the byte fallback's arc for a character."""
        if self.model.byte_fallback:
            return [self.byte[b] for b in ch.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def lattice(self, s: str) -> list[list[tuple[int, int, float]]]:
        """The composition of ``s`` with the closure of pieces and fallback: arcs (to, piece or -1, weight) by place."""
        n = len(s)
        step, emit, scores, bpe = self.trie.step, self.trie.emit, self.scores, self.model.kind == BPE
        out: list[list[tuple[int, int, float]]] = []
        for start in range(n):
            state, here, single = 0, [], False
            for at in range(start, n):
                state = step[state].get(s[at], -1)
                if state < 0:
                    break
                if emit[state] >= 0:
                    here.append((at + 1, emit[state], 0.0 if bpe else -scores[emit[state]]))
                    single |= at == start
            if not single:
                here.append((start + 1, -1, 0.0 if bpe else self.penalty))
            out.append(here)
        out.append([])
        return out

    def merged(self, s: str) -> list[str]:
        """Characters of ``s`` merged by score, the leftmost of equal ones first."""
        x: list[str | None] = list(s)
        n = len(x)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                i = self.piece.get(x[k] + x[after[k]])
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], k, x[k] + x[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            if x[k] is None or after[k] >= n or x[k] + x[after[k]] != both:
                continue
            gone = after[k]
            x[k], x[gone] = both, None
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in x if p is not None]

    def order(self, a: str, b: str) -> float:
        """Weight of segment ``b`` after ``a`` (empty at the start) in the acceptor of merge orders."""
        got = self.pairs.get((a, b))
        if got is None:
            self.held[0] += 2 * len(a + b) + 300
            if self.held[0] > self.limit:
                self.pairs.clear()
                self.held[0] = 0
            got = self.pairs[a, b] = 0.0 if self.merged(a + b) == ([a, b] if a else [b]) else float("inf")
        return got

    def path(self, s: str) -> list[tuple[int, int, int]]:
        """Arcs (from, to, piece or -1) of the shortest path of normalised text."""
        if self.model.kind == UNIGRAM:
            return shortest(self.lattice(s))
        return shortest(self.lattice(s), lambda a, b: self.order(s[a[0] : a[1]] if a else "", s[b[0] : b[1]]), once=True)

    def _remember(self, s: str, got: bytes) -> None:
        self.held[1] += len(got) + 2 * len(s) + 150
        if self.held[1] > self.limit:
            self.before, self.memo = self.memo, {}
            self.held[1] = 0
        self.memo[s] = got

    def chunk(self, s: str) -> bytes:
        """Ids (int32, little endian) of a stretch between cuts."""
        got = self._known(s)
        if got is None:
            cuts = [k for k in range(1, len(s)) if s[k - 1 : k + 1] not in self.inner]
            if cuts:
                got = b"".join(self._ids(s[a:b]) for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True))
                self._remember(s, got)
            else:
                got = self._ids(s)
        return got

    def _known(self, s: str) -> bytes | None:
        got = self.memo.get(s)
        if got is None:
            got = self.before.get(s)
            if got is not None:
                self._remember(s, got)
        return got

    def _ids(self, s: str) -> bytes:
        got = self._known(s)
        if got is None:
            ids = []
            for a, b, i in self.path(s):
                ids += [i] if i >= 0 else self._fallback(s[a:b])
            got = struct.pack(f"<{len(ids)}i", *ids)
            self._remember(s, got)
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32 bytes, little endian."""
        s = self.normalise(text)
        if not s:
            return b""
        if not self.cuts:
            return self.chunk(s)
        parts = s.split(SPACE)
        out = []
        if parts[0]:
            out.append(self.chunk(parts[0]))
        lead = 0
        for p in parts[1:]:
            lead += 1
            if p:
                c = SPACE * lead + p
                got = self.memo.get(c)
                out.append(self.chunk(c) if got is None else got)
                lead = 0
        if lead:
            out.append(self.chunk(SPACE * lead))
        return b"".join(out)

    # decoder
    def _bytes(self, i: int) -> bytes:
        p, t = self.model.pieces[i], self.model.types[i]
        if t == BYTE:
            return bytes([int(p[1:-1], 16)])
        if t == CONTROL:
            return b""
        if t == UNKNOWN:
            return " ⁇ ".encode()
        return p.replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        end = np.cumsum(size)
        raw = self.flat[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        if self.model.add_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def load(spark: SparkSession, path: str = MODEL):
    """The model's bytes, read once by the driver and sent to every executor (size checked)."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large for a model: {len(data)} bytes")
    return spark.sparkContext.broadcast(data)


_compiled: dict[bytes, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    key = hashlib.sha1(data).digest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(data)
    return _compiled[key]


def encode_documents(docs: DataFrame, model: str = MODEL, text: str = "text", decode: bool = True, ids: bool = True) -> DataFrame:
    """Add ``n_ids``, ``ids_sha256``, ``round_trip`` (and ``ids``) to every row.

    ``ids_sha256`` covers the ids as little-endian int32; ``round_trip`` says whether decoding
    gives the text back. Null texts have null in all of them; empty texts have no ids; repeated rows each
    give a row. Columns of these names in the input are replaced; all others stay.
    """
    spark = docs.sparkSession
    sent = load(spark, model)
    docs = docs.drop("n_ids", "ids_sha256", "round_trip", "ids")
    at = docs.columns.index(text)

    def run(batches):
        W.claim("sentencepiece", _compiled.clear)
        fst = compiled(sent.value)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                got = [None if x is None else fst.encode(x) for x in part.column(at).to_pylist()]
                n = [None if g is None else len(g) // 4 for g in got]
                sha = [None if g is None else hashlib.sha256(g).hexdigest() for g in got]
                back = [None if g is None else fst.decode(np.frombuffer(g, "<i4")) == t for g, t in zip(got, part.column(at).to_pylist(), strict=True)] if decode else [None] * len(got)
                cols = [*part.columns, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.bool_())]
                names = [*b.schema.names, "n_ids", "ids_sha256", "round_trip"]
                if ids:
                    flat = pa.array(np.frombuffer(b"".join(g or b"" for g in got), "<i4"))
                    offsets = np.concatenate(([0], np.cumsum([x or 0 for x in n]))).astype(np.int32)
                    mask = pa.array([g is None for g in got])
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, n_ids long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids)


def decode_ids(df: DataFrame, model: str = MODEL, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Add the text of an array of ids to every row; null gives null, no ids the empty text."""
    sent = load(df.sparkSession, model)
    at = df.columns.index(ids)

    def run(batches):
        fst = compiled(sent.value)
        for b in batches:
            new = [None if x is None else fst.decode(np.array(x, np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, column])

    return df.mapInArrow(run, df.withColumn(column, F.lit(None).cast("string")).schema)
