"""Operator 2 - byte-level BPE by a lazily determinised finite-state transducer.

A text is split by the tokenizer's pattern; each match is read byte by byte.
At any byte a few readings stay open: the places where a token that goes on could
have started, each a node of the vocabulary's prefix tree.  The set of open
nodes is one state of the transducer; states and transitions are made when first
needed and remembered, and there are no more states than nodes.  A transition
tells which tokens can end at its byte, longest first; the one that may follow
the token before it does.  Two tokens may stand side by side if merging their joined
bytes by rank gives just them, which makes the reading of each prefix unique and
equal to merging by rank.

Tokens are emitted after a bounded lookahead: whatever follows, the encoding
passes one of the boundaries where an open reading starts, so the tokens before
the place where the readings of all these boundaries meet are final.  They are
emitted at once when no node is open, and else each time that as many bytes are
pending as the longest vocabulary entry has.

Decoding streams: a table of states and bytes reads UTF-8 incrementally, holding the
state and the bits of an unfinished character; its steps on whole tokens are remembered.

Scale: a map without shuffle; the vocabulary (about 1 MB) is broadcast; states
and pieces remembered by a worker are bounded and only save time.

Edge cases: a null text is empty (no ids; the digests are those of no bytes).
Special tokens' names are ordinary text.  Repeated rows each get their row, rows
with a null id too.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import list_array, map_batches, row_groups

#: Rank file and splitting pattern of the production query.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pieces, transitions, and pairs of tokens that a worker remembers.
CACHE_PIECES = 1 << 17
CACHE_STEPS = 1 << 18
CACHE_PAIRS = 1 << 19
#: Text bytes a worker encodes at once.
GROUP_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Ids of one piece of text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.length.values(), default=1)
        # the prefix tree, by node and byte (node << 8 | byte): the next node if tokens go on from it, the token that ends there
        self.moves: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # by token: whether it may follow each token that was asked for
        self.after: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        #: bytes that were pending at once, at most, in pieces longer than the longest entry
        self.most_pending = 0
        for piece, rank in ranks.items():
            node = 0
            for byte in piece[:-1]:
                node = self.moves.setdefault(node | byte, len(self.moves) + 1 << 8)
            self.ends[node | piece[-1]] = rank
        self._forget()

    def _forget(self) -> None:
        # a state is named by its open nodes, longest first, and holds its transitions by byte
        self.states: dict[tuple[int, ...], dict] = {(): {}}
        self.names: dict[int, tuple[int, ...]] = {id(self.states[()]): ()}
        self.depths: dict[int, tuple[int, ...]] = {id(self.states[()]): ()}
        self.known_steps = 0

    def merge(self, piece: bytes, parts_left: int = 1) -> list[bytes]:
        """Merging by rank, the definition of the encoding, down to so many parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for one byte, (-1, -1) if merging never makes it."""
        if token not in self.halves:
            piece = self.token[token]
            if len(piece) == 1:
                self.halves[token] = None
            else:
                parts = self.merge(piece, 2)
                made = len(parts) == 2 and self.ranks.get(piece) == token
                self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if made else (-1, -1)
        return self.halves[token]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether merging the joined bytes by rank leaves the two tokens side by side; remembers it."""
        if self.pairs > CACHE_PAIRS:
            for known in self.after.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        ok = self.after.setdefault(token, {})[before] = before < 0 or self._stays_apart(before, token)
        return ok

    def _stays_apart(self, left: int, right: int) -> bool:
        # Undo the merges on both sides of the boundary, latest first. A merge over the
        # boundary would have happened if its rank is below that of the merge undone last.
        undone = 1 << 60
        a, b = left, right
        while True:
            over = self.ranks.get(self.token[a] + self.token[b])
            if over is not None and over < undone:
                return False
            half_a, half_b = self.split(a), self.split(b)
            if half_a is None and half_b is None:
                return True
            # of two merges with one rank the left one happens first, so the right one is undone first
            if half_b is None or (half_a is not None and a > b):
                undone, a = a, half_a[1]
            else:
                undone, b = b + 1, half_b[0]

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple[tuple[int, int, dict], ...]]:
        """Next state, and (token, length, what it may follow) of the tokens that can end here; makes the state if it is new."""
        at = [node | byte for node in (*self.names[id(state)], 0)]
        name = tuple(self.moves[x] for x in at if x in self.moves)
        after = self.states.get(name)
        if after is None:
            after = self.states[name] = {}
            self.names[id(after)] = name
            self.depths[id(after)] = tuple(d + 1 for x, d in zip(at, (*self.depths[id(state)], 0), strict=True) if x in self.moves)
        ended = [self.ends[x] for x in at if x in self.ends]
        step = state[byte] = after, tuple((t, self.length[t], self.after.setdefault(t, {})) for t in ended if self.split(t) != (-1, -1))
        self.known_steps += 1
        return step

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.known_steps > CACHE_STEPS:
            self._forget()
        start, ids = self.states[()], []
        state, last, full = start, [-1], self.longest  # last: the token that ends at each boundary since the last emission
        for byte in piece:
            step = state.get(byte) or self._step(state, byte)
            state, ended = step
            for token, length, after in ended:
                ok = after.get(last[-length])
                if ok or (ok is None and self.may_follow(last[-length], token)):
                    break
            else:
                raise ValueError("the vocabulary does not cover every byte")
            last.append(token)
            if state is start:
                self._emit(last, ids, len(last) - 1)
            elif len(last) > full:
                self._emit(last, ids, self._met(last, self.depths[id(state)]))
                full = len(last) + self.longest
                self.most_pending = max(self.most_pending, full)
        self._emit(last, ids, len(last) - 1)
        return ids

    def _met(self, pending: list[int], depths: tuple[int, ...]) -> int:
        """The last boundary that the readings of all open boundaries pass."""
        top = len(pending) - 1
        open_at = {top, *(top - d for d in depths)}
        while len(open_at) > 1:
            last = max(open_at)
            open_at.remove(last)
            open_at.add(last - self.length[pending[last]])
        return open_at.pop()

    def _emit(self, pending: list[int], ids: list[int], upto: int) -> None:
        """Moves the one reading that ends at a boundary from the tokens that end at each boundary to ids."""
        at, out = upto, []
        while at > 0:
            out.append(pending[at])
            at -= self.length[out[-1]]
        ids += reversed(out)
        del pending[:upto]


class Pieces(dict):
    """Ids of pieces, in two generations of bounded size."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) < 256:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.transducer)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


#: Moves of the UTF-8 machine: for each state, ranges of bytes and the state after them; any other byte is refused.
#: ``start`` is between characters, ``one`` to ``three`` await so many bytes, the others have a narrower next byte.
_UTF8 = {
    "start": [(0x00, 0x7F, "start"), (0xC2, 0xDF, "one"), (0xE0, 0xE0, "e0"), (0xE1, 0xEC, "two"), (0xED, 0xED, "ed"), (0xEE, 0xEF, "two"), (0xF0, 0xF0, "f0"), (0xF1, 0xF3, "three"), (0xF4, 0xF4, "f4")],
    "one": [(0x80, 0xBF, "start")],
    "two": [(0x80, 0xBF, "one")],
    "three": [(0x80, 0xBF, "two")],
    "e0": [(0xA0, 0xBF, "one")],
    "ed": [(0x80, 0x9F, "one")],
    "f0": [(0x90, 0xBF, "two")],
    "f4": [(0x80, 0x8F, "two")],
}
_START, _REFUSED = 0, 255
_NEXT = bytearray([_REFUSED]) * (len(_UTF8) << 8)
for _i, _ranges in enumerate(_UTF8.values()):
    for _low, _high, _to in _ranges:
        _NEXT[_i << 8 | _low : (_i << 8 | _high) + 1] = bytes([list(_UTF8).index(_to)]) * (_high - _low + 1)


class Utf8Machine:
    """Incremental UTF-8 decoding of bytes that come in any cuts, by the table of moves.

    Bytes that can't continue or start a character become U+FFFD, one for each
    unfinished character, as Python's ``errors="replace"`` does.
    """

    def __init__(self):
        #: State, and the bits read of an unfinished character.
        self.held = (_START, 0)

    def feed(self, data: bytes, final: bool = False) -> str:
        (state, code), out = self.held, []
        for byte in data:
            to = _NEXT[state << 8 | byte]
            if to == _REFUSED and state != _START:  # the unfinished character ends, the byte is read again
                out.append("\ufffd")
                state = _START
                to = _NEXT[byte]
            if to == _REFUSED:
                out.append("\ufffd")
                continue
            if state != _START:
                code = code << 6 | byte & 0x3F
            else:
                code = byte if byte < 0x80 else byte & (0x1F if byte < 0xE0 else 0x0F if byte < 0xF0 else 0x07)
            if to == _START:
                out.append(chr(code))
            state = to
        if final and state != _START:
            out.append("\ufffd")
            state = _START
        self.held = (state, code if state != _START else 0)
        return "".join(out)


class StreamDecoder:
    """Text of ids that come in any cuts."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.machine = Utf8Machine()
        self.whole: dict[int, str] = {}
        self.moves: dict[tuple[tuple[int, int], int], tuple[tuple[int, int], str]] = {}
        for i, b in token.items():
            try:
                self.whole[i] = b.decode()
            except UnicodeDecodeError:
                pass

    def feed(self, ids: list[int]) -> str:
        machine = self.machine
        if machine.held[0] == _START:
            try:
                return "".join(map(self.whole.__getitem__, ids))
            except KeyError:
                pass
        out = []
        whole, moves = self.whole, self.moves
        for i in ids:
            if machine.held[0] == _START and i in whole:
                out.append(whole[i])
                continue
            key = (machine.held, i)
            move = moves.get(key)
            if move is None:
                text = machine.feed(self.token[i])
                if len(moves) > CACHE_PIECES:
                    moves.clear()
                moves[key] = (machine.held, text)
            else:
                machine.held, text = move
            out.append(text)
        return "".join(out)

    def finish(self) -> str:
        return self.machine.feed(b"", final=True)


_coders: dict[int, tuple[Encoder, StreamDecoder]] = {}


def _coder(ranks: dict[bytes, int], pattern: str) -> tuple[Encoder, StreamDecoder]:
    """One encoder and decoder for each vocabulary and worker process."""
    key = hash((pattern, len(ranks), frozenset(ranks.items())))
    if key not in _coders:
        encoder = Encoder(ranks, pattern)
        _coders[key] = encoder, StreamDecoder(encoder.transducer.token)
    return _coders[key]


def _digests(shared, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coder(shared.value, pattern)
        for whole in batches:
            for batch in row_groups(whole, 0, GROUP_BYTES):
                rows = []
                for text in batch.column(0).to_pylist():
                    ids = encoder.encode(text or "")
                    back = decoder.feed(np.frombuffer(ids, "<u4").tolist()) + decoder.finish()
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(shared, pattern: str, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _coder(shared.value, pattern)
        for whole in batches:
            for batch in row_groups(whole, text_at, GROUP_BYTES):
                made = [np.frombuffer(encoder.encode(t or ""), "<u4") for t in batch.column(text_at).to_pylist()]
                counts = np.array([len(m) for m in made], np.int64)
                ids = list_array(pa.array(np.concatenate(made).astype(np.int32), pa.int32()), counts)
                keep = [i for i in range(batch.num_columns) if i != text_at]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(counts, pa.int64()), ids], names=[*(f"c{i}" for i in range(len(keep))), "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, carry: list[str], text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Columns ``carry`` of every document with ``n_tokens`` and ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("t"))
    kept = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    out = map_batches(own, _ids(shared, pattern, len(carry)), f"{kept}n_tokens bigint, ids array<int>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens", "ids")


def _texts(shared, ids_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder({i: b for b, i in shared.value.items()})
        for batch in batches:
            texts = [None if v is None else decoder.feed(v) + decoder.finish() for v in batch.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(ids_at)), pa.array(texts, pa.string())], names=[*(f"c{i}" for i in range(ids_at)), "decoded"])

    return run


def decode(tokens: DataFrame, carry: list[str], ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """Columns ``carry`` with the text of the ids in ``decoded`` (null ids: null)."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    own = tokens.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(ids).alias("t"))
    kept = "".join(f"c{i} {tokens.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    out = map_batches(own, _texts(shared, len(carry)), f"{kept}decoded string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "decoded")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "doc_id")
    shared = spark.sparkContext.broadcast(read_ranks(RANKS))
    return map_batches(docs, _digests(shared, PATTERN), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
