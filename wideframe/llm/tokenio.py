"""Operator 9 - token-id output: frequency-ranked ids in a byte-aligned
variable-length code with separate control bytes.

File format ``rank-vbyte-1``: a Parquet folder of blocks, each a run of whole
documents in ascending ``doc_id`` order::

    shard int, block int     place of the block; blocks follow each other in this order
    start bigint             ids of all documents before the block
    doc_ids array<bigint>    the block's documents
    lengths array<bigint>    ids of each document
    control binary           two bits an id, four ids a byte, low bits first: bytes of the rank - 1
    data binary              ranks, least significant byte first, without their leading zero bytes

and beside it ``<path>.ranks``, rows (rank, id): rank 0 is the most frequent id.
A reader turns control bytes into lengths and byte positions with a numpy table.

Plan: documents are encoded once, into groups in the order of the scan that are
coded by their own ranks and carry their counts of ids.  From the counts come
the corpus's ranks and the number of ids in each range of ``doc_id``.  The groups
are then recoded and dealt into the ranges, which are sorted within; each
range's first position is known, so no task sees more than its own range.  What
reaches the driver is bounded by the vocabulary and the number of ranges.

Encoding cuts text at spaces and line feeds, if the tokenizer's own normaliser and
splitter are known never to join over them (``may_cut``), and keeps the ids of pieces
in two bounded generations.  Only new pieces go through the library: a word of plain
letters straight to its model, marks after it by themselves, all else through
normaliser and splitter too.  Any other tokenizer gets whole texts.

Edge cases: a null text is empty and gives the end id alone; documents with a
null id come first; equal ids are ordered by a hash of their text, then by length and
coded bytes; an id of many rows is dealt by that hash into several ranges (copies of one
text under one id stay together).  An empty table writes a folder without blocks.
Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import fresh_path, key_ranges, list_array, map_batches, row_groups

#: Tokenizer of the production query.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Id after each document.
END_ID = 1
#: Ids in a block, before the document that fills it.
BLOCK_IDS = 1 << 18
#: Pieces whose ids a worker remembers.
CACHE_PIECES = 3 << 17
#: Pieces of more characters are not remembered.
LONG_PIECE = 256
#: Text bytes a worker encodes at once.
GROUP_BYTES = 4 << 20

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def _control(sizes: np.ndarray) -> bytes:
    """Control bytes of values of 1 to 4 bytes."""
    codes = np.zeros(-(-len(sizes) // 4) * 4, np.uint8)
    codes[: len(sizes)] = sizes - 1
    quads = codes.reshape(-1, 4)
    return (quads[:, 0] | (quads[:, 1] << 2) | (quads[:, 2] << 4) | (quads[:, 3] << 6)).tobytes()


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return _control(size), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that ``encode_ranks`` wrote."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    word = np.zeros(n, np.uint32)
    for k in range(4):
        word |= raw[at + k * (k < size)].astype(np.uint32) << np.uint32(8 * k)
    return word & _MASKS[size]


#: Splitting pattern and normalisers under which no word goes over a place of cutting; fixed by the vocabulary file.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})


def may_cut(definition: str) -> bool:
    """Whether texts of a tokenizer can be cut into pieces, and words of plain letters given to its model in bytes."""
    d = json.loads(definition)
    normal, split = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split]) if split else []
    first = steps[0] if steps else {}
    normal = normal.get("normalizers", [normal])
    known = all(n in _NORMALIZERS for n in normal) and {"type": "Lowercase"} in normal
    parted = first.get("type") == "Split" and first.get("pattern") == {"Regex": _PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    plain = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return known and parted and plain and all(t.get("special") for t in d.get("added_tokens", [])) and not d.get("truncation") and not d.get("padding")


#: Letters that have one lower-case letter each and no other composed form.
_LETTERS = "".join(c for c in map(chr, range(0x130)) if c.isalpha())
#: A word, then marks that no pattern of the splitter joins to it.
_WORD = re.compile(f"([{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")
#: Bytes that a byte-level vocabulary writes as the same character; the others are written from U+0100 on.
_PLAIN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
_OTHERS = [b for b in range(0x100) if b not in _PLAIN]
_BYTE_CHARS = [chr(b if b in _PLAIN else 0x100 + _OTHERS.index(b)) for b in range(0x100)]
#: Letters as the model sees them: lower case, a character a byte.
_MODEL_CHARS = {ord(c): "".join(_BYTE_CHARS[b] for b in c.lower().encode()) for c in _LETTERS}


class _Pieces(dict):
    """Ids of pieces, made when first asked for or taken from the generation before."""

    def __init__(self, library, old: dict[str, bytes]):
        super().__init__({"": b""})
        self.library, self.model, self.old = library, library.model.tokenize, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.made(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids

    def made(self, piece: str) -> bytes:
        parts = _WORD.fullmatch(piece)
        if parts is None:
            return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        if parts[2]:
            return self[parts[1]] + self[parts[2]]
        return array("I", [token.id for token in self.model(piece.translate(_MODEL_CHARS))]).tobytes()


class PieceEncoder:
    """Ids of texts by the tokenizers library, with a bounded cache of pieces."""

    def __init__(self, definition: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        self.cuts = may_cut(definition)
        self.end = np.array([end_id], "<u4").tobytes()
        self.pieces = _Pieces(self.library, {})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        if not self.cuts:
            return [array("I", self.library.encode(t or "", add_special_tokens=False).ids).tobytes() + self.end for t in texts]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.old = {}
            self.pieces = _Pieces(self.library, self.pieces)
        get, out = self.pieces.__getitem__, []
        for t in texts:
            lower = t.lower() if t and t.isascii() else t or ""
            out.append(b"".join(map(get, lower.replace("\n", " ").split(" "))) + self.end)
        return out


_encoders: dict[int, PieceEncoder] = {}


def _encoder(definition: str, end_id: int) -> PieceEncoder:
    """One encoder for each tokenizer and worker process."""
    key = hash((definition, end_id))
    if key not in _encoders:
        _encoders[key] = PieceEncoder(definition, end_id)
    return _encoders[key]


def _encode_blocks(shared, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups of documents in the order of the scan, each coded by its own ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, end_id)
        for whole in batches:
            for batch in row_groups(whole, 0, GROUP_BYTES):
                made = encoder.encode(batch.column(0).to_pylist())
                ids = np.frombuffer(b"".join(made), "<u4")
                counts = np.bincount(ids)
                used = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
                to_rank = np.zeros(len(counts), np.uint32)
                to_rank[used] = np.arange(len(used))
                control, data = encode_ranks(to_rank[ids])
                one = np.array([batch.num_rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        list_array(batch.column(2), one),
                        list_array(batch.column(1), one),
                        list_array(batch.column(3), one),
                        list_array(pa.array([len(m) // 4 for m in made], pa.int64()), one),
                        list_array(pa.array(used.astype(np.int32), pa.int32()), np.array([len(used)])),
                        list_array(pa.array(counts[used], pa.int64()), np.array([len(used)])),
                        pa.array([control], pa.binary()),
                        pa.array([data], pa.binary()),
                    ],
                    names=["doc_ids", "shards", "hashes", "lengths", "ids", "counts", "control", "data"],
                )

    return run


_RAW = "doc_ids array<bigint>, shards array<int>, hashes array<bigint>, lengths array<bigint>, ids array<int>, counts array<bigint>, control binary, data binary"


def _recode(to_rank) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, shard, hash, n, control, data) of each document of such groups, by the corpus's ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = to_rank.value
        for batch in batches:
            for docs, shards, hashes, lengths, ids, control, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                n = np.array(lengths, np.int64)
                ranks = table[np.array(ids)][decode_ranks(control, data, int(n.sum()))]
                coded = [encode_ranks(r) for r in np.split(ranks, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(shards, pa.int32()), pa.array(hashes, pa.int64()), pa.array(n, pa.int64()), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                    names=["doc_id", "shard", "hash", "n", "control", "data"],
                )

    return run


def _packer(first: dict[int, int], limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted documents (doc_id, shard, n, control, data) packed into blocks."""

    def pack(shard: int, block: int, start: int, docs: list) -> pa.RecordBatch:
        # data bytes join as they are; control bytes start anew at each document's first id
        sizes = np.concatenate([_LENGTHS[np.frombuffer(c, np.uint8)].ravel()[:n] for _, n, c, _ in docs])
        control, data = _control(sizes), b"".join(d for _, _, _, d in docs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([[x[0] for x in docs]], pa.list_(pa.int64())),
                pa.array([[x[1] for x in docs]], pa.list_(pa.int64())),
                pa.array([control], pa.binary()),
                pa.array([data], pa.binary()),
            ],
            names=["shard", "block", "start", "doc_ids", "lengths", "control", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, held, docs = None, 0, 0, 0, []
        for batch in batches:
            for doc, own, n, control, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if docs and (own != shard or held >= limit):
                    yield pack(shard, block, start, docs)
                    block, start, held, docs = block + 1, start + held, 0, []
                if own != shard:
                    shard, block, start = own, 0, first[own]
                docs.append((doc, n, control, data))
                held += n
        if docs:
            yield pack(shard, block, start, docs)

    return run


_BLOCKS = "shard int, block int, start bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> str:
    """Encodes every document and writes the ids in ascending ``doc_id`` order to ``path``."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"))
    own = own.select("text", key_ranges(own, "doc_id", 4 * parts, "hash").alias("shard"), "doc_id", "hash")
    encoded = fresh_path(spark, "encoded")
    map_batches(own, _encode_blocks(shared, end_id), _RAW).write.parquet(encoded)
    raw = spark.read.schema(_RAW).parquet(encoded)
    counts = raw.select(F.explode(F.arrays_zip("ids", "counts")).alias("x")).groupBy("x.ids").agg(F.sum("x.counts").alias("n")).collect()
    ids = np.array([r["ids"] for r in sorted(counts, key=lambda r: (-r["n"], r["ids"]))], np.int64)
    to_rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    to_rank[ids] = np.arange(len(ids))
    totals = raw.select(F.explode(F.arrays_zip("shards", "lengths")).alias("x")).groupBy("x.shards").agg(F.sum("x.lengths").alias("n")).collect()
    first, total = {}, 0
    for r in sorted(totals, key=lambda r: r["shards"]):
        first[r["shards"]] = total
        total += r["n"]
    coded = map_batches(raw.select("doc_ids", "shards", "hashes", "lengths", "ids", "control", "data"), _recode(spark.sparkContext.broadcast(to_rank)), "doc_id bigint, shard int, hash bigint, n bigint, control binary, data binary")
    ordered = coded.repartition(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "hash", "n", "control", "data")
    map_batches(ordered.drop("hash"), _packer(first, block_ids), _BLOCKS).write.parquet(path)
    spark.createDataFrame([(i, int(k)) for i, k in enumerate(ids)], "rank int, id int").coalesce(1).write.parquet(f"{path}.ranks")
    return path


def _reader(to_id, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = to_id.value
        for batch in batches:
            for start, docs, lengths, control, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                n = np.array(lengths, np.int64)
                ids = table[decode_ranks(control, data, int(n.sum()))]
                ends = np.cumsum(n)
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64())]
                if digest:
                    columns.append(pa.array([zlib.crc32(x) for x in np.split(ids, ends[:-1])], pa.int64()))
                else:
                    columns.append(list_array(pa.array(ids.astype(np.int32), pa.int32()), n))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start, n_tokens and ids, or with ``digest`` their crc32."""
    ranks = spark.read.parquet(f"{path}.ranks").orderBy("rank").collect()
    to_id = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], "<u4"))
    blocks = spark.read.schema(_BLOCKS).parquet(path).select("start", "doc_ids", "lengths", "control", "data")
    last = "ids_crc32 bigint" if digest else "ids array<int>"
    return map_batches(blocks, _reader(to_id, digest), f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and crc32 in the written token files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_token_files(docs, fresh_path(spark, "token-ids"))
    return read_token_files(spark, path, digest=True)
