"""Operator 1 - I-Match document fingerprints over randomised lexicon subsets.

The lexicon is the terms whose inverse document frequency lies in a chosen band:
ln(N / df) is at least ``LEAST_IDF``, which leaves out words of every text, and at most
``MOST_IDF`` times ln N, which leaves out terms of fewer than N^(1 - ``MOST_IDF``) documents
(typing errors, numbers, names of one text) alike at every size.
A document's distinct lexicon terms, sorted, are hashed once whole and once for
each of ``SCALES`` x ``SLOTS`` randomised subsets of the lexicon.  A subset of scale s
holds each term with probability 4^-s; it is a part of the subset of scale s - 1 in
its slot.  Texts that share most terms agree on the sparse subsets, equal texts agree on all.

Likeness of two fingerprints: 1 if equal; else the share of equal hashes among
the subsets, of the sparsest scale with at least ``LEAST_SLOTS`` subsets that are
not empty for both (with none, of the scale with the most such subsets).  The scales reach
texts of some 100,000 distinct terms.

Scale: document frequencies are counted over all documents in ``BUCKETS`` hashed
terms, summed within each task before the shuffle.  The lexicon is broadcast as
one bit a bucket (512 KB), a fixed size; terms that share a bucket share their
frequency.  The edited texts need the next document: documents are dealt by
ranges of ``doc_id``, each range with one copy of the next range's first document,
so text is shuffled once and sorted within its range.

Edge cases: a null text is empty; an empty text has the fingerprint of no terms.
The whole hash of a text without any lexicon term is of all its terms, its subsets are
empty: it is like equal texts only.  Of equal
ids the order is by a hash of the text, descending, then by text; an id of many rows is dealt by
that hash into several ranges (copies of one text under one id stay together).  A table's only document is its own next one.  A document with a null id has no next
document: nothing replaces what is cut, and near_next is 0.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import key_ranges, map_batches, mix64, row_groups, text_buffer, word_bounds, words

#: Hashed terms of the lexicon.
BUCKETS = 1 << 22
#: Band of the inverse document frequency: least ln(N / df), and most as a share of ln N.
LEAST_IDF = 1.5
MOST_IDF = 0.9
#: Scales of subsets, each a quarter of the one before, and subsets of each.
SCALES = 8
SLOTS = 48
LEAST_SLOTS = 24
GROUP_BYTES = 4 << 20

_SLOT_SEEDS = mix64(np.arange(1, SCALES * SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each text in turn, and n+1 bounds."""
    data, offsets = text_buffer(column)
    hashes, starts, _ = words(data, offsets)
    bounds = word_bounds(starts, offsets)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(bounds)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each hashed term in a task."""
    table = np.zeros(BUCKETS, np.int64)
    for whole in batches:
        for batch in row_groups(whole, 0, GROUP_BYTES):
            h, bounds = terms(batch.column(0))
            doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
            table += np.bincount(np.unique(doc * np.uint64(BUCKETS) + h % np.uint64(BUCKETS)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(table)
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(table[part], pa.int64())], names=["bucket", "n"])


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Whether each hashed term is in the band, packed to bits."""
    own = docs.select(F.col(text).alias("t"))
    total = own.count()
    counts = map_batches(own, _frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    chosen = counts.where((F.col("n") >= float(total ** (1 - MOST_IDF))) & (F.col("n") <= float(total / np.exp(LEAST_IDF))))
    # packed by the executors into BUCKETS / 64 words at most
    word = chosen.groupBy(F.floor(F.col("bucket") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(bucket % 64))")).alias("bits"))
    out = np.zeros(BUCKETS // 64, np.int64)
    for r in word.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out


def fingerprints(column: pa.Array, bits: np.ndarray) -> np.ndarray:
    """One row for each text: the hash of all its lexicon terms, then 8-bit hashes of the subsets (0: empty)."""
    h, bounds = terms(column)
    n = len(bounds) - 1
    out = np.zeros((n, 1 + SCALES * SLOTS), np.uint64)
    if not len(h):
        return out
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    inside = ((bits[bucket >> 6] >> (bucket & 63)) & 1).astype(bool)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    none = np.bincount(doc[inside], minlength=n) == 0

    def hashed(value: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Order-sensitive hash of each document's sorted terms."""
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        place = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
        made = np.zeros(n, np.uint64)
        made[own[at]] = mix64(np.add.reduceat(mix64(value + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at))
        return made

    whole = inside | none[doc]
    out[:, 0] = hashed(h[whole], doc[whole])
    h, doc = h[inside], doc[inside]
    for k in range(SLOTS):
        pick = np.arange(len(h))
        for s in range(SCALES):
            slot = s * SLOTS + k
            pick = pick[h[pick] * _SLOT_SEEDS[slot] < np.uint64(1 << 62)]
            if not len(pick):
                break
            own = np.unique(doc[pick])
            out[own, 1 + slot] = hashed(h[pick], doc[pick])[own] % np.uint64(0xFF) + np.uint64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of the fingerprints in two tables, row by row."""
    n = len(a)
    x, y = a[:, 1:].reshape(n, SCALES, SLOTS), b[:, 1:].reshape(n, SCALES, SLOTS)
    used = ((x > 0) | (y > 0)).sum(axis=2)
    same = ((x == y) & (x > 0)).sum(axis=2)
    enough = used >= LEAST_SLOTS
    scale = np.where(enough.any(axis=1), SCALES - 1 - enough[:, ::-1].argmax(axis=1), used.argmax(axis=1))
    row = np.arange(n)
    share = same[row, scale] / np.maximum(used[row, scale], 1)
    return np.where((a == b).all(axis=1), 1.0, share)


def as_text(table: np.ndarray) -> list[str]:
    """Fingerprints as strings: 16 hexadecimal digits of the whole, 2 of each subset."""
    head = table[:, 0].astype(">u8")
    rest = table[:, 1:].astype(np.uint8)
    return [h.tobytes().hex() + r.tobytes().hex() for h, r in zip(head, rest, strict=True)]


def _pairs(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of ranges, in order, with the next one at hand."""

    def finish(rows: list[tuple[int | None, str, str | None]], bits: np.ndarray) -> pa.RecordBatch:
        edited = []
        for _, own, following in rows:
            cut = len(own) // 3
            edited.append(own[: len(own) - cut] + (following or "")[:cut])
        # the next text of a row is the text of the row after it, but for the last row of a range
        far = [i for i, r in enumerate(rows) if r[2] is not None and (i + 1 == len(rows) or rows[i + 1][1] != r[2])]
        made = fingerprints(pa.array([r[1] for r in rows] + [rows[i][2] for i in far], pa.string()), bits)
        mine = made[: len(rows)]
        at = np.minimum(np.arange(len(rows)) + 1, len(rows) - 1)
        at[far] = len(rows) + np.arange(len(far))
        after = made[at]
        other = fingerprints(pa.array(edited, pa.string()), bits)
        next_like = np.where([r[2] is None for r in rows], 0.0, likeness(mine, after))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(as_text(mine), pa.string()),
                pa.array(as_text(other), pa.string()),
                pa.array(likeness(mine, other), pa.float64()),
                pa.array(next_like, pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held, rows, size = None, [], 0  # held: a document that waits for its next one
        for batch in batches:
            for text, number, doc, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None:
                    same = held[1] == number and number is not None
                    rows.append((held[0], held[2], text if same else None))
                    size += len(held[2])
                    held = None
                if not copy:
                    held = (doc, number, text)
                if size >= GROUP_BYTES:
                    yield finish(rows, bits)
                    rows, size = [], 0
        if held is not None:
            rows.append((held[0], held[2], None))
        if rows:
            yield finish(rows, bits)

    return run


def near_edits(docs: DataFrame, bits: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("doc_id")).withColumn("hash", F.xxhash64("text"))
    placed = own.where("doc_id is not null").withColumn("number", key_ranges(own, "doc_id", 4 * parts, "hash"))
    # the first document (by doc_id and hash descending, then text) of each range goes to the range above it too;
    # one row for each range, so what is collected is bounded by the number of ranges
    first = placed.groupBy("number").agg(F.max(F.struct("doc_id", "hash")).alias("x")).orderBy(F.desc("number")).collect()
    copies = [(*r["x"], r["number"], first[i - 1]["number"]) for i, r in enumerate(first)]
    heads = placed.join(F.broadcast(spark.createDataFrame(copies, "doc_id long, hash long, number int, above int")), ["doc_id", "hash", "number"])
    heads = heads.groupBy("doc_id", "hash", "above").agg(F.min("text").alias("text")).select("text", F.col("above").alias("number"), "doc_id", "hash", F.lit(True).alias("copy"))
    dealt = placed.select("text", "number", "doc_id", "hash", F.lit(False).alias("copy")).union(heads).repartition(parts, "number")
    dealt = dealt.sortWithinPartitions("number", "copy", F.desc("doc_id"), F.desc("hash"), "text").drop("hash")
    lone = own.where("doc_id is null").select("text", F.lit(None).cast("int").alias("number"), "doc_id", F.lit(False).alias("copy"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    shared = spark.sparkContext.broadcast(bits)
    return map_batches(dealt, _pairs(shared), schema).union(map_batches(lone, _pairs(shared), schema))


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and its edited text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_edits(docs, lexicon(docs))
