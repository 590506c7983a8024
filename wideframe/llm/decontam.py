"""Operator 7 - benchmark decontamination with one FM-index per training shard.

The phrases to search for are windows of ``width`` consecutive words of each
benchmark item (an item of fewer words is one window).  Each task cuts its
documents into shards of bounded size.  A shard is turned into symbols of the
benchmark vocabulary, its suffix array is built by prefix doubling, and the
Burrows-Wheeler transform is kept as a wavelet matrix.  All windows are then
searched backwards at once through wavelet ranks, their occurrences are located
by walking to the nearest sampled suffix position, and the located windows are
merged into removal spans.

Words outside the benchmark vocabulary can be in no window, nor can a run of
vocabulary words shorter than the shortest window; both are left out of the
index, which changes no result.  Nothing is shuffled.

Scale: the benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, one at a
time; a block is broadcast as arrays (a few bytes for each byte of its text) and
dropped before the next one is read.  A benchmark of several blocks is searched in as many passes over
the documents, each pass written to the shared folder; one item of more bytes is a block of its own.

Edge cases: a null or empty text has no words and is never contaminated.  Null
and wordless benchmark items have no window.  Equal item ids count once; an item
without an id still marks words and counts once as the item ``""``.  Repeated documents each get
their own row.  Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import SQL_WORDS, fresh_path, map_batches, mix64, row_groups, text_buffer, word_bounds, words

#: Words in a window.
WIDTH = 10
#: Text bytes in one shard, and so in one FM-index.
SHARD_BYTES = 4 << 20
#: Benchmark text bytes that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Phrases that are searched at once.
PHRASES = 1 << 18
#: One suffix position of so many is kept for locating.
SAMPLE = 8


class Phrases:
    """The windows of a block of benchmark items over their own vocabulary, as arrays.

    ``text`` holds the items' words as symbols, one after the other; a window is
    a place in it (``first``) and a length.  Equal windows are one; the items of
    window w are ``items[k]`` for k in ``owner[owner_at[w] : owner_at[w + 1]]``.
    """

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        hashes, counts = [], []
        for at in range(0, len(items), 1 << 10):
            data, offsets = text_buffer(pa.array([t or "" for _, t in items[at : at + (1 << 10)]], pa.string()))
            h, starts, _ = words(data, offsets)
            hashes.append(h)
            counts.append(np.diff(word_bounds(starts, offsets)))
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        del hashes
        self.vocabulary = np.unique(hashed)
        self.text = (np.searchsorted(self.vocabulary, hashed) + 1).astype(np.int32)
        del hashed
        self.items, number = np.unique(np.array([i for i, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        length = np.minimum(size, width)
        count = np.where(size > 0, size - length + 1, 0)
        doc = np.repeat(np.arange(len(size), dtype=np.int32), count)
        first = np.arange(len(doc), dtype=np.int32) + np.repeat((np.cumsum(size) - size - (np.cumsum(count) - count)).astype(np.int32), count)
        length = length[doc].astype(np.int32)
        mark = np.zeros(len(first), np.uint64)
        for at in range(0, len(first), PHRASES):  # in runs, as each needs a few arrays of its own
            own, own_first, own_length = mark[at : at + PHRASES], first[at : at + PHRASES], length[at : at + PHRASES]
            for k in range(width):
                here = np.flatnonzero(own_length > k)
                own[here] = mix64(own[here] * np.uint64(3) + self.text[own_first[here] + k].astype(np.uint64))
        order = np.argsort(mark, kind="stable").astype(np.int32)
        mark = mark[order]
        fresh = np.ones(len(order), bool)
        np.not_equal(mark[1:], mark[:-1], out=fresh[1:])
        del mark
        self.first, self.lengths = first[order[fresh]], length[order[fresh]]
        del first, length
        pairs = np.cumsum(fresh, dtype=np.int64) - 1
        pairs *= max(len(self.items), 1)
        pairs += number.astype(np.int32)[doc[order]]
        del order, doc, fresh
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs  # each item once for each window
        self.owner_at = np.searchsorted(pairs, np.arange(len(self.first) + 1) * max(len(self.items), 1)).astype(np.int64)
        self.owner = (pairs % max(len(self.items), 1)).astype(np.int32)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 for a word of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def owners(self, window: int) -> list[str]:
        """Items of a window."""
        return self.items[self.owner[self.owner_at[window] : self.owner_at[window + 1]]].tolist()


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only tied suffixes are sorted again."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    head = np.ones(n, bool)
    head[1:] = sorted_ranks[1:] != sorted_ranks[:-1]
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    step = 1
    while step < n:
        single = head.copy()
        single[:-1] &= head[1:]
        open_rows = np.flatnonzero(~single)
        if not len(open_rows):
            break
        suffix = order[open_rows]
        after = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        group = rank[suffix]
        by = np.lexsort((after, group))
        suffix, after, group = suffix[by], after[by], group[by]
        order[open_rows] = suffix
        fresh = np.ones(len(by), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[open_rows] = fresh
        rank[suffix] = open_rows[np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
        step *= 2
    return order


class WaveletMatrix:
    """rank(symbol, i): occurrences of a symbol among the first i entries."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.int64)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros_like(i)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            one = ((symbol >> level) & 1) == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - low


class FMIndex:
    """Full-text index of a sequence of runs of symbols, each run ended by a 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        stops = np.flatnonzero(text == 0)
        ranks = text + len(stops)
        ranks[stops] = np.arange(len(stops))
        order = suffix_array(ranks)
        self.bwt = text[order - 1]
        top = int(text.max()) if len(text) else 0
        self.tree = WaveletMatrix(self.bwt, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.sampled = (order % sample == 0) | (self.bwt == 0)
        self.slot = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row)

    def search(self, text: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of the suffixes that begin with each phrase ``text[first : first + length]``."""
        known = len(self.first) - 2
        low = np.zeros(len(first), np.int64)
        high = np.full(len(first), len(self.bwt), np.int64)
        for k in range(int(lengths.max(initial=0)) - 1, -1, -1):
            at = np.flatnonzero((lengths > k) & (low < high))
            symbol = text[first[at] + k].astype(np.int64)
            high[at[symbol > known]] = 0
            at, symbol = at[symbol <= known], symbol[symbol <= known]
            if len(at):
                low[at], high[at] = self.step(symbol, low[at]), self.step(symbol, high[at])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to a sampled one."""
        found = np.empty(len(row), np.int64)
        at, row = np.arange(len(row)), row.copy()
        walked = 0
        while len(at):
            done = self.sampled[row]
            found[at[done]] = self.positions[self.slot[row[done]]] + walked
            at, row = at[~done], row[~done]
            row = self.step(self.bwt[row], row)
            walked += 1
        return found


def find(phrases: Phrases, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word position and window number of every occurrence in a shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not phrases.shortest or not len(hashes):
        return none
    symbol = phrases.symbols(hashes)
    inside = symbol > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(inside)]
    begins[firsts] = inside[firsts]
    run = np.cumsum(begins)
    kept = np.flatnonzero(inside)
    sizes = np.bincount(run[kept], minlength=int(run[-1]) + 1 if len(run) else 1)
    kept = kept[sizes[run[kept]] >= phrases.shortest]
    if not len(kept):
        return none
    number = run[kept]
    fresh = np.ones(len(kept), bool)
    fresh[1:] = number[1:] != number[:-1]
    place = np.arange(len(kept)) + np.cumsum(fresh) - 1  # one stop before each run but the first
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = symbol[kept]
    word = np.zeros(len(text), np.int64)
    word[place] = kept
    index = FMIndex(text)
    places, windows = [], []
    for part in range(0, len(phrases.first), PHRASES):
        own = slice(part, part + PHRASES)
        low, high = index.search(phrases.text, phrases.first[own], phrases.lengths[own])
        count = np.maximum(high - low, 0)
        hit = np.flatnonzero(count > 0)
        windows.append(np.repeat(hit, count[hit]) + part)
        row = np.repeat(low[hit], count[hit]) + np.arange(len(windows[-1])) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        places.append(index.locate(row))
    return word[np.concatenate(places)], np.concatenate(windows)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_BYTES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ITEMS = pa.list_(pa.string())


def _searcher(shared, last: bool, cut: bool, carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (text, carried columns..., n_words, spans, items) with one more block searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for whole in batches:
            for batch in row_groups(whole, 0, SHARD_BYTES):
                data, offsets = text_buffer(batch.column(0))
                hashes, starts, ends = words(data, offsets)
                bounds = word_bounds(starts, offsets)
                at, window = find(phrases, hashes, bounds)
                doc = np.searchsorted(bounds, at, "right") - 1
                spans = [[(x["first"], x["last"]) for x in v] for v in batch.column(carried + 2).to_pylist()]
                items = [set(v) for v in batch.column(carried + 3).to_pylist()]
                for d, first, w in zip(doc.tolist(), (at - bounds[doc]).tolist(), window.tolist(), strict=True):
                    spans[d].append((first, first + int(phrases.lengths[w])))
                    items[d].update(phrases.owners(w))
                spans = [_merge(v) if v else v for v in spans]
                out = [batch.column(i) for i in range(carried + 1)]
                out += [
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([[{"first": s, "last": e} for s, e in v] for v in spans], _SPANS),
                    pa.array([sorted(v) for v in items], _ITEMS),
                ]
                names = batch.schema.names[: carried + 4]
                if last:
                    where = [[(int(starts[bounds[d] + s]), int(ends[bounds[d] + e - 1])) for s, e in v] for d, v in enumerate(spans)]
                    out[carried + 2] = pa.array([[{"start": s - int(offsets[d]), "end": e - int(offsets[d])} for s, e in v] for d, v in enumerate(where)], _BYTES)
                    out.append(pa.array([sum(e - s for s, e in v) for v in spans], pa.int64()))
                    out.append(pa.array([hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for v in items], pa.string()))
                    names = [*names, "n_hit", "items_sha256"]
                    if cut:
                        kept = []
                        for d, v in enumerate(where):
                            edge, parts = int(offsets[d]), []
                            for s, e in v:
                                parts.append(data[edge:s].tobytes())
                                edge = e
                            parts.append(data[edge : int(offsets[d + 1])].tobytes())
                            kept.append(b"".join(parts).decode() if v else batch.column(0)[d].as_py())
                        out[0] = pa.array(kept, pa.string())
                    elif not cut:
                        out, names = out[1:], names[1:]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _blocks(benchmark: DataFrame, text: str, item: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size, at least one."""
    block: list[tuple[str, str]] = []
    size = 0
    own = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"), F.octet_length(text).alias("n")).where("t is not null")
    for row in own.toLocalIterator():
        if block and size + row["n"] > limit:
            yield block
            block, size = [], 0
        block.append((row["i"] or "", row["t"]))
        size += row["n"]
    yield block


def search(docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``carry`` of every document, with what was found in it.

    Adds ``n_words``, ``spans`` (merged removal spans, byte offsets in the
    UTF-8 text), ``items`` (ids of the items found), ``n_hit`` (words in spans)
    and ``items_sha256``; with ``cut`` also ``cleaned``, the text without the spans.
    """
    spark = docs.sparkSession
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    out = docs.select(
        F.col(text).alias("cleaned"), *carried, F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    kept = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    head = "cleaned string" + (", " + kept if kept else "")
    blocks = _blocks(benchmark, item_text, item, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        last = following is None
        shared = spark.sparkContext.broadcast(Phrases(block, width))
        if last:
            schema = (head if cut else kept) + ", n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, n_hit bigint, items_sha256 string"
        else:
            schema = head + ", n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"
        out = map_batches(out, _searcher(shared, last, cut, len(carry)), schema.lstrip(", "))
        if not last:  # a pass of its own, so that one block at a time is held
            path = fresh_path(spark, "searched")
            out.write.parquet(path)
            out = spark.read.parquet(path)
            shared.destroy()
        block = following
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *(["cleaned"] if cut else []), "n_words", "spans", "items", "n_hit", "items_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = search(docs, benchmark, ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: The query in DuckDB's SQL: windows as texts, an equal join, and covered words counted.
ORACLE_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {WIDTH}) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows x ON p.n = x.n AND array_to_string(p.w[i:i + p.n - 1], ' ') = x.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
