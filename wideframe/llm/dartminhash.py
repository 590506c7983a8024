"""Operator 6 - near-duplicate detection by DartMinHash.

A document is the multiset of its five-word shingles: a shingle's weight is the
number of its copies (unweighted, as an option, it is the set).  Every shingle owns a hashed Poisson process of darts over the half-plane of
weight and rank.  A document keeps the darts that fall below its shingles'
weights, each dart belongs to one of ``COORDINATES`` coordinates, and the
earliest dart of each coordinate is the signature: two documents agree on a
coordinate with probability equal to their (weighted) Jaccard similarity.  The
darts thrown number about k ln k + 2k for any document size.

Plan
1. one map over the documents writes (doc_id, text key, band hashes);
2. equal texts become one node, keyed by the MD5 of the text;
3. bands that several nodes share are counted; each node's centrality is the
   sum of the sizes of its buckets;
4. in each bucket the ``LEADERS`` most central nodes are paired with every
   member, so a bucket of n nodes gives at most LEADERS * n pairs, never n^2 (a
   bucket of up to LEADERS + 1 nodes gives all its pairs).  Near copies of one
   text collide with it more than with each other, so it leads their buckets;
5. each pair's texts are joined and their exact similarity decides;
6. links become classes by label propagation with pointer jumping; a class is
   named by its smallest ``doc_id``;
7. larger buckets that still hold several classes are paired again, each round
   under another, hashed leader, members of one class left out, until a round
   finds no link; its links join whole classes, so only those are labelled anew;
8. the members of buckets that still hold several classes are joined exactly, by
   common shingles in their prefixes of rare ones, places and sizes allowing.

What can be missed: a pair of similarity 0.8 shares no band with probability
(1 - 0.8^4)^32 < 5e-8.  Nothing else: what the rounds leave apart in buckets of
more than LEADERS + 1 nodes is joined exactly, by prefixes of rare shingles.

Scale: text is shuffled once, for the exact check, and only texts in candidate
pairs go on from there.  Hot texts are spread by doc_id, hot buckets are
summed before the shuffle, hot leaders are split by adaptive skew joins.  The exact
join's pairs grow with the square of a group only if its members lie just below
the threshold to each other, their differences spread over the whole text.

Edge cases: a null text is an empty text, and empty texts are equal.  A text of
1 to 4 words is one shingle; texts without words are compared by equality only.
Rows with a null id share the class of their text; a class without any id has a
null ``class_id``.  Repeated rows each get a row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import SQL_WORDS, drop_tables, fresh_path, list_array, map_batches, mix64, row_groups, shared_dir, text_buffer, word_bounds, words

#: Words in a shingle and least similarity of a link.
SHINGLE = 5
SIMILARITY = 0.8
#: Signature coordinates, and coordinates in a band.
COORDINATES = 128
ROWS = 4
#: Most central nodes of a bucket that are paired with its members.
LEADERS = 4
#: Leaders of a bucket in each later round.
LATER_LEADERS = 1
#: Counters of hashed shingles that order them by rarity; results do not depend on them.
SLOTS = 1 << 18
#: Text bytes whose signatures a worker makes at once.
GROUP_BYTES = 2 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Upper 32-bit bounds of Poisson(1) counts 0, 1, 2, ...
_POISSON = (np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)])) * 2.0**32).astype(np.uint64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in turn, and n+1 positions where each text's begin."""
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - ends[:-1], count) + np.arange(ends[-1])
    width = np.repeat(np.minimum(n, size), count)
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        at = np.minimum(first + k, max(len(hashes) - 1, 0))
        out = mix64(out * np.uint64(3) + np.where(k < width, hashes[at] + np.uint64(k + 1), np.uint64(0))) if len(hashes) else out
    return out, ends


def dart_signatures(elements: np.ndarray, bounds: np.ndarray, k: int = COORDINATES, weights: np.ndarray | None = None) -> np.ndarray:
    """Signature (n x k, 32-bit darts) of each of n non-empty sets of hashed elements.

    ``weights`` are the elements' weights (none: 1 each, repeated elements count
    once, since equal elements throw equal darts).
    """
    n = len(bounds) - 1
    out = np.zeros((n, k), np.uint32)
    size = np.diff(bounds)
    left = np.flatnonzero(size > 0)
    darts = k * (np.log(k) + 2)
    while len(left):
        count = size[left]
        edge = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(bounds[left] - edge[:-1], count) + np.arange(edge[-1])
        doc = np.repeat(np.arange(len(left)), count)
        h = elements[at]
        w = np.ones(len(at)) if weights is None else weights[at]
        limit = darts / np.add.reduceat(w, edge[:-1])
        best = np.full(len(left) * k, np.iinfo(np.uint64).max, np.uint64)
        strip = 0
        while True:
            low = 2.0**strip - 1
            own = np.flatnonzero(w > low)
            if not len(own):
                break
            cells = np.ceil(limit[doc[own]] * 2.0**strip).astype(np.int64)
            _throw(best, h[own], w[own], doc[own], limit, cells, strip, k)
            strip += 1
        best = best.reshape(len(left), k)
        full = (best != np.iinfo(np.uint64).max).all(axis=1)
        out[left[full]] = (best[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        left = left[~full]
        darts *= 2
    return out


def _throw(best: np.ndarray, h: np.ndarray, w: np.ndarray, doc: np.ndarray, limit: np.ndarray, cells: np.ndarray, strip: int, k: int) -> None:
    """Throws the darts of unit-area cells (strip of weights, run of ranks) and keeps the earliest."""
    owner = np.repeat(np.arange(len(h)), cells)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix64(h[owner] + (place.astype(np.uint64) + np.uint64(strip << 40) + np.uint64(1)) * _GOLD)
    number = np.searchsorted(_POISSON, cell >> np.uint64(32), "right")
    hit = np.repeat(np.arange(len(cell)), number)
    turn = np.arange(len(hit)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix64(cell[hit] ^ ((turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
    rank = (place[hit] + (dart >> np.uint64(32)).astype(np.float64) / 2.0**32) / 2.0**strip
    to = doc[owner[hit]]
    share = rank / limit[to]
    keep = share < 1
    if np.any(w < 2.0 ** (strip + 1) - 1):
        other = mix64(dart + _GOLD)
        keep &= 2.0**strip - 1 + (other >> np.uint64(32)).astype(np.float64) / 2.0**32 * 2.0**strip < w[owner[hit]]
    dart, to, share = mix64(dart[keep]), to[keep], share[keep]
    value = ((share * 2.0**32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
    np.minimum.at(best, to * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)


def band_hashes(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of each signature; bands never share one."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * _GOLD, (n, k // rows))
    for r in range(rows):
        out = mix64(out + parts[:, :, r])
    return out.view(np.int64)


def _weighted(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each set, their bounds and their counts."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((elements, doc))
    e, d = elements[order], doc[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return e[at], np.searchsorted(d[at], np.arange(len(bounds))), np.diff(np.append(at, len(e))).astype(np.float64)


def _signer(weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole, 0, GROUP_BYTES):
                data, offsets = text_buffer(batch.column(0))
                hashes, starts, _ = words(data, offsets)
                elements, bounds = shingles(hashes, word_bounds(starts, offsets))
                weights = None
                if weighted:
                    elements, bounds, weights = _weighted(elements, bounds)
                bands = band_hashes(dart_signatures(elements, bounds, weights=weights))
                some = np.diff(bounds) > 0
                lists = list_array(pa.array(bands[some].ravel(), pa.int64()), some * bands.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists], names=["tkey", "doc_id", "bands"])

    return run


def _checker(weighted: bool, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, text of a, text of b) of at least the given similarity."""

    def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        data, offsets = text_buffer(column)
        hashes, starts, _ = words(data, offsets)
        elements, bounds = shingles(hashes, word_bounds(starts, offsets))
        return [np.unique(elements[i:j], return_counts=True) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole, 3, GROUP_BYTES):
                keys = batch.column(0).to_pylist()
                first = {key: i for i, key in reversed(list(enumerate(keys)))}
                left = dict(zip(first, sets(batch.column(2).take(pa.array(list(first.values())))), strict=True))
                ok = []
                for key, (b, nb) in zip(keys, sets(batch.column(3)), strict=True):
                    a, na = left[key]
                    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    if weighted:
                        both = int(np.minimum(na[i], nb[j]).sum())
                        ok.append(both >= least * (int(na.sum()) + int(nb.sum()) - both))
                    else:
                        ok.append(len(i) >= least * (len(a) + len(b) - len(i)))
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _copies(texts: pa.Array, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text and their bounds; weighted: each copy of a shingle is an element of its own."""
    data, offsets = text_buffer(texts)
    hashes, starts, _ = words(data, offsets)
    elements, bounds, counts = _weighted(*shingles(hashes, word_bounds(starts, offsets)))
    if not weighted:
        return elements, bounds
    n = counts.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    turn = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    return mix64(np.repeat(elements, n) + turn.astype(np.uint64) * _GOLD), ends[bounds]


def _counter(weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(slot, n) of the shingles of (tkey, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for batch in row_groups(whole, 2, GROUP_BYTES):
                elements, _ = _copies(batch.column(2), weighted)
                total += np.bincount((elements % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    return run


def _prefixes(weighted: bool, least: float, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(e, tkey, label, n, i): the first shingles of each set of n, by rarity, at place i from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole, 2, GROUP_BYTES):
                elements, bounds = _copies(batch.column(2), weighted)
                size = np.diff(bounds)
                doc = np.repeat(np.arange(len(size)), size)
                elements = elements[np.lexsort((elements, common[(elements % np.uint64(SLOTS)).astype(np.int64)], doc))]
                place = np.arange(len(elements)) - bounds[doc] + 1
                first = place <= (size - np.ceil(least * size - 1e-9) + 1)[doc]
                own = pa.array(doc[first])
                columns = [pa.array(elements[first].view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(size[doc[first]]), pa.array(place[first])]
                yield pa.RecordBatch.from_arrays(columns, names=["e", "tkey", "label", "n", "i"])

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node of the links with the least node of its component.

    Label propagation with pointer jumping; each round is cut off by a
    checkpoint in the shared folder.
    """
    shared_dir(links.sparkSession)
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.union(both.select("y", "x")).distinct().checkpoint()
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label").checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("node", "was", F.least("label", "far").alias("label")).checkpoint()
        labels = step.select("node", "label")
        if not step.where("label <> was").limit(1).count():
            return labels


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links (a, b): only the components of the classes that they join are made."""
    own = [labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b")]
    between = links.join(own[0], "a", "left").join(own[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    merged = components(between)
    known = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return known.union(merged.join(labels.select("node"), "node", "left_anti").select("node", "label")).checkpoint()


def _pairs(members: DataFrame, order: list, leaders_each: int) -> DataFrame:
    """(a, b): each member (band, tkey, label, central) with those of the first members of its bucket that have another label.

    The more central node of a pair is ``a``, so that a hub's text is joined last.
    """
    turn = F.row_number().over(Window.partitionBy("band").orderBy(*order))
    leaders = members.withColumn("turn", turn).where(F.col("turn") <= leaders_each)
    leaders = leaders.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("tkey", "label", "central"))).alias("leaders"))
    paired = members.select("band", "tkey", "label", "central").join(leaders, "band").groupBy("tkey", "label", "central").agg(F.collect_set("leaders").alias("sets"))
    pairs = paired.select("tkey", "label", "central", F.explode(F.array_distinct(F.flatten("sets"))).alias("l")).where("l.label <> label")
    return _ordered(pairs.select("tkey", "central", F.col("l.tkey").alias("lead"), F.col("l.central").alias("lead_central")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (tkey, central, lead, lead_central), the more central node first."""
    lead_left = (F.col("lead_central") > F.col("central")) | ((F.col("lead_central") == F.col("central")) & (F.col("lead") < F.col("tkey")))
    return pairs.select(F.when(lead_left, F.col("lead")).otherwise(F.col("tkey")).alias("a"), F.when(lead_left, F.col("tkey")).otherwise(F.col("lead")).alias("b")).distinct()


def _all_pairs(nodes: DataFrame, weighted: bool, least: float, paths: list[str]) -> DataFrame:
    """(tkey, lead): all pairs of nodes (tkey, label, text) with different labels whose shingles' places allow the similarity.

    Prefixes and postings are written to the two paths.  One of a pair is outside the most frequent label of their common shingle, so
    a large class is not paired with itself.
    """
    spark = nodes.sparkSession
    counted = map_batches(nodes, _counter(weighted), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(SLOTS, np.uint8)
    common[counted["slot"].to_numpy()] = np.minimum(np.log2(counted["n"].to_numpy()) * 8, 255)
    prefixes, postings = paths
    map_batches(nodes, _prefixes(weighted, least, common), "e bigint, tkey binary, label binary, n bigint, i bigint").write.parquet(prefixes)
    first = spark.read.parquet(prefixes)
    kinds = first.groupBy("e", "label").agg(F.count(F.lit(1)).alias("rows"))
    kinds = kinds.groupBy("e").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("label", "rows").alias("main")).where("kinds > 1").select("e", "main")
    first.join(kinds, "e").write.parquet(postings)
    y = spark.read.parquet(postings)
    x = y.where("label <> main").select("e", F.col("tkey").alias("lead"), F.col("label").alias("lead_label"), F.col("n").alias("m"), F.col("i").alias("j"))
    both = x.join(y, "e").where("lead_label <> label and (label = main or lead < tkey)")
    need = F.lit(least / (1 + least)) * (F.col("n") + F.col("m")) - 1e-9
    both = both.where(1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need)
    return both.where(F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9).select("tkey", "lead").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", weighted: bool = True, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_class, tkey, label) of every document.

    ``class_id`` names its class of near duplicates, ``n_class`` counts the
    class's rows; ``tkey`` is the MD5 of its text, ``label`` the least of its class.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("doc_id")).withColumn("tkey", F.unhex(F.md5("text")))
    path = fresh_path(spark, "dart-signatures")
    map_batches(own.select("text", "tkey", "doc_id"), _signer(weighted), "tkey binary, doc_id bigint, bands array<bigint>").write.parquet(path)
    signed = spark.read.parquet(path)
    nodes = signed.groupBy("tkey").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))

    banded = signed.select("tkey", F.explode("bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    own_tables = [fresh_path(spark, f"dart-{name}") for name in ("buckets", "texts", "prefixes", "postings")]
    banded.join(shared, "band").write.parquet(own_tables[0])
    members = spark.read.parquet(own_tables[0])
    central = members.groupBy("tkey").agg(F.sum("size").alias("central")).checkpoint()

    wanted = nodes.join(central, "tkey").select(F.col("tkey").alias("k"), "rep")
    texts = own.join(wanted, (F.col("tkey") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").dropDuplicates(["tkey"])
    texts.select("tkey", "text").write.parquet(own_tables[1])
    texts = spark.read.parquet(own_tables[1])

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are similar."""
        joined = pairs.join(texts.select(F.col("tkey").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("tkey").alias("a"), F.col("text").alias("text_a")), "a")
        return map_batches(joined.select("a", "b", "text_a", "text_b"), _checker(weighted, similarity), "a binary, b binary").checkpoint()

    # first round: the most central nodes lead
    pairs = _pairs(members.join(central, "tkey").withColumn("label", F.col("tkey")), [F.desc("central"), F.asc("tkey")], LEADERS).checkpoint()
    tested, labels = pairs, components(linked(pairs))
    # further rounds: buckets that hold several classes take other leaders, until a round finds no link
    large, turn = members.where(F.col("size") > LEADERS + 1).join(central, "tkey").select("band", "tkey", "central"), 0
    while True:
        turn += 1
        named = large.join(labels.withColumnRenamed("node", "tkey"), "tkey", "left").withColumn("label", F.coalesce("label", "tkey"))
        mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
        # checkpointed, as all further plans start here: a bucket of one class stays one
        named = named.join(mixed, "band", "left_semi").checkpoint()
        large = named.drop("label")
        pairs = _pairs(named, [F.xxhash64(F.lit(turn), "band", "tkey"), F.asc("tkey")], LATER_LEADERS)
        pairs = pairs.join(tested, ["a", "b"], "left_anti").checkpoint()
        more = linked(pairs)
        tested = tested.union(pairs)
        if not more.limit(1).count():
            break
        labels = joined_labels(labels, more)
    # what is left of the buckets that still hold several classes is joined exactly
    left = named.select("tkey", "label").distinct()
    pairs = _all_pairs(left.join(texts, "tkey").select("tkey", "label", "text"), weighted, similarity, own_tables[2:])
    pairs = pairs.join(central.select(F.col("tkey").alias("lead"), F.col("central").alias("lead_central")), "lead").join(central, "tkey")
    pairs = _ordered(pairs).join(tested, ["a", "b"], "left_anti").checkpoint()
    more = linked(pairs)
    if more.limit(1).count():
        labels = joined_labels(labels, more)
    drop_tables(spark, *own_tables)  # signatures and checkpointed labels make the result

    named = nodes.join(labels.withColumnRenamed("node", "tkey"), "tkey", "left").withColumn("label", F.coalesce("label", "tkey"))
    classes = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("n_class"))
    found = named.select("tkey", "label").join(classes, "label").select("tkey", "label", "class_id", "n_class")
    return signed.select("doc_id", "tkey").join(found, "tkey").select("doc_id", "class_id", "n_class", "tkey", "label")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay if each class keeps the row of its smallest id.

    Rows with a null id stay only for a class without ids.  Of several texts of
    that id in a class the one of the smallest MD5 stays, and of rows that repeat
    the id and the text that stays, one.
    """
    found = near_duplicates(docs, text, doc_id, **options)
    path = fresh_path(docs.sparkSession, "classes")
    own = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("rows"))
    own.groupBy("label").agg(F.min(F.struct("tkey", "doc_id", "rows")).alias("s")).select("s.*").write.parquet(path)
    stay = docs.sparkSession.read.parquet(path)
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("tkey").alias("stay_key"), "rows")
    # the whole row as one column, so that no name can clash
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("own_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_key") == F.col("stay_key"))
    if not stay.where("rows > 1").limit(1).count():
        return packed.join(stay, same, "left_semi").select("row.*")
    # repeated rows: one of several equal rows stays
    return packed.join(stay, same).dropDuplicates(["stay_id", "stay_key"]).select("row.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_class")


#: The query in DuckDB's SQL: all pairs with a common shingle, and their components.
ORACLE_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT text, row_number() OVER (ORDER BY text) AS k, min(doc_id) AS rep, count(*) AS n FROM docs GROUP BY text),
split AS (SELECT k, {SQL_WORDS} AS w FROM texts),
placed AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM split WHERE len(w) >= {SHINGLE}),
runs AS (SELECT k, concat_ws(' ', w, {", ".join(f"lead(w, {i}) OVER o" for i in range(1, SHINGLE))}) AS s, lead(w, {SHINGLE - 1}) OVER o AS last FROM placed WINDOW o AS (PARTITION BY k ORDER BY i)),
shingles AS (SELECT k, s, count(*) AS c FROM (SELECT k, s FROM runs WHERE last IS NOT NULL UNION ALL SELECT k, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND {SHINGLE - 1}) GROUP BY k, s),
sizes AS (SELECT k, sum(c) AS n FROM shingles GROUP BY k),
common AS (SELECT a.k AS x, b.k AS y, sum(least(a.c, b.c)) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.k < b.k GROUP BY a.k, b.k),
links AS (SELECT x, y FROM common JOIN sizes p ON p.k = x JOIN sizes q ON q.k = y WHERE m >= CAST({SIMILARITY} AS DOUBLE) * (p.n + q.n - m)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT k, k AS label FROM texts UNION SELECT y, label FROM reached JOIN edges ON x = k WHERE label < y),
labels AS (SELECT k, min(label) AS label FROM reached GROUP BY k),
classes AS (SELECT label, min(rep) AS class_id, CAST(sum(n) AS BIGINT) AS n_class FROM labels JOIN texts USING (k) GROUP BY label)
SELECT d.doc_id, class_id, n_class FROM docs d JOIN texts USING (text) JOIN labels USING (k) JOIN classes USING (label)
"""
