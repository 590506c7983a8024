"""Operators 1, 6 and 7: against brute force, awkward rows."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wideframe.llm import dartminhash, decontam, imatch
from wideframe.llm._text import text_buffer, word_bounds, words

from awkward_rows import LONG, TEXTS, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def test_words_equal_the_pattern(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aB9 ,.é世\n{}~[`") for _ in range(rnd.randrange(60))) for _ in range(200)]
    for chunk in (7, 1 << 20):
        monkeypatch.setattr("wideframe.llm._text.CHUNK_BYTES", chunk)
        data, offsets = text_buffer(pa.array(texts))
        hashes, starts, ends = words(data, offsets)
        bounds = word_bounds(starts, offsets)
        raw = data.tobytes()
        seen = {}
        for i, t in enumerate(texts):
            own = [raw[s:e].decode().translate(LOWER) for s, e in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
            assert own == split(t)
            for w, h in zip(own, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


# operator 6 ------------------------------------------------------------------------------


def shingle_counts(text):
    w = split(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows, least=0.8):
    """Classes by exact weighted similarity of all pairs."""
    texts = sorted({t or "" for _, t in rows})
    bags, up = [shingle_counts(t) for t in texts], list(range(len(texts)))
    sizes = [sum(b.values()) for b in bags]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = sum((bags[i] & bags[j]).values()) if bags[i].keys() & bags[j].keys() else 0
        if both and both >= least * (sizes[i] + sizes[j] - both):
            up[root(j)] = root(i)
    ids = {}
    for d, t in rows:
        if d is not None:
            r = root(texts.index(t or ""))
            ids[r] = min(ids.get(r, d), d)
    return [(d, ids.get(root(texts.index(t or "")))) for d, t in rows]


def shown(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in df.collect()), key=str)


def test_op6_equals_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 40, 120]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(base):  # copies of a text resemble it more than each other
            other = list(text)
            for _ in range(rnd.randrange(0, 4)):
                other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(dartminhash.near_duplicates(df)) == sorted(brute_classes(rows), key=str)


@pytest.mark.parametrize("weighted", [False, True])
def test_op6_large_buckets_are_whole(spark, weighted):
    rnd = random.Random(16)
    word = lambda: f"w{rnd.randrange(100_000)}"
    template, base, rows = [word() for _ in range(84)], [word() for _ in range(120)], []
    for _ in range(150):  # 0.77 to all others, 0.9 to the partner
        own = [word() for _ in range(12)]
        rows += [" ".join(template + own), " ".join(template + own[:8] + [word() for _ in range(4)])]
    for _ in range(150):  # edits all over the text, without the text itself: 0.7 to 0.85
        other = list(base)
        for at in rnd.sample(range(120), 2):
            other[at] = word()
        rows.append(" ".join(other))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(dartminhash.near_duplicates(df, weighted=weighted)) == sorted(brute_classes(rows), key=str)


def test_op6_rounds_have_small_plans(spark, monkeypatch):
    """Centrality travels with the members and later rounds start at a checkpoint, so that the driver has few stages to hold."""
    joins, pairs = [], dartminhash._pairs

    def counted(*args):
        out = pairs(*args)
        joins.append(out._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return out

    monkeypatch.setattr(dartminhash, "_pairs", counted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:59] + [f"x{i}"])) for i in range(8)] + [(8, " ".join(words[::-1]))]
    found = dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert shown(found) == sorted(brute_classes(rows), key=str)
    assert len(joins) >= 2 and joins[0] <= 3 and max(joins[1:]) <= 1


def test_op6_weights_are_copies(spark):
    """Texts with the same set of shingles in different numbers of copies are apart; unweighted they are one."""
    line, other = "a line of six or more words here", "some other line of words that follows"
    rows = [(1, "\n".join([line] * 20 + [other])), (2, "\n".join([line] + [other] * 20)), (3, "\n".join([line] * 21 + [other]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(dartminhash.near_duplicates(df)) == brute_classes(rows) == [(1, 1), (2, 2), (3, 1)]


def test_op6_equals_its_sql(spark, awkward):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([(d, t) for d, t, _ in TEXTS], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    made = [(r["doc_id"], r["class_id"], r["n_class"]) for r in dartminhash.near_duplicates(awkward).collect()]
    assert sorted(made, key=str) == sorted(duckdb.sql(dartminhash.ORACLE_SQL).fetchall(), key=str)


def test_op6_edges(spark, awkward, nothing):
    rows = [(d, t) for d, t, _ in TEXTS]
    assert shown(dartminhash.near_duplicates(awkward)) == sorted(brute_classes(rows), key=str)
    assert dartminhash.near_duplicates(nothing).count() == 0
    kept = dartminhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 5, 6, 8, 9, 10, None]))
    assert dartminhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("repeats", [1, 2])
def test_keep_one_keeps_one_of_an_id_with_several_near_texts(spark, repeats):
    near = [" ".join(f"w{i}" for i in range(n)) for n in (60, 61, 62)]
    rows = [(5, near[0]), (5, near[1]), (7, near[2]), (5, "another text of the same id"), (None, "lone a b c d e"), (None, "lone a b c d e")][: 4 + repeats]
    kept = dartminhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"] in near) for r in kept) == [("5", False), ("5", True), ("None", False)]


def test_op6_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert shown(dartminhash.op6_near_duplicates(spark, data)) == sorted(brute_classes(rows), key=str)


def test_signatures_agree_as_sets_overlap():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for cut in (20, 100, 200):
        other = base.copy()
        other[:cut] = rng.integers(0, 2**63, cut).astype(np.uint64)
        made = dartminhash.dart_signatures(np.concatenate([base, other]), np.array([0, 400, 800]), k=2048)
        assert (made[0] == made[1]).mean() == pytest.approx((400 - cut) / (400 + cut), abs=0.04)


def test_weighted_signatures_agree_as_weights_overlap():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = rng.choice([0.5, 1, 2, 7], 200), rng.choice([0.5, 1, 3], 200)
    made = dartminhash.dart_signatures(np.concatenate([items, items]), np.array([0, 200, 400]), k=2048, weights=np.concatenate([a, b]))
    assert (made[0] == made[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_a_signature_does_not_depend_on_its_batch():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 30).astype(np.uint64)
    alone = dartminhash.dart_signatures(items[10:], np.array([0, 20]))
    both = dartminhash.dart_signatures(items, np.array([0, 10, 10, 30]))
    assert (alone[0] == both[2]).all() and not both[1].any()


# operator 7 ------------------------------------------------------------------------------


def brute_hits(texts, items, width=10):
    windows = {}
    for name, t in items:
        w = split(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = split(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit[k : k + n] = [True] * n
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 40])
def test_op7_equals_brute_force(spark, block):
    rnd = random.Random(8)
    draw = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    items = [(i, draw(rnd.choice([0, 2, 4, 7]))) for i in range(12)] + [(12, None), (None, "d d d d"), (3, draw(5))]
    texts = [draw(rnd.randrange(60)) for _ in range(60)] + [None, "", items[5][1]]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.search(docs, marks, ["doc_id"], width=4, block_bytes=block).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), r["items_sha256"]) for r in found}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items, 4)


def test_op7_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in decontam.op7_decontaminate(spark, data).collect()}
    for r, want in zip(docs, brute_hits([r["text"] for r in docs], items), strict=True):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"]) == want and g["contaminated"] == (want[1] > 0)


def test_op7_cuts_spans_and_edges(spark, awkward, nothing):
    marks = spark.createDataFrame([(1, "brown fox and")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "É quick brown fox, and more."), (2, None), (3, "nothing here")], "doc_id bigint, text string")
    made = {r["doc_id"]: r for r in decontam.search(docs, marks, ["doc_id"], cut=True).collect()}
    assert made[1]["cleaned"] == "É quick  more." and made[3]["cleaned"] == "nothing here"
    assert [(s["start"], s["end"]) for s in made[1]["spans"]] == [(9, 23)]
    none = marks.where("item_id < 0")
    assert {r["n_hit"] for r in decontam.search(awkward, none, ["doc_id"]).collect()} == {0}
    assert decontam.search(nothing, marks, ["doc_id"]).count() == 0
    many = {r["doc_id"]: r["n_hit"] for r in decontam.search(awkward, marks, ["doc_id"]).collect()}
    assert many[8] == 3 * 4000


def test_op7_a_large_benchmark_takes_few_bytes_a_byte():
    """A full block of 32 MB: its arrays as they are broadcast, and the peak while they are made."""
    rnd = random.Random(5)
    common = [f"w{i}" for i in range(20_000)]
    items = [(str(i), " ".join(rnd.choices(common, k=400))) for i in range(14_000)]
    size = sum(len(t) for _, t in items)
    assert size >= 32 << 20
    tracemalloc.start()
    phrases = decontam.Phrases(items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    print("bytes a byte: held", held / size, "peak", peak / size)
    assert held < 5 * size and peak < 10 * size
    text = "some words before " + " ".join(items[77][1].split()[20:31]) + " and after"
    data, offsets = text_buffer(pa.array([text]))
    hashes, starts, _ = words(data, offsets)
    at, window = decontam.find(phrases, hashes, word_bounds(starts, offsets))
    assert sorted(at.tolist()) == [3, 4] and {o for w in window.tolist() for o in phrases.owners(w)} == {"77"}


def test_index_against_plain_search():
    rnd = random.Random(1)
    text = np.array([rnd.choice([0, 1, 2, 3]) for _ in range(400)] + [1, 2] * 60 + [0], np.int64)
    index = decontam.FMIndex(text, sample=5)
    patterns = [tuple(rnd.choice([1, 2, 3]) for _ in range(rnd.randrange(1, 6))) for _ in range(60)]
    lengths = np.array([len(p) for p in patterns])
    low, high = index.search(np.concatenate([np.array(p) for p in patterns]), np.cumsum(lengths) - lengths, lengths)
    for p, a, b in zip(patterns, low.tolist(), high.tolist(), strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


# operator 1 ------------------------------------------------------------------------------


def test_op1_edited_texts(spark, awkward, nothing):
    rows = {}
    known = sorted([(d, t or "") for d, t, _ in TEXTS if d is not None], key=lambda r: (-r[0], r[1]))
    for i, (d, t) in enumerate(known):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + known[(i + 1) % len(known)][1][:cut]
        rows.setdefault(d, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    found = imatch.near_edits(awkward, imatch.lexicon(awkward)).collect()
    got = {}
    for r in found:
        if r["doc_id"] is not None:
            got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in rows.items()}
    assert len(found) == len(TEXTS)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], r)
    assert by[1]["fingerprint"] == by[11]["fingerprint"] != by[2]["fingerprint"]
    assert by[None]["near_next"] == 0 and by[7]["near_next"] == 1
    assert imatch.near_edits(nothing, imatch.lexicon(nothing)).count() == 0


def test_op1_deals_one_id_to_many_ranges(spark):
    rows = [(5 if i % 3 else i, f"text number {i} " * (1 + i % 5)) for i in range(1500)] + [(5, "the same text")] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = [r["text"] for r in docs.orderBy(F.desc("doc_id"), F.desc(F.xxhash64("text")), "text").collect()]
    edited = [t[: len(t) - len(t) // 3] + known[(i + 1) % len(known)][: len(t) // 3] for i, t in enumerate(known)]
    found = imatch.near_edits(docs, imatch.lexicon(docs)).select("edited_sha256").collect()
    assert sorted(r[0] for r in found) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edited)


def test_op1_query_tells_edits_from_strangers(spark, data):
    rows = imatch.op1_imatch(spark, data).collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    made = {}
    for r in rows:
        assert made.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_op1_fingerprints_equal_brute_force(spark):
    """Lexicon by counting, subsets by whole numbers, likeness by comparing sets of terms."""
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(vocabulary[: rnd.choice([60, 400])], k=rnd.choice([0, 3, 40, 400]))) for _ in range(60)]
    texts = [t if i % 3 else texts[i - 1] + " w7 extra" for i, t in enumerate(texts)] + ["unheard of words", "other strange things"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = imatch.fingerprints(pa.array(texts), imatch.lexicon(df))
    known = Counter(w for t in texts for w in set(split(t)))
    n = len(texts)
    lexicon = {w for w, df in known.items() if df >= n ** (1 - imatch.MOST_IDF) and np.log(n / df) >= imatch.LEAST_IDF}
    assert 0 < len(lexicon) < len(known)
    number = {w: int(imatch.terms(pa.array([w]))[0][0]) for w in known}

    def subsets(text):
        own, out = {}, []
        for k in range(imatch.SLOTS):
            kept = set(split(text)) & lexicon
            for s in range(imatch.SCALES):
                kept = {w for w in kept if number[w] * int(imatch._SLOT_SEEDS[s * imatch.SLOTS + k]) % 2**64 < 2**62}
                own[s, k] = frozenset(kept)
        for s in range(imatch.SCALES):
            out.append([own[s, k] for k in range(imatch.SLOTS)])
        return out

    sets = [subsets(t) for t in texts]
    for i in range(n):
        assert [x > 0 for x in made[i, 1:].tolist()] == [bool(x) for scale in sets[i] for x in scale]
    for i, j in itertools.combinations(range(n), 2):
        like = imatch.likeness(made[i : i + 1], made[j : j + 1])[0]
        used = [sum(bool(x or y) for x, y in zip(a, b, strict=True)) for a, b in zip(sets[i], sets[j], strict=True)]
        enough = [s for s in range(imatch.SCALES) if used[s] >= imatch.LEAST_SLOTS]
        s = enough[-1] if enough else used.index(max(used))
        same = sum(bool(x) and x == y for x, y in zip(sets[i][s], sets[j][s], strict=True))
        a, b = (set(split(t)) & lexicon or set(split(t)) for t in (texts[i], texts[j]))
        if a == b:
            assert like == 1
        else:  # hashes of eight bits may agree by chance
            assert same / max(used[s], 1) <= like <= same / max(used[s], 1) + 4 / imatch.LEAST_SLOTS
    assert imatch.likeness(made[n - 2 : n - 1], made[n - 1 :])[0] == 0  # no lexicon term


def test_op1_tells_edits_of_very_long_texts():
    rnd = random.Random(14)
    a, b = ([f"{c}{rnd.randrange(10**9)}" for _ in range(50_000)] for c in "ab")
    table = imatch.fingerprints(pa.array([" ".join(a), " ".join(a[: -len(a) // 3] + b[: len(a) // 3]), " ".join(b)]), np.full(imatch.BUCKETS // 64, -1, np.int64))
    near, far = imatch.likeness(table[:1], table[1:2])[0], imatch.likeness(table[:1], table[2:])[0]
    assert near > 0.25 and far < 0.1


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"common {'half' if i % 2 else 'other'} pair{i // 2} only{i}") for i in range(40)], "doc_id bigint, text string")
    bits = imatch.lexicon(docs)

    def inside(word):
        h, _ = imatch.terms(pa.array([word]))
        at = int(h[0] % np.uint64(imatch.BUCKETS))
        return bool((int(bits[at >> 6]) >> (at & 63)) & 1)

    assert [inside(w) for w in ("common", "half", "pair3", "only3")] == [False, False, True, False]


def test_long_texts_keep_memory_small():
    table = imatch.fingerprints(pa.array([LONG, LONG]), np.zeros(imatch.BUCKETS // 64, np.int64))
    assert (table[0] == table[1]).all()


def test_joined_labels_equal_components_of_all_links(spark):
    rnd = random.Random(11)
    pairs = [tuple(rnd.sample(range(120), 2)) for _ in range(90)]
    old, new = spark.createDataFrame(pairs[:50], "a int, b int"), spark.createDataFrame(pairs[50:], "a int, b int")
    got = {r["node"]: r["label"] for r in dartminhash.joined_labels(dartminhash.components(old), new).collect()}
    want = {r["node"]: r["label"] for r in dartminhash.components(old.union(new)).collect()}
    assert got == want
