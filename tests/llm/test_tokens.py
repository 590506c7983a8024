"""Operators 2, 8 and 9: against the libraries, round trips, awkward rows."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wideframe.llm import bpe, tokencounts, tokenio
from wideframe.llm._text import key_ranges

from awkward_rows import TEXTS


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        pick = lambda: rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 0x2000), rnd.randrange(0x4E00, 0x9000), rnd.randrange(0x1F300, 0x1F700), 32, 10])
        out.append("".join(chr(pick()) for _ in range(rnd.randrange(80))))
    return [*out, "a" * 3000, " " * 200, "".join(rnd.choice("thein") for _ in range(3000)), "aaaa!!!!....----____" * 20, "ab" * 999]


def test_transducer_equals_merging_by_rank(ranks, library):
    encoder = bpe.Encoder(ranks, bpe.PATTERN)
    for text in odd_texts(150):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_tokens_are_emitted_after_a_bounded_lookahead(ranks, library):
    t = bpe.Transducer(ranks)
    rnd = random.Random(8)
    for piece in ["a" * 100_000, "the" * 20_000, " " * 50_000, "".join(rnd.choice("etaoinshr") for _ in range(50_000)), "=-" * 30_000, "ä世" * 9_000]:
        assert t.encode(piece.encode()) == library._core_bpe.encode_single_piece(piece.encode())
        assert t.longest < t.most_pending <= 3 * t.longest
    assert len(t.encode(b"a" * 1_000_000)) > 0 and t.most_pending <= 3 * t.longest


def test_readings_of_any_vocabulary_meet(ranks):
    """Emission changes no ids, also for small vocabularies with many open readings."""
    rnd = random.Random(12)
    for _ in range(60):
        own = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(own) < rnd.randrange(5, 30):  # each entry joins two earlier ones
            pair = b"".join(rnd.sample(list(own), 2)) if rnd.random() < 0.7 else rnd.choice(list(own)) * 2
            if len(pair) <= 9:
                own.setdefault(pair, len(own))
        t = bpe.Transducer(own)
        for _ in range(5):
            piece = bytes(rnd.choice(b"aaabc") for _ in range(300))
            assert t.encode(piece) == [own[p] for p in t.merge(piece)]


def test_small_caches_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_STEPS", 20)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 20)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    encoder = bpe.Encoder(ranks, bpe.PATTERN)
    for text in odd_texts(30, 5):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_neighbours_stay_apart_as_merging_says(ranks):
    t = bpe.Transducer(ranks)
    rnd, ids = random.Random(3), list(ranks.values())
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        merged = [ranks[p] for p in t.merge(t.token[a] + t.token[b])]
        assert t.may_follow(a, b) == (merged == [a, b])


def test_decoding_in_any_cuts(ranks, library):
    decoder = bpe.StreamDecoder({i: b for b, i in ranks.items()})
    for text in odd_texts(60, 7):
        ids = library.encode_ordinary(text)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text
        assert decoder.feed(ids) + decoder.finish() == text


@pytest.mark.parametrize("raw", [b"\xe4\xb8", b"a\xff\xfeb", b"\xf0\x9f\x99", b"\xed\xa0\x80", b"\xc3(", b"\xf4\x90\x80\x80", b"\xe2\x82\xac"])
def test_machine_equals_decoding_at_once(raw):
    machine = bpe.Utf8Machine()
    assert "".join(machine.feed(raw[i : i + 1]) for i in range(len(raw))) + machine.feed(b"", True) == raw.decode("utf-8", "replace")


def test_machine_equals_decoding_of_random_bytes():
    rnd = random.Random(4)
    for _ in range(3000):
        raw = bytes(rnd.choice([rnd.randrange(256), rnd.randrange(0x80, 0xC0), rnd.choice([0xE0, 0xED, 0xF0, 0xF4, 0xC3])]) for _ in range(rnd.randrange(9)))
        machine, cut = bpe.Utf8Machine(), rnd.randrange(9)
        assert machine.feed(raw[:cut]) + machine.feed(raw[cut:], True) == raw.decode("utf-8", "replace")
    assert machine.held == (0, 0)


def test_op2_rows(spark, awkward, nothing, library):
    rows = bpe.encode(awkward, ["doc_id"]).collect()
    assert sorted((r["n_tokens"], r["ids"]) for r in rows) == sorted((len(i), i) for i in (library.encode_ordinary(t or "") for _, t, _ in TEXTS))
    back = bpe.decode(bpe.encode(awkward, ["doc_id", "text"]), ["text"]).collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    assert bpe.encode(nothing, ["doc_id"]).count() == 0


def test_op2_query(spark, data, library):
    found = {r["doc_id"]: r for r in bpe.op2_byte_bpe(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()
        got = found[r["doc_id"]]
        assert (got["ids_sha256"], got["n_tokens"]) == (hashlib.sha256(ids).hexdigest(), len(ids) // 4)
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_control_bytes_round_trip():
    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 4, 5, 999):
        ranks = np.array([rnd.choice([rnd.randrange(1 << b) for b in (8, 16, 24, 32)]) for _ in range(n)], np.uint32)
        control, data = tokenio.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (tokenio.decode_ranks(control, data, n) == ranks).all()


def expected_files(texts):
    own = Tokenizer.from_file(tokenio.TOKENIZER)
    own.encode_special_tokens = True
    return [np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]


def test_pieces_equal_the_library():
    encoder = tokenio.PieceEncoder(open(tokenio.TOKENIZER).read(), 1)
    texts = [*odd_texts(120, 9), "it's I'M 'S ' s.a,b ,c", "Don't.stop,now É.  x y\x1cz", None]
    assert encoder.encode(texts) == expected_files(texts)


def test_op9_order_and_edges(spark, awkward, nothing, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokenio.write_token_files(awkward, path, block_ids=50)
    rows = sorted(tokenio.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"]
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids) and len(ids) == len(TEXTS)
    assert sorted(np.array(r["ids"], "<u4").tobytes() for r in rows) == sorted(expected_files([t for _, t, _ in TEXTS]))
    tokenio.write_token_files(nothing, f"file://{tmp_path}/none")
    assert tokenio.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_op9_deals_one_id_to_many_ranges(spark, tmp_path):
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("hash", F.xxhash64("text"))
    sizes = docs.groupBy(key_ranges(docs, "doc_id", 30, "hash")).count().collect()
    assert len(sizes) >= 28 and max(r["count"] for r in sizes) < 250
    path = f"file://{tmp_path}/ids"
    tokenio.write_token_files(docs, path, block_ids=500)
    found = sorted(tokenio.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    order = [tuple(r) for r in docs.orderBy(F.asc_nulls_first("doc_id"), "hash").select("doc_id", "text").collect()]
    at = 0
    for r, (doc, _), ids in zip(found, order, expected_files([t for _, t in order]), strict=True):
        assert (r["start"], r["doc_id"], np.array(r["ids"], "<u4").tobytes()) == (at, doc, ids)
        at += r["n_tokens"]


def test_op9_query(spark, data):
    found = {r["doc_id"]: r for r in tokenio.op9_token_files(spark, data).collect()}
    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    at = 0
    for r, ids in zip(docs, expected_files([r["text"] for r in docs]), strict=True):
        got = found[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_frequent_ids_take_one_byte(spark, data, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokenio.write_token_files(spark.read.parquet(f"{data}/documents.parquet"), path)
    total = spark.read.parquet(path).select(F.sum(F.length("data")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()
    assert total[0] < 1.4 * total[1]


def brute_sections(library, text, rule):
    """Tokens of lines, byte by byte."""
    lines, owner = text.encode().split(b"\n"), []
    sizes = [len(x) + (i < len(lines) - 1) for i, x in enumerate(lines)]
    if len(sizes) > 1 and not sizes[-1]:
        sizes.pop()
    for i, n in enumerate(sizes):
        owner += [i] * n
    counts, at = [0.0] * len(sizes), 0
    for i in library.encode_ordinary(text):
        own = owner[at : (at := at + len(library.decode_single_token_bytes(i)))]
        if rule == "split":
            for o in own:
                counts[o] += 1 / len(own)
        else:
            counts[own[0] if rule == "start" else max(sorted(set(own)), key=lambda o: (own.count(o), -o))] += 1
    return counts


@pytest.mark.parametrize("rule", ["start", "majority", "split"])
def test_op8_equals_brute_force(spark, rule):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "the", "\n", "\n\n", "  ", "é", "世", "🙂", "!?"]) for _ in range(rnd.randrange(30))) for _ in range(120)]
    own = bpe.read_ranks(tokencounts.RANKS)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = tokencounts.section_counts(df, ["doc_id"], rule=rule).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
    for i, text in enumerate(texts):
        want = brute_sections(library, text, rule)
        assert [found[i][k] for k in range(len(want))] == pytest.approx(want)


def test_op8_edges(spark, awkward, nothing):
    rows = tokencounts.section_counts(awkward, ["doc_id"]).collect()
    assert sum(r["n_chars"] for r in rows) == sum(len(t or "") for _, t, _ in TEXTS)
    assert [(r["section"], r["n_tokens"]) for r in rows if r["doc_id"] == 3] == [(0, 0.0)]
    assert tokencounts.section_counts(nothing, ["doc_id"]).count() == 0
    given = spark.createDataFrame([(1, "héllo world", [2, 2, 6]), (2, "abc", None), (3, "", [5])], "doc_id bigint, text string, ends array<int>")
    made = tokencounts.section_counts(given, ["doc_id"], bounds="ends").orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["n_chars"]) for r in made] == [(1, 2), (1, 4), (1, 5), (2, 3), (3, 0)]
    with pytest.raises(ValueError):
        tokencounts.section_counts(awkward, [], rule="other")


def test_op9_cuts_only_known_tokenizers(monkeypatch):
    definition = open(tokenio.TOKENIZER, encoding="utf-8").read()
    assert tokenio.may_cut(definition)
    changed = json.loads(definition)
    changed["normalizer"]["normalizers"].remove({"type": "Lowercase"})
    assert not tokenio.may_cut(json.dumps(changed))
    changed = json.loads(definition)
    changed["pre_tokenizer"]["pretokenizers"].pop()
    assert not tokenio.may_cut(json.dumps(changed))
    other = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    assert not tokenio.may_cut(other)
    library = Tokenizer.from_str(other)
    library.encode_special_tokens = True
    texts = [*odd_texts(20), "two  words, and. more\nlines", None]
    for t, made in zip(texts, tokenio.PieceEncoder(other, 1).encode(texts), strict=True):
        assert np.frombuffer(made, "<u4").tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]


def test_op8_query(spark, data):
    """Counts of the query's lines: whole documents by the library, lines by their token starts."""
    ranks = bpe.read_ranks(tokencounts.RANKS)
    library = tiktoken.Encoding("own", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {}
    for r in tokencounts.op8_token_counts(spark, data).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["n_tokens"], r["n_chars"])
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        lines = [x + b"\n" for x in (d["text"] or "").encode().split(b"\n")]
        lines[-1] = lines[-1][:-1]
        lines = lines[:-1] if len(lines) > 1 and not lines[-1] else lines
        starts, at = [], 0
        for i in library.encode_ordinary(d["text"] or ""):
            starts.append(at)
            at += len(library.decode_single_token_bytes(i))
        edges = np.cumsum([0, *map(len, lines)])
        counts = np.histogram(starts, edges)[0] if at else [0]
        assert [got[d["doc_id"]][k] for k in range(len(lines))] == [(int(n), len(x.decode())) for n, x in zip(counts, lines, strict=True)]
