"""Operator 4 - language identification as a multilingual mixture.

A document is a bag of letter trigrams, each drawn from one of the languages it
is written in.  Trigram likelihoods of every language are learned from labelled
documents.  For each document expectation-maximisation estimates the languages'
proportions, until none changes by more than ``SETTLED`` (or ``ROUNDS`` rounds); the
language set is then the one, among the m most used languages for every m, whose
log-likelihood less a penalty of ``PENALTY`` * ln(trigrams) for each language beyond
the first is highest.  A larger set is only tried while the likelihood of all
languages together would still pay for it.  The prediction is the largest proportion
of that set, and the score its proportion times the probability of its best
single-language reading.  ``margin`` says how much likelier a trigram is under the
set than if all features were equally likely, in nats: below 0 the text is in
none of the languages, however many were learned.

Training: whole texts of at most ``SAMPLE_PER_LANGUAGE`` distinct labelled documents of
each language, those with the smallest hashes.  The ranking is made in salted parts first,
and the model has a fixed size (``FEATURES`` x languages), so what is broadcast does not grow with the data.

Edge cases: null texts and texts without a letter are ``und`` with score 0.
Null labels are never learned from; documents with a null id are treated as held
out.  Ties go to the language first in order.  With no labelled document every
text is ``und``.  Repeated rows each get a row, and count once in training; very long
texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import list_array, map_batches, row_groups

UNKNOWN = "und"
#: Labelled documents of each language that the model is fitted on, at most.
SAMPLE_PER_LANGUAGE = 400
#: Parts that a language's documents are dealt into before they are ranked.
SALTS = 61
#: Hashed trigram features.
FEATURES = 1 << 15
#: Added to every feature's count.
SMOOTHING = 0.5
#: Penalty for each language of a document beyond the first.
PENALTY = 3.0
#: Expectation-maximisation ends when no proportion changes by more, or after so many rounds.
SETTLED, ROUNDS = 0.01, 40
#: Remainder of crc32(doc_id) mod 4 that is held out.
HELD_OUT = 2
GROUP_BYTES = 1 << 20

_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _is_letter


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all texts in turn, each text's number of features, and whether it has a letter.

    A trigram has at least one letter and lies within a word and the blank on either side of it.
    """
    folded = [" " + t.lower() + " " for t in texts]
    size = np.array([len(t) for t in folded])
    code = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    doc = np.repeat(np.arange(len(texts)), size)
    code = np.where(letter, code, 0)
    keep = letter.copy()  # runs of other characters become one blank
    keep[1:] |= letter[:-1]
    keep[:1] = True
    edge = np.cumsum(size) - size
    keep[edge] = True
    code, doc, letter = code[keep], doc[keep], letter[keep]
    h = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    own = (doc[:-2] == doc[2:]) & letter[1:-1]
    found = (h[own] >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int64)
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    return found, np.bincount(doc[:-2][own], minlength=len(texts)), has


def bags(features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and count of each distinct feature of each text."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = np.sort(doc * FEATURES + features)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at] // FEATURES, key[at] % FEATURES, np.diff(np.append(at, len(key)))


class Bags:
    """Texts as runs of (likelihoods by language, count) of their distinct features."""

    def __init__(self, p: np.ndarray, count: np.ndarray, row: np.ndarray):
        self.p, self.count, self.row = p, count, row
        self.start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        self.total = np.add.reduceat(count.astype(np.float64), self.start) if len(row) else np.zeros(0)

    def only(self, chosen: np.ndarray) -> Bags:
        """The texts for which ``chosen`` is true."""
        inside = chosen[self.row]
        return Bags(self.p[:, inside], self.count[inside], (np.cumsum(chosen) - 1)[self.row[inside]])

    def step(self, share: np.ndarray) -> np.ndarray:
        """One round of expectation-maximisation."""
        part = share.astype(np.float32)[:, self.row] * self.p
        part *= self.count / np.maximum(part.sum(axis=0), 1e-30)
        return np.add.reduceat(part, self.start, axis=1).astype(np.float64) / self.total

    def fit(self, share: np.ndarray) -> np.ndarray:
        """Log-likelihood of each text."""
        return np.add.reduceat(np.log(np.maximum((share.astype(np.float32)[:, self.row] * self.p).sum(axis=0), 1e-30)) * self.count, self.start)


def expectation_maximisation(bags: Bags, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Settled proportions (languages x texts) from given ones, and log-likelihoods."""
    share, left, at = share.copy(), bags, np.arange(share.shape[1])
    for _ in range(ROUNDS):
        if not len(at):
            break
        now = left.step(share[:, at])
        moved = np.abs(now - share[:, at]).max(axis=0) > SETTLED
        share[:, at] = now
        if not moved.all():
            left, at = left.only(moved), at[moved]
    return share, bags.fit(share) if len(bags.start) else np.zeros(0)


def mixtures(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language (number, -1 without features), score, proportions (texts x languages) and margin of each of n texts."""
    k = log_p.shape[0]
    best, score, shares, margin = np.full(n, -1), np.zeros(n), np.zeros((n, k)), np.zeros(n)
    if not len(doc) or not k:
        return best, score, shares, margin
    row = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    logs = log_p[:, feature]
    bags = Bags(np.exp(logs).astype(np.float32), count.astype(np.float32), row)
    texts = doc[bags.start]
    single = np.add.reduceat(logs * bags.count, bags.start, axis=1)
    first, most_fit = expectation_maximisation(bags, np.full((k, len(texts)), 1.0 / k))
    place = np.argsort(np.argsort(-first, axis=0, kind="stable"), axis=0, kind="stable")
    # one language: the likeliest of all, needs no rounds
    chosen = (np.arange(k)[:, None] == single.argmax(axis=0)).astype(np.float64)
    fitted = single.max(axis=0)
    value, cost = fitted.copy(), PENALTY * np.log(bags.total + 1)
    for m in range(2, k + 1):
        open_at = np.flatnonzero(most_fit - cost * (m - 1) > value)
        if not len(open_at):
            break
        start = np.where(place[:, open_at] < m, first[:, open_at], 0)
        some = bags.only(np.isin(np.arange(len(texts)), open_at))
        share, fit = expectation_maximisation(some, start / start.sum(axis=0))
        better = fit - cost[open_at] * (m - 1) > value[open_at]
        at = open_at[better]
        chosen[:, at], fitted[at] = share[:, better], fit[better]
        value[at] = fit[better] - cost[at] * (m - 1)
    most = single.max(axis=0)
    odds = np.exp(np.maximum(single - most, -700) / 3.0)  # each letter is in three trigrams
    sure = odds.max(axis=0) / odds.sum(axis=0)
    best[texts] = chosen.argmax(axis=0)
    score[texts] = np.clip(chosen.max(axis=0) * sure, 0, 1)
    shares[texts] = chosen.T
    margin[texts] = fitted / bags.total + np.log(FEATURES)
    return best, score, shares, margin


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out of training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(True))


def _count(langs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), FEATURES), np.int64)
        for whole in batches:
            for batch in row_groups(whole, 0, GROUP_BYTES):
                texts = [t or "" for t in batch.column(0).to_pylist()]
                features, sizes, _ = trigrams(texts)
                lang = np.repeat(np.array([langs.index(v) for v in batch.column(1).to_pylist()], np.int64), sizes)
                table += np.bincount(lang * FEATURES + features, minlength=table.size).reshape(table.shape)
        lang, feature = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(feature, pa.int32()), pa.array(table[lang, feature], pa.int64())], names=["lang", "feature", "n"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-likelihood of each feature in each."""
    known = docs.where(~held_out(doc_id) & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("h"))
    ranked = known.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):  # cut within salted parts first, so that no task ranks a whole language
        ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("turn") <= per_language).drop("turn")
    chosen = ranked.select("lang", "h")
    langs = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    # bounded: per_language hashes of each language
    sample = known.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    counts = map_batches(sample.select("text", "lang"), _count(langs), "lang int, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    table = np.full((len(langs), FEATURES), SMOOTHING)
    for r in counts:
        table[r["lang"], r["feature"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def _predict(model, places: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p = model.value
        for whole in batches:
            for batch in row_groups(whole, 0, GROUP_BYTES):
                features, sizes, has = trigrams([t or "" for t in batch.column(0).to_pylist()])
                best, score, shares, margin = mixtures(*bags(features, sizes), batch.num_rows, log_p)
                sure = has & (best >= 0)
                pred = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), sure.tolist(), strict=True)]
                shares[~sure] = 0
                doc, lang = np.nonzero(shares)
                held = np.bincount(doc, minlength=batch.num_rows)
                mixed = [list_array(pa.array([langs[v] for v in lang.tolist()], pa.string()), held), list_array(pa.array(shares[doc, lang], pa.float64()), held)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in places), pa.array(pred, pa.string()), pa.array(np.where(sure, score, 0.0), pa.float64()), *mixed, pa.array(np.where(sure, margin, 0.0), pa.float64())],
                    names=[*(f"c{i}" for i in range(len(places))), "lang_pred", "score", "languages", "proportions", "margin"],
                )

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str], text: str = "text") -> DataFrame:
    """Columns ``carry`` of every document with ``lang_pred``, ``score``, ``languages`` and their ``proportions``, and ``margin``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in carry if c != text]  # the text itself is sent once
    own = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(others)])
    kept = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    places = [0 if c == text else 1 + others.index(c) for c in carry]
    out = map_batches(own, _predict(shared, places), f"{kept}lang_pred string, score double, languages array<string>, proportions array<double>, margin double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score", "languages", "proportions", "margin")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, and the mixture it was chosen from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions", "margin")
