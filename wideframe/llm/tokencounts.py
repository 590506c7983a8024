"""Operator 8 - token counts of sections by offset-mapped attribution.

A whole document is encoded once.  The running sum of token lengths gives each
token's span; an interval join (binary search of the spans in the sorted section
bounds) attributes tokens to sections.  A token that crosses a boundary is
allocated by the rule asked for:

``start``     to the section that holds its first byte (production rule);
``majority``  to the section that holds most of its bytes, of equals the first;
``split``     to all its sections, in proportion to its bytes in each.

Sections of a document are its lines, the line feed belonging to the line that it
ends; any other sections can be given as bounds.  Counts of a document's sections
sum to its tokens under each rule.

Scale: a map without shuffle; long documents are held one at a time.

Edge cases: a null or empty text has one empty section without tokens.  Empty
lines are sections.  A section inside one token may get none.  Repeated rows and
null ids each get their rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import list_array, map_batches, row_groups, text_buffer
from .bpe import read_ranks

#: Rank file and splitting pattern of the production query, and its rule.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RULE = "start"
GROUP_BYTES = 4 << 20


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and boundary-crossing tokens that touch it.

    Both arguments are ascending end offsets; the last ones are equal.
    """
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n), np.zeros(n, np.int64)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    first = np.minimum(first, last)
    crossing = np.flatnonzero(last > first)
    touched = np.zeros(n + 1, np.int64)
    np.add.at(touched, first[crossing], 1)
    np.add.at(touched, last[crossing] + 1, -1)
    counts = np.bincount(first, minlength=n).astype(np.float64)
    if rule != "start":
        for t in crossing.tolist():
            counts[first[t]] -= 1
            a, b = int(first[t]), int(last[t])
            ends = np.minimum(section_ends[a : b + 1], token_ends[t])
            inside = np.diff(np.concatenate([[starts[t]], ends]))
            if rule == "majority":
                counts[a + int(inside.argmax())] += 1
            else:
                counts[a : b + 1] += inside / inside.sum()
    return counts, np.cumsum(touched)[:n]


def line_ends(text: bytes) -> np.ndarray:
    """End offsets of the lines of a text, at least one."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


_encodings: dict[int, tuple] = {}


def _encoding(ranks: dict[bytes, int], pattern: str) -> tuple:
    """The library's encoding and the byte lengths of its ids, once for each worker."""
    key = hash((pattern, frozenset(ranks.items())))
    if key not in _encodings:
        import tiktoken

        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            lengths[i] = len(piece)
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encodings[key]


def _counter(shared, pattern: str, rule: str, bounds_at: int, carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(shared.value, pattern)
        for whole in batches:
            for batch in row_groups(whole, 0, GROUP_BYTES):
                data, offsets = text_buffer(batch.column(0))
                given = batch.column(bounds_at).to_pylist() if bounds_at else None
                rows, counts, crossing, chars = [], [], [], []
                for d in range(batch.num_rows):
                    raw = data[offsets[d] : offsets[d + 1]]
                    text = raw.tobytes()
                    ids = encoding.encode_to_numpy(text.decode(), disallowed_special=())
                    char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    if given is None or given[d] is None:
                        ends = line_ends(text)
                    else:  # character offsets to byte offsets
                        own = np.unique(np.clip(np.array([*given[d], int(char[-1])], np.int64), 0, int(char[-1])))
                        ends = np.searchsorted(char, own[own > 0] if own[-1] else own, "left")
                    n, c = attribute(np.cumsum(lengths[ids]), ends, rule)
                    rows.append(len(ends))
                    counts.append(n)
                    crossing.append(c)
                    chars.append(np.diff(np.concatenate([[0], char[ends]])))
                size = np.array(rows, np.int64)
                names = [*(f"c{i}" for i in range(carried)), "n_tokens", "n_crossing", "n_chars"]
                columns = [list_array(pa.array(np.concatenate(v)), size) for v in (counts, crossing, chars)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(carried)), *columns], names=names)

    return run


def section_counts(docs: DataFrame, carry: list[str], text: str = "text", bounds: str | None = None, rule: str = RULE, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row for each section: ``carry``, section (from 0), n_tokens, n_crossing, n_chars.

    ``bounds`` may name an ascending array column of section ends in characters
    (null: lines).  ``n_crossing`` counts the tokens that cross one of the
    section's bounds.
    """
    if rule not in ("start", "majority", "split"):
        raise ValueError(f"unknown rule {rule!r}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    own = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], *([F.col(bounds).cast("array<bigint>").alias("b")] if bounds else []))
    kept = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    lists = map_batches(own, _counter(shared, pattern, rule, len(carry) + 1 if bounds else 0, len(carry)), f"{kept}n_tokens array<double>, n_crossing array<bigint>, n_chars array<bigint>")
    flat = lists.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.posexplode(F.arrays_zip("n_tokens", "n_crossing", "n_chars")).alias("section", "s"))
    return flat.select(*carry, "section", F.col("s.n_tokens").alias("n_tokens"), F.col("s.n_crossing").alias("n_crossing"), F.col("s.n_chars").alias("n_chars"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    counts = section_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))
