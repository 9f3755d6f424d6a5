"""Quality rules with repetition found through suffix arrays.

For every text a suffix array over its words and the lengths of the common prefixes of neighbouring suffixes are built
(prefix doubling in numpy, many texts at a time, ordered by text first so that they never meet). Cutting the
longest-common-prefix intervals at ``min_repeat`` words gives the maximal repeated substrings: each occurrence spans as
many words as it shares with a neighbour in the array. The spans are united; a text passes if the united spans cover at
most ``max_covered`` of its words and no repeat is longer than ``max_repeat`` words.

Work is one pass over the rows without a shuffle; memory is a fixed multiple of the longest text.

Cases: NULL and empty texts have no words and fail the base rule on length; repeated rows stay; equal texts get equal
results; a NULL doc_id stays NULL; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import BLANKS, chunks

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Shorter repeats do not count: a sentence or a notice that stands twice is no fault of a text.
MIN_REPEAT = 20
#: Share of words in repeats above which a text fails.
MAX_COVERED = 0.3
#: Words of one repeat above which a text fails.
MAX_REPEAT = 100


def common_prefixes(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word position, the most words that its suffix shares with another suffix of the same text.

    ``words`` holds word numbers, ``owner`` the ascending number of the text of each word. Prefix doubling: ``rank``
    orders suffixes by their first ``step`` words; only suffixes that still share their rank with another are sorted on.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n == 0:
        return best
    stop = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    room = np.repeat(stop + 1, np.diff(np.append(-1, stop))) - np.arange(n)  # words left in the own text
    span = int(words.max()) + 1
    # Rank by (text, first word): equal ranks are neighbours in the array.
    key = owner.astype(np.int64) * span + words
    order = np.argsort(key, kind="stable")
    levels = []
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
    heads = np.flatnonzero(fresh)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    levels.append(rank.copy())
    sizes = np.repeat(np.diff(np.append(heads, n)), np.diff(np.append(heads, n)))
    open_at = np.flatnonzero(sizes > 1)  # places in the array whose suffix is not alone yet
    step = 1
    while len(open_at):
        at = order[open_at]
        follow = at + step
        inside = room[at] > step
        second = np.where(inside, rank[np.minimum(follow, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[open_at] = at
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        heads = np.flatnonzero(np.append(True, ~same))
        lengths = np.diff(np.append(heads, len(at)))
        rank[at] = np.repeat(open_at[heads], lengths)
        levels.append(rank.copy())
        open_at = open_at[np.repeat(lengths, lengths) > 1]
        step *= 2
    # Common prefix of neighbours: walk down the levels, from the longest step to one word.
    left, right = order[:-1].copy(), order[1:].copy()
    pairs = np.flatnonzero(owner[left] == owner[right])
    left, right = left[pairs], right[pairs]
    shared = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        width = 1 << level
        live = np.flatnonzero((room[left] - shared >= 1) & (room[right] - shared >= 1))
        a, b = left[live] + shared[live], right[live] + shared[live]
        fits = (levels[level][a] == levels[level][b]) & (room[a] >= width) & (room[b] >= width)
        shared[live[fits]] += width
    np.maximum.at(best, left, shared)
    np.maximum.at(best, right, shared)
    return best


def union(reach: np.ndarray, owner: np.ndarray, shortest: int) -> np.ndarray:
    """Words that lie in a repeat of ``shortest`` words or more: the united spans as a mask."""
    n = len(reach)
    if n == 0:
        return np.zeros(0, bool)
    at = np.flatnonzero(reach >= shortest)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + reach[at], -1)
    return np.cumsum(change[:n]) > 0


@dataclass
class Repeats:
    """Per text of a batch."""

    n_words: np.ndarray
    in_windows: np.ndarray
    covered: np.ndarray
    longest: np.ndarray
    spans: list[list[tuple[int, int]]]


def repeats(texts: list[bytes], min_repeat: int = MIN_REPEAT, window: int = 3) -> Repeats:
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(counts.sum()))
    reach = common_prefixes(words, owner)
    in_windows = np.bincount(owner, union(reach, owner, window), len(texts)).astype(np.int64)
    mask = union(reach, owner, min_repeat)
    covered = np.bincount(owner, mask, len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, reach)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if mask.any():
        same_text = np.append(False, owner[1:] == owner[:-1])
        begins = np.flatnonzero(mask & ~(np.append(False, mask[:-1]) & same_text))
        ends = np.flatnonzero(mask & ~(np.append(mask[1:], False) & np.append(same_text[1:], False))) + 1
        base = np.append(0, np.cumsum(counts))
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            spans[owner[b]].append((b - int(base[owner[b]]), e - int(base[owner[b]])))
    return Repeats(counts, in_windows, covered, longest, spans)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    return again


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long,"
    " longest_repeat long, repeat_spans array<struct<start:int,stop:int>>"
)


def measured(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """doc_id and the measures of every text; ``repeat_spans`` are word ranges of at least ``min_repeat`` words."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            ids = batch.column("doc_id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                some = texts[lo:hi]
                found = repeats([t.encode() for t in some], min_repeat)
                columns = [
                    pa.array(found.n_words, pa.int64()),
                    pa.array([len(t) - sum(map(t.count, BLANKS)) for t in some], pa.int64()),
                    pa.array([sum(map(t.count, SYMBOLS)) for t in some], pa.int64()),
                    pa.array([duplicate_lines(t) for t in some], pa.int64()),
                    pa.array(found.in_windows, pa.int64()),
                    pa.array(found.covered, pa.int64()),
                    pa.array(found.longest, pa.int64()),
                    pa.array([[{"start": b, "stop": e} for b, e in s] for s in found.spans], spans_type),
                ]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *columns], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, " + FIELDS)


def passes(texts: list[str | None]) -> np.ndarray:
    """The verdict of ``judged`` for a batch of texts."""
    out = [np.zeros(0, bool)]
    for lo, hi in chunks([t or "" for t in texts]):
        found = repeats([(t or "").encode() for t in texts[lo:hi]])
        n = found.n_words
        base = (n >= MIN_WORDS) & (100 * found.in_windows <= 50 * n)
        out.append(base & (found.covered <= MAX_COVERED * n) & (found.longest <= MAX_REPEAT))
    return np.concatenate(out)


def judged(
    measures: DataFrame,
    min_words: int = MIN_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the measures."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeats_ok = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return measures.withColumn("base_failed", base).withColumn("kept", ~base & repeats_ok)
