"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training takes about ``per_lang`` documents of each language: those whose hash of id and text lies below the share that
``per_lang`` makes of the language's documents, or all if there are fewer. It counts n-grams of one to four code points
in hashed buckets inside Spark tasks, sums the counts by language and bucket, and brings the matrix (languages x
buckets) to the driver. ``SAMPLE`` documents in all bound it, whatever the data: with more languages each gives fewer, but
at least one. The log-probability matrix is broadcast, and a batch of texts is scored as a product of its sparse (text x
bucket) counts with the matrix. Up to ``FULL_LANGS`` languages the matrix is held in full; of more only cells that were
seen are held, beside one value a language for those that were not, which gives the same scores.

Cases: a NULL text and one without any letter get ``und`` and score 0; rows without a language are not learned from;
with nothing to learn from every text gets ``und``; equal texts get equal results; repeated rows stay; of two languages
with equal probability the one that sorts first wins; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import chunks, uniform

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
PER_LANG = 3_000
SAMPLE = 256 * PER_LANG
FULL_LANGS = 256
BROADCAST_LANGS = 100_000
UNDECIDED = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each closed by a 0, and the index of the text of each point."""
    joined = "".join(t.lower().replace("\0", " ") + "\0" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = points == 0
    owner = np.cumsum(ends) - ends
    return points, owner.astype(np.int32)


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of each n-gram; an n-gram never spans two texts, runs of other signs count as one blank."""
    points, owner = _points(texts)
    # Letters carry the language: digits and signs become blanks, and blanks next to blanks go.
    solid = (points >= 128) | ((points >= 97) & (points <= 122)) | (points == 0)
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    values = np.where(solid, points, np.uint32(32))[keep].astype(np.uint64)
    owner = owner[keep]
    end = values == 0
    rows, cells = [], []
    mixed = np.zeros(len(values), dtype=np.uint64)
    fits = np.ones(len(values), dtype=bool)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for n in ORDERS:
        # The hash of n points grows from the hash of n-1 points by the next one.
        tail = values[n - 1 :]
        mixed = (mixed[: len(tail)] * np.uint64(1_000_003)) ^ (tail + np.uint64(n))
        fits = fits[: len(tail)] & ~end[n - 1 :]
        at = np.flatnonzero(fits)
        rows.append(owner[at])
        cells.append(((mixed[at] * _ODD) >> shift).astype(np.int32))
    return np.concatenate(rows), np.concatenate(cells)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    #: buckets x languages
    log_prob: np.ndarray
    log_prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Joint log probability, texts x languages."""
        out = np.tile(self.log_prior, (len(texts), 1))
        buckets = len(self.log_prob)
        for lo, hi in chunks(texts):
            rows, cells = grams(texts[lo:hi], buckets)
            for lang in range(len(self.langs)):
                out[lo:hi, lang] += np.bincount(rows, self.log_prob[:, lang][cells], hi - lo)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior probability."""
        known = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        langs, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
        if known:
            joint = self.scores([texts[i] for i in known])
            best = joint.argmax(axis=1)
            top = joint[np.arange(len(known)), best]
            scores[known] = 1.0 / np.exp(joint - top[:, None]).sum(axis=1)
            for i, b in zip(known, best, strict=True):
                langs[i] = self.langs[b]
        return langs, scores


@dataclass
class SparseModel(LanguageModel):
    """The same model by seen cells: of each bucket the languages, and how far they lie above an unseen cell.

    ``log_prob`` has one row, the value of an unseen cell for each language.
    """

    starts: np.ndarray
    lang_of: np.ndarray
    above: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.log_prior, (len(texts), 1))
        wide = len(self.langs)
        for lo, hi in chunks(texts):
            rows, cells = grams(texts[lo:hi], len(self.starts) - 1)
            out[lo:hi] += np.bincount(rows, minlength=hi - lo)[:, None] * self.log_prob
            # Equal n-grams of a text count together; those of a piece at a time meet their languages.
            pairs, counts = np.unique(rows.astype(np.int64) * (len(self.starts) - 1) + cells, return_counts=True)
            text, cell = np.divmod(pairs, len(self.starts) - 1)
            sizes = self.starts[cell + 1] - self.starts[cell]
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(pairs):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), side="right")))
                some = slice(begin, end)
                n = sizes[some]
                at = np.repeat(self.starts[cell[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                place = np.repeat(text[some], n) * wide + self.lang_of[at]
                weights = self.above[at] * np.repeat(counts[some], n)
                out[lo:hi] += np.bincount(place, weights, (hi - lo) * wide).reshape(hi - lo, wide)
                begin = end
        return out


def smoothed(langs: list[str], cells: pd.DataFrame, buckets: int, add: float = 0.2, full: int = FULL_LANGS) -> LanguageModel:
    """A model from n-gram counts by language and bucket."""
    if not langs:
        return LanguageModel([], np.zeros((0, 0), np.float64), np.zeros(0))
    # A flat prior over the languages: the sample is drawn per language and says nothing about shares.
    prior = np.zeros(len(langs))
    number = {lang: k for k, lang in enumerate(langs)}
    lang, bucket, n = cells["lang"].map(number).to_numpy(np.int64), cells["bucket"].to_numpy(), cells["n"].to_numpy(np.float64)
    totals = np.bincount(lang, n, len(langs)) + add * buckets
    if len(langs) <= full:
        raised = np.full((buckets, len(langs)), add)
        raised[bucket, lang] += n
        return LanguageModel(langs, np.log(raised / totals), prior)
    order = np.argsort(bucket, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    above = np.log((n + add) / add)[order]
    return SparseModel(langs, np.log(add / totals)[None, :], prior, starts, lang[order], above)


def fit(docs: DataFrame, per_lang: int = PER_LANG, buckets: int = BUCKETS, sample: int = SAMPLE, full: int = FULL_LANGS) -> LanguageModel:
    """Learn from the columns ``text`` and ``lang`` of ``docs``; ``doc_id`` only picks the sample."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", uniform("doc_id", "text").alias("u"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least"))
    langs = sizes.count()
    each = max(1, min(per_lang, sample // max(1, langs)))
    # At least the document of the smallest hash, so no language is left out.
    drawn = (F.col("u") < each / F.col("n")) | (F.col("u") == F.col("least"))
    # A table of that many short rows is broadcast; more languages than that go through a shuffle.
    drawn_docs = known.join(F.broadcast(sizes) if langs <= BROADCAST_LANGS else sizes, "lang").where(drawn).select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pd.DataFrame]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                # A language without a single n-gram is still known.
                yield pd.DataFrame({"lang": lang, "bucket": at if len(at) else [0], "n": total[at] if len(at) else [0]})
            sums.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total = sums.setdefault(lang, np.zeros(buckets, np.int64))
                texts = list(texts)
                for lo, hi in chunks(texts):
                    total += np.bincount(grams(texts[lo:hi], buckets)[1], minlength=buckets)
                if len(sums) >= 64:  # so many languages at once are enough
                    yield from told()
        yield from told()

    cells = drawn_docs.mapInPandas(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = cells.toPandas()
    return smoothed(sorted(got["lang"].unique()), got, buckets, full=full)


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs, scores = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, lang_pred string, score double")
