"""Toxicity: a convolutional text classifier over hashed word embeddings, trained and run in numpy.

A word is the sum of the embeddings of its hash and of the hashes of its first 3, 4 and 5 bytes, so that inflected forms
share features. Filters of widths 1, 2 and 3 slide over the words of the whole text, each filter keeps its maximum, and
a logistic layer weighs the maxima.

Training has a start and a pass over everything. The start is Adam on the driver over about ``PER_CLASS`` documents of
each label (chosen by hash); if there are no more, it is all. Else every labelled document takes part: from the start's
parameters, each piece of about ``PIECE`` documents learns on its own in a task, and every parameter goes to the mean of
the pieces that changed it (sums of whole numbers, so that their order does not matter). One document in ``HOLD`` is set
apart for calibration and learned from in neither.

Thresholds are calibrated by language: each language has the logit that parts its set-apart documents best, and a score is
the logistic function of the distance to that logit, so 0.5 is the threshold everywhere. The language is guessed from
the text (naive Bayes over the same word hashes); the column ``lang`` of a document only teaches that guess and is no
input of a score. Beyond the start's documents, word counts of the languages come from all labelled documents that are
not set apart, and thresholds from all that are, by counts in steps of 1 / ``STEPS`` of a logit. Driver and broadcast hold
the model, which grows with the languages (at most ``BUCKETS`` counts each) and not with the rows. Scoring is one pass
over the rows without a shuffle.

Cases: NULL and empty texts score as a text without words (below 0.5); with no labelled document of either class every
score is 0; a NULL label or language is not learned from; repeated rows stay and equal texts get equal scores; a NULL
doc_id stays NULL and is never learned from; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import chunks, id_rest, uniform
from evenkeel.session import pinned

BUCKETS = 1 << 16
SIZE = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
PER_CLASS = 3_000
EPOCHS = 6
HOLD = 5
#: Documents that a task learns from before the parameters are averaged, in steps of so many, at this rate.
PIECE = 8_192
BATCH = 64
PIECE_RATE = 0.002
#: Steps of a logit in calibration over all documents, and of a parameter's change in sums.
STEPS = 256
_UNIT = float(1 << 32)
#: Up to so many languages word counts are one full matrix; with more only counts other than 0 are kept.
FULL_LANGS = 64
_SPREAD = 48  # bytes of a word that count towards its hash by position; later ones share the last position


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Random 64-bit values for (place in word, byte), and which bytes belong to words."""
    values = np.random.default_rng(12).integers(0, 1 << 63, size=(_SPREAD, 256), dtype=np.uint64)
    inside = np.zeros(256, bool)
    inside[128:] = True
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        inside[c] = True
    return values.ravel(), inside


_VALUES, _INSIDE = _tables()


def _bucket(values: np.ndarray) -> np.ndarray:
    mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x features) of all texts, and the number of words of each text."""
    parts = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _INSIDE[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.append(0, np.searchsorted(starts, bounds)))
    lengths = stops - starts
    if not len(starts):
        return np.zeros((0, len(PREFIXES) + 1), np.int32), counts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    each = _VALUES[np.minimum(place, _SPREAD - 1) * 256 + data[at]]
    whole = np.add.reduceat(each, np.cumsum(lengths) - lengths)
    out = np.empty((len(starts), len(PREFIXES) + 1), np.int32)
    out[:, 0] = _bucket(whole)
    sofar = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        has = lengths > k
        sofar = sofar + np.where(has, _VALUES[256 * k :][data[np.minimum(starts + k, len(data) - 1)]], np.uint64(0))
        if k + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(k + 1)] = _bucket(sofar + np.uint64(7919 * (k + 1)))
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ToxicityModel:
    """Without ``embed`` the model knows nothing and scores 0."""

    embed: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)  # per width: (width * SIZE) x FILTERS
    shifts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    langs: list[str] = field(default_factory=list)
    lang_log: np.ndarray | None = None  # buckets x languages
    # with many languages instead: of a bucket those that have it, from where to where, with what gain over the base
    lang_base: np.ndarray | None = None
    lang_cuts: np.ndarray | None = None
    lang_of: np.ndarray | None = None
    lang_gain: np.ndarray | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0

    def pooled(self, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of the filters per text, the word where each lies (-1: none), and the word vectors."""
        words = self.embed[cells].sum(axis=1)
        full = np.flatnonzero(counts)
        begins = (np.cumsum(counts) - counts)[full]
        owner = np.repeat(np.arange(len(counts)), counts)
        maxima = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
        where = np.full(maxima.shape, -1, np.int64)
        for k, width in enumerate(WIDTHS):
            responses = np.full((len(words), FILTERS), self.shifts[k], np.float32)
            for j in range(min(width, len(words))):
                part = words[j:] @ self.filters[k][j * SIZE : (j + 1) * SIZE]
                # a window ends with its text: words beyond it count as zero vectors
                same = (owner[j:] == owner[: len(owner) - j])[:, None]
                responses[: len(words) - j] += part * same
            if len(full):
                top = np.maximum.reduceat(responses, begins, axis=0)
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                maxima[full, columns] = np.maximum(top, 0)
                spread = np.repeat(top, counts[full], axis=0)
                row, column = np.nonzero((responses == spread) & (spread > 0))
                where[owner[row][::-1], column[::-1] + k * FILTERS] = row[::-1]
        return maxima, where, words

    def logits(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        words = self.embed[cells].sum(axis=1)
        full = np.flatnonzero(counts)
        begins = (np.cumsum(counts) - counts)[full]
        out = np.full(len(counts), self.bias, np.float64)
        stops = np.cumsum(counts)
        for k, width in enumerate(WIDTHS):
            responses = words @ self.filters[k][:SIZE] + self.shifts[k]
            for j in range(1, width):
                part = words @ self.filters[k][j * SIZE : (j + 1) * SIZE]
                for first in range(j):  # the first words of a text belong to no window that starts j words before
                    at = begins + first
                    part[at[at < stops[full]]] = 0
                responses[:-j or None] += part[j:]
            if len(full):
                top = np.maximum(np.maximum.reduceat(responses, begins, axis=0), 0)
                out[full] += top @ self.weights[k * FILTERS : (k + 1) * FILTERS]
        return out

    def guessed(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of each text, from its words; -1 without words or languages."""
        out = np.full(len(counts), -1)
        full = np.flatnonzero(counts)
        if self.langs and len(full):
            begins = (np.cumsum(counts) - counts)[full]
            if self.lang_log is None:
                most = max(1, (1 << 21) // len(self.langs))
                for lo in range(0, len(full), most):
                    some = full[lo : lo + most]
                    own = cells[begins[lo] : begins[lo] + counts[some].sum(), :2]
                    out[some] = self._sparse_sums(own, counts[some]).argmax(axis=1)
                return out
            sums = np.add.reduceat(self.lang_log[cells[:, 0]] + self.lang_log[cells[:, 1]], begins, axis=0)
            out[full] = sums.argmax(axis=1)
        return out

    def _sparse_sums(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = len(self.langs)
        sums = (2 * counts[:, None] * self.lang_base).ravel()
        buckets, owner = cells.ravel(), np.repeat(np.arange(len(counts)), 2 * counts)
        begin = self.lang_cuts[buckets]
        sizes = self.lang_cuts[buckets + 1] - begin
        ends = np.cumsum(sizes)
        steps = np.searchsorted(ends, np.arange(1 << 21, ends[-1], 1 << 21), "right")
        for lo, hi in zip([0, *steps], [*steps, len(buckets)], strict=True):
            own = sizes[lo:hi]
            at = np.repeat(begin[lo:hi] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            sums += np.bincount(np.repeat(owner[lo:hi], own) * n + self.lang_of[at], self.lang_gain[at], len(sums))
        return sums.reshape(-1, n)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores from 0 to 1; 0.5 is the threshold."""
        if self.embed is None:
            return np.zeros(len(texts))
        parts = [np.zeros(0)]
        for lo, hi in chunks([t or "" for t in texts], 1 << 19):
            cells, counts = features(texts[lo:hi])
            cut = np.array([self.thresholds.get(lang, self.threshold) for lang in [*self.langs, ""]])
            parts.append(_sigmoid(self.logits(cells, counts) - cut[self.guessed(cells, counts)]))
        return np.concatenate(parts)


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float | None:
    """The logit with the fewest errors, in the middle of its gap; None without both classes."""
    if labels.all() or not labels.any():
        return None
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    # errors when all from place i on are called toxic
    errors = np.append(0, np.cumsum(y)) + np.append(np.cumsum((~y)[::-1])[::-1], 0)
    errors = errors[1:-1].astype(float)
    errors[x[1:] == x[:-1]] = np.inf
    best = np.flatnonzero(errors == errors.min())
    if not np.isfinite(errors.min()):
        return None
    gaps = x[best + 1] - x[best]
    at = best[gaps.argmax()]
    return float((x[at] + x[at + 1]) / 2)


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.step = rate, 0
        self.state: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def move(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**self.step)) / (np.sqrt(v[at] / (1 - 0.99**self.step)) + 1e-6)


def _step(model: ToxicityModel, adam: _Adam, batch: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One step down for a few texts; gives the rows of the embedding that it changed."""
    adam.step += 1
    maxima, where, words = model.pooled(batch, n)
    pull = (_sigmoid(maxima @ model.weights + model.bias) - y) * weight / len(n)
    back = pull[:, None] * model.weights[None, :]
    word_grad = np.zeros_like(words)
    owner_end = np.cumsum(n)
    grads = []
    for k, width in enumerate(WIDTHS):
        grad, shift = np.zeros_like(model.filters[k]), np.zeros_like(model.shifts[k])
        doc, column = np.nonzero(where[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
        at = where[doc, column + k * FILTERS]
        g = back[doc, column + k * FILTERS].astype(np.float32)
        np.add.at(shift, column, g)
        for j in range(width):
            ok = at + j < owner_end[doc]
            w, c, gj = at[ok] + j, column[ok], g[ok]
            block = slice(j * SIZE, (j + 1) * SIZE)
            np.add.at(grad[block].T, c, gj[:, None] * words[w])
            np.add.at(word_grad, w, gj[:, None] * model.filters[k][block][:, c].T)
        grads.append((grad, shift))
    touched = np.flatnonzero(np.abs(word_grad).sum(axis=1))
    rows, inverse = np.unique(batch[touched].ravel(), return_inverse=True)
    embed_grad = np.zeros((len(rows), SIZE), np.float32)
    np.add.at(embed_grad, inverse, np.repeat(word_grad[touched], batch.shape[1], axis=0))
    adam.move("weights", model.weights, (maxima * pull[:, None]).sum(axis=0).astype(np.float32))
    model.bias -= adam.rate * float(pull.sum())
    for k, (grad, shift) in enumerate(grads):
        adam.move(f"filter{k}", model.filters[k], grad)
        adam.move(f"shift{k}", model.shifts[k], shift)
    if len(rows):
        adam.move("embed", model.embed, embed_grad, rows)
    return rows


def trained(
    texts: list[str], labels: list[int], langs: list[str | None], seed: int = 5, epochs: int = EPOCHS,
    held: np.ndarray | None = None,
) -> ToxicityModel:
    """Fit on rows that are in memory; the same rows in the same order give the same model."""
    y = np.array(labels, bool)
    model = ToxicityModel()
    if not y.any() or y.all():
        return model
    rng = np.random.default_rng(seed)
    docs: list[np.ndarray] = []
    for lo, hi in chunks([t or "" for t in texts], 1 << 17):
        cells, number = features(texts[lo:hi])
        docs += np.split(cells, np.cumsum(number)[:-1])
    counts = np.array([len(d) for d in docs], np.int64)
    held = np.arange(len(y)) % HOLD == 0 if held is None else held.copy()
    if not (y[~held].any() and y[held].any()) or y[~held].all() or y[held].all():
        held[:] = False
    model.embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    model.filters = [rng.normal(0, 0.3, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    model.shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    model.weights = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    model.bias = -1.0
    learn = np.flatnonzero(~held)
    weight = np.where(y, 0.5 / max(y[learn].mean(), 1e-6), 0.5 / max(1 - y[learn].mean(), 1e-6))
    adam, size = _Adam(0.01), BATCH if len(learn) > 1000 else 8
    epochs = max(epochs, min(40, -(-6000 // max(len(learn), 1))))
    for _ in range(epochs):
        order = rng.permutation(learn)
        for lo in range(0, len(order), size):
            some = order[lo : lo + size]
            _step(model, adam, np.concatenate([docs[i] for i in some]), counts[some], y[some], weight[some])
    _learn_langs(model, docs, langs)
    _calibrate(model, docs, counts, y, held if held.any() else np.ones(len(y), bool))
    return model


def _learn_langs(model: ToxicityModel, docs: list[np.ndarray], langs: list[str | None]) -> None:
    names = sorted({x for x in langs if x is not None})
    own: dict[str, list[np.ndarray]] = {x: [] for x in names}
    for cells, lang in zip(docs, langs, strict=True):
        if lang is not None:
            own[lang].append(cells[:, :2].ravel())
    times = [sum(np.bincount(x, minlength=BUCKETS) for x in own[lang]) for lang in names]
    found = [np.flatnonzero(t) for t in times]
    _set_langs(model, names, found, [t[f] for t, f in zip(times, found, strict=True)])


def _set_langs(model: ToxicityModel, langs: list[str], buckets: list[np.ndarray], times: list[np.ndarray]) -> None:
    """Of each language the buckets that its words fall in, and how often."""
    model.langs = langs
    model.lang_log = model.lang_base = model.lang_cuts = model.lang_of = model.lang_gain = None
    if not langs:
        return
    if len(langs) <= FULL_LANGS:
        table = np.full((BUCKETS, len(langs)), 0.5)
        for k, (found, n) in enumerate(zip(buckets, times, strict=True)):
            table[found, k] += n
        model.lang_log = np.log(table / table.sum(axis=0)).astype(np.float32)
        return
    gains = [np.log1p(2 * n) for n in times]  # (0.5 + times) / 0.5
    totals = np.array([0.5 * BUCKETS + n.sum() for n in times])
    every = np.concatenate(buckets)
    order = np.argsort(every, kind="stable")
    model.lang_base = np.log(0.5 / totals)
    model.lang_cuts = np.searchsorted(every[order], np.arange(BUCKETS + 1))
    model.lang_of = np.repeat(np.arange(len(langs), dtype=np.int32), [len(x) for x in buckets])[order]
    model.lang_gain = np.concatenate(gains)[order].astype(np.float32)


def _calibrate(model: ToxicityModel, docs: list[np.ndarray], counts: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
    at = np.flatnonzero(held)
    logits, guess = np.zeros(len(at)), np.zeros(len(at), np.int64)
    for lo in range(0, len(at), 64):
        some = at[lo : lo + 64]
        cells = np.concatenate([docs[i] for i in some])
        logits[lo : lo + 64] = model.logits(cells, counts[some])
        guess[lo : lo + 64] = model.guessed(cells, counts[some])
    _set_thresholds(model, _best_cut(logits, y[at]), {
        lang: (_best_cut(logits[guess == k], y[at][guess == k]), min(y[at][guess == k].sum(), (~y[at][guess == k]).sum()))
        for k, lang in enumerate(model.langs)
    })


def _set_thresholds(model: ToxicityModel, cut: float | None, by_lang: dict[str, tuple[float | None, int]]) -> None:
    """From the best cut of all, and by language its best cut and the documents of its smaller class."""
    model.threshold = cut if cut is not None else 0.0
    model.threshold = max(model.threshold, model.bias + 1e-3)  # a text without words stays below 0.5
    model.thresholds = {}
    for lang in model.langs:
        own, fewer = by_lang.get(lang, (None, 0))
        # few documents of a language: lean on the threshold of all
        share = min(1.0, fewer / 20) if own is not None else 0.0
        model.thresholds[lang] = max(share * (own or 0.0) + (1 - share) * model.threshold, model.bias + 1e-3)


def _marked(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and a hash in [0, 1) of all documents to learn from."""
    return (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(id_rest("doc_id", 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("mark", uniform("doc_id", F.lit("toxic")))
    )


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """text, lang, toxic, mark, doc_id: one row for each doc_id."""
    found = docs.select("doc_id", "text", "lang").join(chosen, "doc_id").groupBy("doc_id", "mark").agg(
        F.max(F.struct("text", "lang", "toxic")).alias("row")
    )
    return found.select("row.text", "row.lang", "row.toxic", "mark", "doc_id")


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """About ``per_class`` labelled documents of each class with id rest other than 0: text, lang, toxic, mark, doc_id.

    Those are taken whose hash lies below the share that ``per_class`` makes of the class; all if there are fewer.
    """
    own = _marked(labels)
    sizes = F.broadcast(own.groupBy("toxic").agg(F.count("*").alias("n")))  # two rows
    chosen = own.join(sizes, "toxic").where(F.col("mark") < per_class / F.col("n")).drop("n")
    # about 2 * per_class ids: a bounded broadcast
    return _texts(docs, F.broadcast(chosen))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> ToxicityModel:
    own = _marked(labels)
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    more = max(sizes.values(), default=0) > per_class
    rows = sorted(sample(docs, labels, per_class).collect(), key=lambda r: (r["mark"], r["doc_id"]))
    apart = np.array([int(r["mark"] * (1 << 30)) % HOLD == 0 for r in rows], bool) if more else None
    model = trained([r["text"] for r in rows], [r["toxic"] for r in rows], [r["lang"] for r in rows], epochs=epochs, held=apart)
    return model if not more or model.embed is None else refined(model, docs, own, sizes)


def _apart() -> Column:
    """Whether a document is set apart for calibration; as in ``fit``."""
    return F.floor(F.col("mark") * (1 << 30)) % HOLD == 0


_CHANGES = [f"d{j}" for j in range(SIZE)]


def _small(model: ToxicityModel) -> np.ndarray:
    """All parameters but the embedding, in rows of ``SIZE``."""
    flat = np.concatenate([*[f.ravel() for f in model.filters], *model.shifts, model.weights, [model.bias]]).astype(np.float64)
    return np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE)


def _moved(model: ToxicityModel, rows: np.ndarray, by: np.ndarray) -> None:
    """Add changes to the parameters: rows of the embedding, then those of ``_small``."""
    words = rows < BUCKETS
    model.embed[rows[words]] += by[words].astype(np.float32)
    flat = _small(model)
    flat[rows[~words] - BUCKETS] += by[~words]
    flat = flat.ravel()
    at = 0
    for part in [*model.filters, *model.shifts, model.weights]:
        part[:] = flat[at : at + part.size].reshape(part.shape)
        at += part.size
    model.bias = float(flat[at])


def _copied(model: ToxicityModel) -> ToxicityModel:
    out = ToxicityModel(model.embed.copy(), [f.copy() for f in model.filters], [x.copy() for x in model.shifts], model.weights.copy(), model.bias)
    out.langs = list(model.langs)
    return out


def refined(start: ToxicityModel, docs: DataFrame, own: DataFrame, sizes: dict[int, int]) -> ToxicityModel:
    """Learn from all documents of ``own`` (as ``_marked``), from a started model on: parameters, languages, thresholds."""
    known = pinned(_texts(docs, own))
    model = _copied(start)
    total = sum(sizes.values())
    balance = {toxic: 0.5 * total / n for toxic, n in sizes.items()}
    shared = docs.sparkSession.sparkContext.broadcast(start)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = shared.value
        piece, adam = _copied(begin), _Adam(PIECE_RATE)
        changed = np.zeros(BUCKETS, bool)
        names: dict[str, int] = {}
        keys, times, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def counted() -> tuple[np.ndarray, np.ndarray]:
            every, place = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            weights = np.concatenate([times, np.ones(len(place) - len(times), np.int64)])
            return every, np.bincount(place, weights, len(every)).astype(np.int64)

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            toxic = batch.column("toxic").to_numpy()
            weight = np.array([balance[t] for t in toxic.tolist()])
            for lo, hi in chunks([t or "" for t in texts], 1 << 17):
                for some in (slice(at, min(at + BATCH, hi)) for at in range(lo, hi, BATCH)):
                    cells, number = features(texts[some])
                    changed[_step(piece, adam, cells, number, toxic[some] == 1, weight[some])] = True
                    codes = np.array([-1 if x is None else names.setdefault(x, len(names)) for x in langs[some]], np.int64)
                    code = np.repeat(codes, number)
                    waiting.append((code[:, None] * BUCKETS + cells[:, :2])[code >= 0].ravel())
                    if sum(map(len, waiting)) > 1 << 20:
                        (keys, times), waiting = counted(), []
        if not adam.step:
            return
        keys, times = counted()
        rows = np.flatnonzero(changed)
        by = np.concatenate([piece.embed[rows].astype(np.float64) - begin.embed[rows], _small(piece) - _small(begin)])
        by = np.rint(by * _UNIT).astype(np.int64)
        rows = np.concatenate([rows, BUCKETS + np.arange(len(by) - len(rows))]).astype(np.int32)
        once = pa.array(np.ones(len(rows), np.int64))
        schema = pa.schema([("lang", pa.string()), ("row", pa.int32()), ("n", pa.int64()), *[(c, pa.int64()) for c in _CHANGES]])
        none = pa.nulls(len(rows), pa.string())
        yield pa.RecordBatch.from_arrays([none, pa.array(rows), once, *[pa.array(by[:, j].copy()) for j in range(SIZE)]], schema=schema)
        labels = np.array([*names, ""], object)
        for lo in range(0, len(keys), 1 << 16):
            key = keys[lo : lo + (1 << 16)]
            found = [pa.array(labels[key // BUCKETS].tolist(), pa.string()), pa.array((key % BUCKETS).astype(np.int32)), pa.array(times[lo : lo + len(key)])]
            yield pa.RecordBatch.from_arrays([*found, *[pa.nulls(len(key), pa.int64())] * SIZE], schema=schema)

    pieces = max(1, round(total * (HOLD - 1) / HOLD / PIECE))
    learn = known.where(~_apart()).repartition(pieces, "doc_id").sortWithinPartitions("mark", "doc_id")
    changes = learn.select("text", "lang", "toxic").mapInArrow(learned, f"lang string, row int, n long, {', '.join(f'{c} long' for c in _CHANGES)}")
    summed = pinned(changes.groupBy("lang", "row").agg(*[F.sum(c).alias(c) for c in ("n", *_CHANGES)]))
    moves = summed.where("lang is null").drop("lang").toArrow()
    if moves.num_rows:
        n = moves["n"].to_numpy()
        by = np.stack([moves[c].to_numpy() for c in _CHANGES], axis=1) / _UNIT / n[:, None]
        _moved(model, moves["row"].to_numpy(), by)
    words = summed.where("lang is not null").select("lang", "row", "n").orderBy("lang", "row").toArrow()
    names, codes = np.unique(np.array(words["lang"].to_pylist(), object).astype(str), return_inverse=True)
    edges = np.searchsorted(codes, np.arange(len(names) + 1))
    row, n = words["row"].to_numpy(), words["n"].to_numpy()
    spans = [slice(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    _set_langs(model, names.tolist(), [row[x] for x in spans], [n[x] for x in spans])
    _calibrate_all(model, known.where(_apart()))
    return model


def _calibrate_all(model: ToxicityModel, held: DataFrame) -> None:
    shared = held.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        labels = np.array([*own.langs, None], object)
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_numpy()
            for lo, hi in chunks([t or "" for t in texts], 1 << 19):
                cells, counts = features(texts[lo:hi])
                step = np.floor(own.logits(cells, counts) * STEPS).astype(np.int64)
                guess = labels[own.guessed(cells, counts)]
                known = np.array([x is not None for x in guess], bool)
                lang = [None] * len(step) + guess[known].tolist()
                columns = [np.concatenate([x, x[known]]) for x in (step, toxic[lo:hi].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), *map(pa.array, columns)], ["lang", "step", "toxic"])

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        cut = _best_step(rows["step"].to_numpy(), rows["bad"].to_numpy(), rows["good"].to_numpy())
        fewer = min(rows["bad"].sum(), rows["good"].sum())
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "cut": [cut], "fewer": [int(fewer)]})

    steps = held.select("text", "toxic").mapInArrow(binned, "lang string, step long, toxic long")
    sums = steps.groupBy("lang", "step").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # A group holds the steps of one language: as many as logits are apart, not as there are documents.
    cuts = sums.groupBy("lang").applyInPandas(best, "lang string, cut double, fewer long").collect()
    found = {r["lang"]: (None if r["cut"] is None or np.isnan(r["cut"]) else r["cut"], r["fewer"]) for r in cuts}
    _set_thresholds(model, found.pop(None, (None, 0))[0], found)


def _best_step(steps: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float | None:
    """As ``_best_cut``, of rising steps of a logit with how many documents of both classes each holds."""
    if not bad.any() or not good.any() or len(steps) < 2:
        return None
    errors = np.cumsum(bad)[:-1] + np.cumsum(good[::-1])[::-1][1:]
    best = np.flatnonzero(errors == errors.min())
    at = best[(steps[best + 1] - steps[best]).argmax()]
    return float((steps[at] + 1 + steps[at + 1]) / 2 / STEPS)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, score double")
