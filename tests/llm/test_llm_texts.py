"""Operators that work text by text: quality rules, language, toxicity."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from evenkeel.llm import language, repetition, toxicity
from evenkeel.llm.common import id_rest, kept_rows, table

EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "only words"), (4, "x " * 30_000), (4, "x " * 30_000), (5, "1 2 3 !?")]
SCHEMA = "doc_id long, text string"


def _edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    return df.selectExpr("*", "'en' as lang", "1 as n_words", "2 as score", "3 as kept", "4 as mark", "5 as bucket")


def _reach(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def _inside(reach, least):
    return {x for i, r in enumerate(reach) if r >= least for x in range(i, i + r)}


def test_repeats_against_brute_force():
    r = random.Random(4)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 6)):
            base = [r.choice("abcdefg") for _ in range(r.randint(0, 25))]
            texts.append(" ".join(base * r.choice([1, 1, 2, 3])).encode())
        got = repetition.repeats(texts, 5)
        for i, text in enumerate(texts):
            reach = _reach(text.split())
            assert got.n_words[i] == len(reach)
            assert got.in_windows[i] == len(_inside(reach, 3))
            assert got.longest[i] == max(reach, default=0)
            assert {x for b, e in got.spans[i] for x in range(b, e)} == _inside(reach, 5)


def test_quality_edges(spark):
    df = _edges(spark)
    got = repetition.judged(repetition.measured(df)).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["n_words"] for k in (1, 2, 3, None, 4, 5)] == [0, 0, 0, 2, 30_000, 4]
    assert by[4]["longest_repeat"] == 29_999 and by[4]["covered_words"] == 30_000 and by[4]["n_repeat_words"] == 30_000
    assert all(r["base_failed"] and not r["kept"] for r in got)
    assert repetition.judged(repetition.measured(df.limit(0))).count() == 0
    assert kept_rows(df, repetition.passes).count() == 0
    assert kept_rows(df, repetition.passes).columns == df.columns


def test_verdict_of_batches_equals_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    judged = repetition.judged(repetition.measured(docs)).where("kept").select("doc_id").collect()
    passed = kept_rows(docs, repetition.passes).select("doc_id").collect()
    assert sorted(r[0] for r in judged) == sorted(r[0] for r in passed)
    assert 0 < len(passed) < docs.count()


@pytest.mark.parametrize("words", [10, 15, 19, 20, 25, 30])
@pytest.mark.parametrize("share", [0.28, 0.32, 0.45])
def test_short_repeats_on_both_sides_of_the_limit(words, share):
    said = [" ".join(f"r{i}x{j}" for j in range(words)) for i in range(4)]
    alone = round(8 * words / share) - 8 * words
    between = [" ".join(f"u{k}x{j}" for j in range(k, alone, 8)) for k in range(8)]
    text = " ".join(f"{a} {b}" for a, b in zip(said + said, between, strict=True))
    assert (repetition.repeats([text.encode()], 10).covered[0] > 0.3 * len(text.split())) == (share > 0.3)
    # from 20 words on the limit of 30 % decides, below the base rule alone
    assert repetition.passes([text]).tolist() == [words < 20 or share < 0.3]


def test_long_repeats_fail(spark):
    plain = " ".join(f"w{i}" for i in range(400))
    part = " ".join(f"p{i}" for i in range(110))
    texts = [plain, f"{plain} {part} . {part}", f"{plain} " + "again and again we say these ten words here now " * 2]
    assert repetition.passes(texts).tolist() == [True, False, True]


def test_language_counts_and_edges(spark):
    rows, cells = language.grams(["ab", "", "a1!b"])
    assert np.bincount(rows, minlength=3).tolist() == [3, 0, 6]  # a b ab; then a _ b, a_ _b, a_b
    docs = spark.createDataFrame(
        [(i, "the cat and the dog " * 5, "en") for i in range(20)]
        + [(100 + i, "le chat et le chien étaient là " * 5, "fr") for i in range(20)]
        + [(200, "nothing", None), (201, None, "xx")],
        "doc_id long, text string, lang string",
    )
    model = language.fit(docs, per_lang=5)
    assert model.langs == ["en", "fr"]
    got = {r["doc_id"]: r for r in language.predicted(_edges(spark), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 5)] == ["und"] * 4 and got[1]["score"] == 0
    assert got[None]["lang_pred"] in ("en", "fr") and 0.5 <= got[None]["score"] <= 1
    assert language.predicted(_edges(spark), model).count() == len(EDGES)
    assert model.predict(["the dog", "étaient"])[0] == ["en", "fr"]
    empty = language.fit(docs.limit(0))
    assert empty.predict(["the dog"])[0] == ["und"]


def test_language_scores_equal_naive_bayes():
    counts = np.random.default_rng(1).integers(0, 9, (2, 64))
    cells = pd.DataFrame({"lang": np.repeat(["a", "b"], 64), "bucket": np.tile(np.arange(64), 2), "n": counts.ravel()})
    texts = ["Some words here", "", "aaa aaa aaa bb", "été 🙂"]
    for full in (256, 1):
        model = language.smoothed(["a", "b"], cells[cells["n"] > 0], 64, full=full)
        assert isinstance(model, language.SparseModel) == (full == 1)
        for text, got in zip(texts, model.scores(texts), strict=True):
            _, places = language.grams([text], 64)
            share = np.log((counts + 0.2) / (counts + 0.2).sum(1, keepdims=True))
            assert np.allclose(got, [share[k][places].sum() for k in (0, 1)])


def test_very_many_languages(spark):
    r = random.Random(3)
    words = {f"l{i:03}": ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(12)] for i in range(300)}
    rows = [(n, " ".join(r.choices(words[lang], k=40)), lang) for n, lang in enumerate([*words] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id < 900"))
    assert len(model.langs) == 300 and isinstance(model, language.SparseModel)
    full = language.fit(docs.where("doc_id < 900"), full=1000)
    texts = [t for _, t, _ in rows[900:]]
    assert model.predict(texts)[0] == full.predict(texts)[0] == [lang for _, _, lang in rows[900:]]
    assert np.allclose(model.scores(texts), full.scores(texts))
    # A sample smaller than the languages still knows every one.
    assert len(language.fit(docs, sample=100).langs) == 300


def test_language_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(id_rest("doc_id", 3) != 1))
    held = docs.where(id_rest("doc_id", 3) == 1).where("lang is not null and length(text) > 40")
    pairs = language.predicted(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in pairs) >= 0.95 * len(pairs)


def test_toxicity_windows_and_maxima():
    texts = ["idiot you are", "", "one", "two words"]
    cells, counts = toxicity.features(texts)
    assert counts.tolist() == [3, 0, 1, 2]
    model = toxicity.trained(["bad word"] * 5 + ["good word"] * 5, [1] * 5 + [0] * 5, ["en"] * 10)
    pooled = model.pooled(cells, counts)[0] @ model.weights + model.bias
    assert np.allclose(pooled, model.logits(cells, counts), atol=1e-4)
    # by hand, the filters of width 2 on the last text
    words = model.embed[cells].sum(axis=1)[-2:]
    one = words[0] @ model.filters[1][: toxicity.SIZE] + words[1] @ model.filters[1][toxicity.SIZE :] + model.shifts[1]
    two = words[1] @ model.filters[1][: toxicity.SIZE] + model.shifts[1]
    want = np.maximum(np.maximum(one, two), 0)
    block = slice(toxicity.FILTERS, 2 * toxicity.FILTERS)
    assert np.allclose(model.pooled(cells, counts)[0][3, block], want, atol=1e-5)


def test_toxicity_learns_and_edges(spark):
    r = random.Random(1)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = r.choices(vocab, k=40)
        if i % 4 == 0:
            words[r.randrange(40)] = r.choice(["vilething", "vileone", "vilestuff"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.trained(texts[:450], labels[:450], ["en"] * 450)
    scores = model.scores(texts[450:])
    assert ((scores >= 0.5) == np.array(labels[450:], bool)).mean() > 0.95
    again = toxicity.trained(texts[:450], labels[:450], ["en"] * 450)
    assert np.array_equal(scores, again.scores(texts[450:]))
    got = toxicity.scored(_edges(spark), model).collect()
    assert len(got) == len(EDGES) and all(0 <= x["score"] <= 1 for x in got)
    assert all(x["score"] < 0.5 for x in got if x["doc_id"] in (1, 2, 3))
    assert toxicity.scored(_edges(spark).limit(0), model).count() == 0
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts[:50])], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none).scores(["a", None]).tolist() == [0, 0]
    marks = spark.createDataFrame([(i, 1, labels[i]) for i in range(50)] + [(None, 1, 1), (1, 0, None)], none.schema)
    used = toxicity.sample(docs, marks, per_class=1_000).collect()
    assert len(used) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))
    fewer = toxicity.sample(docs, marks, per_class=5).collect()
    assert 2 <= len(fewer) <= 25 and {tuple(x) for x in fewer} <= {tuple(x) for x in used}
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 5 != 0 for x in used)


def test_toxicity_uses_every_language_of_the_sample(monkeypatch):
    r = random.Random(4)
    langs = [f"l{i:03d}" for i in range(70)]
    own = {lang: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(30)] for lang in langs}
    rows = [(lang, j % 2) for j in range(20) for lang in langs]
    texts = [" ".join(r.choices(own[lang], k=15) + ["vile"] * toxic) for lang, toxic in rows]
    args = (texts, [toxic for _, toxic in rows], [lang for lang, _ in rows])
    model = toxicity.trained(*args, epochs=1)
    assert model.langs == langs and sorted(model.thresholds) == langs
    guess = model.guessed(*toxicity.features(["", *texts]))
    assert guess[0] == -1 and [langs[k] for k in guess[1:]] == args[2]
    # the same with a full matrix
    monkeypatch.setattr(toxicity, "FULL_LANGS", 100)
    full = toxicity.trained(*args, epochs=1)
    assert full.lang_log is not None and full.thresholds == model.thresholds
    assert full.scores(texts).tolist() == model.scores(texts).tolist()
    assert len({*model.thresholds.values()}) > 1


def test_toxicity_learns_from_all_documents(spark, monkeypatch):
    """Word counts, parameters and thresholds beyond the documents that training starts with."""
    r = random.Random(6)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(200)]
    docs, marks = [], []
    for i in range(1500):
        toxic = int(i % 3 == 0)
        docs.append((i, " ".join(r.choices(vocab, k=20) + ["vilething"] * toxic), "en" if i % 50 else f"l{i // 50 % 5}"))
        marks.append((i, 1, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    start = toxicity.sample(docs, marks, per_class=20).collect()
    assert len({x["lang"] for x in start}) < 6
    monkeypatch.setattr(toxicity, "PIECE", 200)
    model = toxicity.fit(docs, marks, per_class=20)
    used = docs.where("crc32(cast(doc_id as string)) % 5 <> 0").collect()
    assert model.langs == sorted({x["lang"] for x in used}) and len(model.langs) == 6
    assert sorted(model.thresholds) == model.langs
    rest = docs.where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    found = model.scores([x["text"] for x in rest]) >= 0.5
    assert (found == np.array([x["doc_id"] % 3 == 0 for x in rest])).mean() > 0.95
    # counts of the guess: every word of the documents that are not set apart
    marked = {x["doc_id"]: x["mark"] for x in toxicity._marked(marks).collect()}
    learned = [x for x in used if int(marked[x["doc_id"]] * (1 << 30)) % toxicity.HOLD]
    cells = [toxicity.features([x["text"]])[0] for x in learned]
    want = toxicity.ToxicityModel()
    toxicity._learn_langs(want, cells, [x["lang"] for x in learned])
    assert want.langs == model.langs and np.array_equal(want.lang_log, model.lang_log)
    # the order in which rows come is no matter
    again = toxicity.fit(docs.repartition(7), marks.repartition(3), per_class=20)
    texts = [x["text"] for x in rest]
    assert np.array_equal(again.scores(texts), model.scores(texts))
    # all in the start: nothing more to learn from
    assert toxicity.sample(docs, marks, per_class=1500).count() == len(used)


def test_toxicity_cut_of_counts():
    r = np.random.default_rng(3)
    for _ in range(50):
        steps, labels = r.integers(-30, 30, 40), r.random(40) < 0.5
        every = np.unique(steps)
        bad, good = (np.array([(labels[steps == s] == want).sum() for s in every]) for want in (True, False))
        cut = toxicity._best_step(every, bad, good)
        by_row = toxicity._best_cut((steps + 0.5) / toxicity.STEPS, labels)
        assert ((steps / toxicity.STEPS >= cut) == (steps / toxicity.STEPS >= by_row)).all()
    assert toxicity._best_step(np.array([1, 2]), np.array([1, 1]), np.array([0, 0])) is None
