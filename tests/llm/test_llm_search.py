"""Neighbours, whitening and lexical search against brute force."""

import math
import random
import re
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel import session
from evenkeel.llm import lexical, neighbours, whitening
from evenkeel.llm.common import table

CLASH = ["'z' as id", "1 as v", "2 as x", "3 as score", "4 as rank", "5 as component", "6 as dim", "7 as w", "8 as qid"]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", *CLASH)


# neighbours


def _slow_nearest(rows, k):
    fit = {(i, tuple(v)) for i, v in rows if i is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)}
    out = {}
    for q, a in fit:
        if q % 20 == 0:
            near = []
            for c, b in fit:
                if c != q and len(a) == len(b):
                    total = 0.0
                    for x, y in zip(a, b, strict=True):
                        total += x * y
                    near.append((-total, c))
            out[q] = [(c, -s) for s, c in sorted(near)[:k]]
    return out


def _found(df, k=20):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


def _check_nearest(spark, rows, k=20):
    got = _found(neighbours.nearest(_vectors(spark, rows), "vec_id", "embedding", F.col("id") % 20 == 0, k))
    want = _slow_nearest(rows, k)
    assert got == {q: near for q, near in want.items() if near}


def test_neighbours_on_random_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=13).tolist()) for i in range(700)]
    _check_nearest(spark, rows)
    # Many small blocks and tiles give the same.
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 16)
    monkeypatch.setattr(neighbours, "TILE", (7, 23))
    _check_nearest(spark, rows[:400], 5)


def test_neighbours_with_ties_and_copies(spark):
    r = random.Random(4)
    # Few values, so that very many scores are equal, and a third of the rows are one vector.
    rows = [(i, [float(r.randint(-1, 1)) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 0.125, 1.0]) for i in range(200)]
    _check_nearest(spark, rows)
    _check_nearest(spark, [(i, [1.0, 0.0]) for i in range(90)], 7)


def test_neighbours_at_the_limits_of_doubles(spark):
    rows = [(i, v) for i, v in enumerate([[1e-200, 1e-200], [1.0, 2.0], [1e150, -1e150], [5e-324, 0.0], [-3.0, 1e-9], [1e8, 1.0]] * 4)]
    _check_nearest(spark, [(20 * i, v) for i, v in rows], 3)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (40, [0.0, 0.0])]
    rows += [(5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (-20, [-1.0, 0.0])]
    _check_nearest(spark, rows)
    assert _found(neighbours.nearest(_vectors(spark, []), "vec_id", "embedding", F.col("id") % 20 == 0)) == {}
    assert _found(neighbours.nearest(_vectors(spark, [(0, [1.0])]), "vec_id", "embedding", F.col("id") % 20 == 0)) == {}


def test_bounds_hold():
    r = np.random.default_rng(5)
    for width, scale in ((3, 1.0), (64, 1e-3), (2500, 7.0)):
        a, b = (neighbours.Coded(r.normal(size=(50, width)) * scale ** r.integers(-2, 3, size=(50, 1))) for _ in range(2))
        lower, upper = neighbours.bounds(a, slice(0, 50), b, slice(0, 50))
        exact = np.stack([neighbours.products(np.broadcast_to(x, b.vectors.shape), b.vectors) for x in a.vectors])
        assert (lower <= exact).all() and (exact <= upper).all()
        assert (upper - lower <= 0.2 * np.outer(a.size, b.size)).all()


# whitening


def _slow_whitened(rows, weights="one", most=16):
    usable = [(i, tuple(math.floor(64 * e) + 1_000_000 for e in v)) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    counts = Counter(x for _, x in usable)
    xs = list(counts)
    w = [counts[x] if weights == "counts" else 1 for x in xs]
    n = sum(w)
    sums = [sum(a * x[d] for a, x in zip(w, xs, strict=True)) for d in range(len(xs[0]))]
    centred = np.array([[(n * e - s) / n for e, s in zip(x, sums, strict=True)] for x in xs])
    values, vectors = np.linalg.eigh((centred * np.array(w)[:, None]).T @ centred / n)
    told = {}
    for x, c in zip(xs, centred, strict=True):
        deviation = sum((n * e - s) ** 2 for e, s in zip(x, sums, strict=True))
        told[x] = (n, deviation, c @ vectors[:, ::-1][:, :most] / np.sqrt(np.maximum(values[::-1][:most], 1e-300)))
    return [(i, told[x]) for i, x in usable], values[::-1] / values.sum()


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_against_brute_force(spark, weights):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=20) * np.arange(1, 21)).tolist()) for i in range(150)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(90)] + [(500, rows[0][1]), (None, rows[5][1])]
    rows += [(900, None), (901, [float("nan")] * 20), (902, [None] * 20), (903, [float("-inf")] * 20), (904, [1e300] * 20)]
    got = whitening.whitened(_vectors(spark, rows), "vec_id", "embedding", 16, weights).collect()
    want, share = _slow_whitened([row for row in rows if row[0] != 904], weights)
    assert len(got) == 16 * len(want)
    left = defaultdict(list)
    for r in got:
        left[r["vec_id"], r["component"]].append(r)
    signs = {}
    for vec_id, (n, deviation, values) in want:
        for k in range(16):
            r = left[vec_id, k + 1].pop()
            assert (r["n"], r["deviation"]) == (n, deviation)
            sign = signs.setdefault(k, 1 if abs(r["whitened"] - values[k]) < abs(r["whitened"] + values[k]) else -1)
            assert r["whitened"] == pytest.approx(sign * values[k], rel=1e-7, abs=1e-9)
            assert r["explained"] == pytest.approx(share[k], rel=1e-9)
            assert r["identity_error"] < 1e-9
    assert not any(left.values())


def test_whitening_odd_tables(spark):
    def run(rows):
        return whitening.whitened(_vectors(spark, rows), "vec_id", "embedding").collect()

    assert run([]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector has no variance
    assert run([(1, []), (2, [])]) == []
    # Two lengths are fitted apart; a line has one component.
    got = run([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0]), (4, [1.0]), (5, [2.0])])
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in got) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 2), (5, 1, 2)]
    # Deviations beyond 64 bits are told as NULL, large ones exactly.
    big = [(1, [2.0**39, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0**20])]
    assert {r["deviation"] for r in run(big)} == {None}
    large = [(1, [2.0**20, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0**20])]
    want, _ = _slow_whitened(large)
    assert {(r["vec_id"], r["deviation"]) for r in run(large)} == {(i, d) for i, (_, d, _) in want}


# lexical search


def _slow_ranked(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = {}
    for i, own in asked.items():
        scored = []
        for doc_id, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        if scored:
            out[i] = [(d, -s) for s, _, _, d in sorted(scored, key=lambda e: e[:3])[:k]]
    return out


def _ranked(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "'x' as block", "2 as lane", "3 as score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as terms", "3 as part")
    got = defaultdict(list)
    for r in lexical.ranked(d, i, k).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    return dict(got)


@pytest.fixture
def corpus():
    r = random.Random(7)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(r.randrange(10_000), " ".join(r.choices(words, k=r.randint(1, 60)))) for _ in range(600)]
    docs += [(20_000 + i, docs[3][1]) for i in range(150)]  # a group of copies
    docs += [(None, docs[3][1]), (None, "w1 w2"), (30_000, None), (30_001, ""), (30_002, " \t,;"), (30_003, "W1!W2?Été été ÉTÉ x")]
    docs += [(30_004, "long " * 30_000 + " ".join(f"u{i}" for i in range(5_000)))]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(30)]
    items += [(90, docs[3][1]), (91, None), (92, "nowhere"), (93, ""), (94, "w1"), (94, "été x"), (None, "w2 w3"), (95, "LONG u17 U18")]
    return docs, items


def test_ranked_search_against_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    want = _slow_ranked(docs, items, 50)
    assert _ranked(spark, docs, items, 50) == want
    assert _ranked(spark, docs, items, 3) == _slow_ranked(docs, items, 3)
    # The functions of a task travel by value only from here, so small blocks are tested on the treap itself below.
    monkeypatch.setattr(lexical, "GROUP_TERMS", 40)
    monkeypatch.setattr(lexical, "LANE_BLOCKS", 1)
    assert _ranked(spark, docs, items, 50) == want


def test_treap_finds_the_best(corpus):
    r = np.random.default_rng(8)
    for n_rows, n_columns, pairs in ((1, 1, 1), (9, 70, 200), (700, 65, 3000), (40, 600, 9000)):
        cells = np.unique(r.integers(0, n_rows * n_columns, pairs))
        rows, columns = cells // n_columns, cells % n_columns
        impacts = r.integers(1, 30, len(cells))
        grid = np.zeros((n_rows, n_columns), np.int64)
        grid[rows, columns] = impacts
        treap = lexical.Treap.built(rows, columns, impacts)
        assert treap.tops[0][0] == impacts.max() and len(treap.tops[-1]) == len(cells)
        order = [-c for c in range(n_columns)]
        for _ in range(10):
            asked = r.choice(n_rows, min(n_rows, 12), replace=False)
            weights = r.integers(1, 9, len(asked))
            scores = weights @ grid[asked]
            for k in (1, 5, 50):
                kept = []
                treap.search(asked, weights, order, kept, k)
                want = sorted(((int(s), -c) for c, s in enumerate(scores) if s > 0), reverse=True)[:k]
                assert sorted(kept, reverse=True) == want


def test_blocks_of_any_size(spark, corpus):
    docs, _ = corpus
    n_docs, n_terms = lexical.totals(spark.createDataFrame(docs, "doc_id long, text string"))
    assert n_docs == len([1 for _, t in docs if lexical.terms_of((t or "").encode())])
    whole, parts, part = lexical._Block(), [], lexical._Block()
    for i, t in docs:
        terms = lexical.terms_of((t or "").encode())
        if terms:
            whole.add(i, terms)
            part.add(i, terms)
            if len(part.ids) == 37:
                parts.append(part)
                part = lexical._Block()
    parts.append(part)
    import pyarrow as pa

    asked = pa.table({"item_id": [1, 2], "terms": [[b"w1", b"w7", b"w9"], [b"u17", b"long"]], "weights": [[5, 90, 31], [7, 2]]})
    one = pa.Table.from_batches([whole.written(0, n_docs, n_terms)])
    many = pa.Table.from_batches([p.written(i, n_docs, n_terms) for i, p in enumerate(parts)])

    def best(blocks):
        rows = lexical._searched(blocks, asked, 20).to_pylist()
        return sorted(((r["item_id"], -r["score"], r["doc_id"] is None, r["doc_id"]) for r in rows), key=lambda r: (*r[:3], r[3] or 0))

    assert best(many).__len__() == best(one).__len__() and best(many) == best(one)


def test_a_task_holds_one_block_at_a_time(spark, corpus):
    docs, items = corpus
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    n_docs, n_terms = lexical.totals(d)
    blocks = lexical.index(d.repartition(40), n_docs, n_terms)
    asked = lexical.weighted(i, blocks, n_docs)
    met = lexical.met(blocks, asked)
    lanes = [r["n"] for r in met.where("turn is not null").groupBy("lane").agg(F.count("*").alias("n")).collect()]
    assert sum(lanes) == blocks.count() and min(lanes) > 1

    def most(batches):
        for batch in batches:
            yield batch.slice(0, 1).select(["lane"]).append_column("blocks", pa.array([len(batch) - batch["turn"].null_count]))

    with session.arrow_bytes(spark, 1):
        assert {r["blocks"] for r in met.mapInArrow(most, "lane int, blocks long").collect()} == {0, 1}

    held = []

    def one_by_one():
        # as Spark hands them over in one task
        for row in met.where("lane = 0").toArrow().to_batches(max_chunksize=1):
            assert all(ref() is None for ref in held)
            row = pa.RecordBatch.from_pydict(row.to_pydict(), row.schema)
            held.append(weakref.ref(row))
            yield row
            del row

    got = pa.Table.from_batches(lexical._searched_in_turn(one_by_one(), 20)).to_pylist()
    own = blocks.join(met.where("lane = 0 and turn is not null").select("ids"), "ids", "left_semi")
    want = lexical._searched(own.toArrow(), asked.toArrow(), 20).to_pylist()
    assert len(held) > 2 and got and sorted(map(str, got)) == sorted(map(str, want))


def test_registered_searches(spark, sf_dir):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    _check_nearest(spark, vectors)
