"""Operators that bring rows together: near-duplicates, packing, mixing, syncmers, WARC."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm import components, mixing, packing, simhash, syncmers, warc
from evenkeel.llm.common import table
from evenkeel.llm.queries import TOKENIZER
from evenkeel.session import pinned

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "only words"), (None, "only words"), (4, "x y " * 9_000), (5, "a\x1cb c")]
EDGES += [(6, "alpha beta gamma delta"), (6, "another text with this id"), (7, "alpha beta gamma delta"), (7, None)]


def _edges(spark, source="'s'"):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    clash = "'z' as key, 1 as size, 2 as copy, 3 as n, 4 as range, 5 as simhash, 6 as length, 7 as _simhash, 8 as row"
    return df.selectExpr("*", "'en' as lang", f"{source} as source", "0L as n_chars", *clash.split(", "))


def _root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# near-duplicates


def _slow_fingerprint(text, shingle=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_brute_force():
    texts = [t for _, t in EDGES if t is None or len(t) < 1000] + ["ÄÖ Straße STRASSE A B", "one", "one two", "a b c a b c a b c"]
    assert simhash.fingerprints(texts).tolist() == [_slow_fingerprint(t) for t in texts]


def _brute_components(values):
    parent = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= 3:
                parent[_root(parent, i)] = _root(parent, j)
    return [_root(parent, i) for i in range(len(values))]


@pytest.mark.parametrize("limit", [4096, 9])
def test_near_duplicates_against_brute_force(spark, limit):
    r = random.Random(6)
    values = []
    for _ in range(25):
        base = r.getrandbits(64)
        values.append(base)
        for _ in range(r.randint(0, 30)):
            near = base
            for b in r.sample(range(64), r.randint(0, 6)):
                near ^= 1 << b
            values.append(near)
    low = r.getrandbits(32)
    values += [(r.getrandbits(32) << 32) | low for _ in range(40)]  # one crowded variant
    values += [0, 0, 7, (1 << 64) - 1]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    prints = pinned(spark.createDataFrame(rows, "doc_id long, simhash long").repartition(3))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(prints, most_in_run=limit).collect()}
    roots = _brute_components(values)
    least = {}
    for i, root in enumerate(roots):
        least[root] = min(least.get(root, i), i)
    assert got == {i: least[root] for i, root in enumerate(roots)}


def test_long_runs_pass_on_whole(spark):
    """Runs that cross batches keep their rows, whatever the size of batches."""
    import pyarrow as pa

    keys = np.repeat([1, 2, 3], [3, 300_000, 2])
    prints = np.arange(len(keys), dtype=np.int64) << 20
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + 9_999]), pa.array(prints[i : i + 9_999])], ["signature", "simhash"])
        for i in range(0, len(keys), 9_999)
    ]
    out = [b for b in simhash._runs(iter(batches), 1, 3, 100)]
    hot = sorted(x for b in out for s, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True) if y is None and s == 2)
    assert hot == prints[3:-2].tolist()


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((_root(parent, a), _root(parent, b)))
        parent[y] = x
    want = {x: _root(parent, x) for e in edges if e[0] != e[1] for x in e}
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x["node"]: x["root"] for x in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_edges(spark):
    df = _edges(spark)
    got = simhash.near_duplicates(pinned(simhash.fingerprinted(df))).collect()
    assert len(got) == len(EDGES)
    assert {x["component_id"] for x in got if x["simhash"] == 0} == {1}
    assert Counter(x["component_id"] for x in got)[6] == 3
    assert Counter(x["component_id"] for x in got)[None] == 2
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    texts = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str)
    want = [(1, None), (4, "x y " * 9_000), (5, "a\x1cb c"), (6, "alpha beta gamma delta"), (6, "another text with this id")]
    assert texts == sorted([*want, (None, "only words")], key=str)
    assert simhash.deduplicated(df.limit(0)).count() == 0


# packing


def _whole(counts, patterns, length):
    held = Counter()
    for contents, n in patterns:
        assert n > 0 and sum(contents) <= length
        for size in contents:
            held[size] += n
    return held == Counter({s: n for s, n in counts.items() if n})


def _optimum(sizes, length):
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                k = rooms.index(room)
                place(i + 1, rooms[:k] + [room - sizes[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [length - sizes[i]])

    place(0, [])
    return best[0]


def test_solver_against_exhaustive_search():
    r = random.Random(8)
    missed = 0
    for _ in range(120):
        length = r.choice([10, 20, 30])
        sizes = sorted((r.randint(1, length) for _ in range(r.randint(0, 9))), reverse=True)
        counts = Counter(sizes)
        got = packing.solved(counts, length)
        assert _whole(counts, got, length)
        used, optimum = sum(n for _, n in got), _optimum(sizes, length) if sizes else 0
        assert packing.lower_bound(counts, length) <= optimum <= used
        missed += used > optimum
    assert missed <= 2


def test_solver_holds_large_histograms():
    r = random.Random(9)
    for _ in range(20):
        counts = {r.randint(1, 1024): r.choice([1, 3, 10_000_000]) for _ in range(r.randint(1, 300))}
        got = packing.solved(counts)
        assert _whole(counts, got, 1024)
        assert sum(n for _, n in got) <= sum(n for _, n in packing.best_fit(counts))


def test_undominated_fillings():
    assert packing._dominates((5, 3), (4, 3)) and packing._dominates((7,), (4, 3)) and not packing._dominates((5, 2), (4, 3))
    found = packing.fillings({7: 1, 4: 2, 3: 2, 2: 1}, 7)
    assert found == [(7,)]


def _check_placement(rows, docs):
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
        by_sequence[x["sequence_id"]].append((x["offset"], x["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(x["length"] for x in rows) == sum(len(ids) for _, ids in docs)
    return by_doc, by_sequence


def test_packing_of_documents(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents")
    own = [(x["doc_id"], [*tokenizer.encode(x["text"], add_special_tokens=False).ids, 2]) for x in docs.collect()]
    rows = packing.placement(docs, TOKENIZER).collect()
    by_doc, by_sequence = _check_placement(rows, own)
    for doc_id, ids in own:
        parts = sorted(by_doc[doc_id], key=lambda x: x["piece"])
        assert [x["piece"] for x in parts] == list(range(-(-len(ids) // 1024)))
        at = 0
        for k, x in enumerate(parts):
            assert x["start"] == at and (x["length"] == 1024 or k == 0)
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[at : at + x["length"]], "<u4").tobytes())
            at += x["length"]
        assert at == len(ids)
    assert len(by_sequence) <= 1.01 * -(-sum(len(i) for _, i in own) // 1024) + 1
    built = packing.sequences(packing.pieces(docs, TOKENIZER), packing.placement(docs, TOKENIZER)).collect()
    assert sum(len(x["ids"]) for x in built) == 4 * sum(len(i) for _, i in own) and len(built) == len(by_sequence)


def test_ranks_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "x   y  \n\n z", "İı'S 's 12³ é", " " * 5000, "ab" * 3000, "", "\x00\x1c", "日本語 🙂"]
    for text in texts:
        assert packing.encoded(text, TOKENIZER).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_edges(spark):
    rows = packing.placement(_edges(spark), TOKENIZER).collect()
    own = [(i, [*packing.encoded(t or "", TOKENIZER), 2]) for i, t in EDGES]
    _check_placement(rows, own)
    assert sum(x["doc_id"] is None for x in rows) == 2
    assert packing.placement(_edges(spark).limit(0), TOKENIZER).count() == 0


# mixing


def _targets(sizes):
    """Sources in order with their sizes to targets, by sharing what is above until nothing is."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = [3 * sizes[i] if i in capped else left * weights[i] / weight for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in capped and share[i] > 3 * sizes[i]}
        if not above:
            return share
        capped |= above


def test_targets_against_rounds(spark):
    r = random.Random(3)
    for _ in range(4):
        sizes = [r.choice([0, 1, 5, 40, 900, 20_000]) for _ in range(r.randint(1, 12))] + [7]
        rows = [(i, f"0s{i:02d}", n, 1) for i, n in enumerate(sizes)]
        got = mixing.sources(spark.createDataFrame(rows, "doc_id long, key string, size long, copies long"))
        targets = [x["target"] for x in got.orderBy("key").collect()]
        assert np.allclose(targets, _targets(sizes))


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"), F.lit(1)).alias("x"))
        assert sorted(x["x"] for x in df.collect()) == list(range(n))
    spread = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000).cast("long"), F.lit("k")).alias("x"))
    order = [x["x"] for x in spread.collect()]
    assert abs(np.corrcoef(np.arange(1000), order)[0, 1]) < 0.15


def test_mix_meets_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {x["doc_id"]: (x["source"], len(WORD.findall(x["text"] or ""))) for x in docs.collect()}
    rows = mixing.taken_words(docs).collect()
    assert {x["doc_id"]: x["size"] for x in rows} == {i: n for i, (_, n) in texts.items()}
    by_source = defaultdict(int)
    for _, (source, n) in texts.items():
        by_source[source] += n
    names = sorted(by_source)
    targets = dict(zip(names, _targets([by_source[s] for s in names]), strict=True))
    taken = defaultdict(int)
    for x in rows:
        source = texts[x["doc_id"]][0]
        assert x["source_size"] == by_source[source] and np.isclose(x["target"], targets[source])
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[source] += x["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 0.02 * target + 3 * mixing.BLOCK
    again = mixing.taken_words(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixed_texts_hold_the_taken_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = {x["doc_id"]: x["text"] for x in docs.collect()}
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    taken = {x["doc_id"]: x["taken"] for x in mixing.taken_words(docs).collect()}
    words = Counter()
    for x in mixed.collect():
        assert x["n_chars"] == len(x["text"])
        part, rest = WORD.findall(x["text"]), iter(WORD.findall(own[x["doc_id"]]))
        assert all(w in rest for w in part)  # in order
        words[x["doc_id"]] += len(part)
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_mixing_edges(spark):
    df = _edges(spark, "case when doc_id in (4, 5) then null when doc_id = 6 then '' else 'q' end")
    rows = mixing.taken_words(df).collect()
    assert len(rows) == len(EDGES)
    assert all(x["taken"] <= 3 * x["size"] for x in rows)
    by = defaultdict(list)
    for x in rows:
        by[x["doc_id"]].append(x)
    assert by[1][0]["size"] == 0 and by[1][0]["taken"] == 0
    assert by[4][0]["source_size"] == 18_002 and by[6][0]["source_size"] == 9
    assert mixing.taken_words(df.limit(0)).count() == 0
    assert mixing.mixed_texts(df).columns == df.columns
    assert mixing.mixed_texts(df.limit(0)).count() == 0
    nothing = df.where("doc_id in (1, 2, 3)")
    assert [x["taken"] for x in mixing.taken_words(nothing).collect()] == [0, 0, 0]


def test_mixing_is_native(spark, sf_dir):
    plan = mixing.taken_words(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|CartesianProduct|NestedLoop", plan)


# syncmers


def _slow_anchors(text, k=syncmers.K, s=syncmers.S):
    def smaller(x):
        v = 0
        for c in x:
            v = (v * 0x9E3779B97F4A7C15 + ord(c) + 1) % (1 << 64)
        v = ((v ^ (v >> 31)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        return v ^ (v >> 29)

    out = []
    for i in range(len(text) - k + 1):
        inner = [smaller(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_syncmers_against_brute_force():
    r = random.Random(5)
    texts = ["".join(r.choices("abcdé 🙂", k=r.randint(0, 60))) for _ in range(60)] + ["aaaa" * 9]
    found = syncmers._all_anchors(texts, syncmers.K, syncmers.S)
    for text, (_, places) in zip(texts, found, strict=True):
        want = _slow_anchors(text) if len(text) >= syncmers.K else [0] * bool(text)
        assert places.tolist() == want
    # context-free: an anchor stays one wherever its text goes
    a, b = syncmers.anchors("hello brave new world"), syncmers.anchors("xyzw" + "hello brave new world")
    assert set(a[0].tolist()) <= set(b[0].tolist())


def test_fingerprint_text_round_trip():
    for one in syncmers.prints(["", "ab", "some longer text that has anchors " * 3]):
        assert syncmers.written(syncmers.read(syncmers.written(one))) == syncmers.written(one)


def test_fingerprint_holds_every_anchor():
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(500)]
    for n_words in (200, 1_500, 5_000):
        words = r.choices(vocabulary, k=n_words)
        text = " ".join(words)
        other = " ".join(words[: n_words // 2] + ["qrstuv"] + words[n_words // 2 + 1 :])
        one, two = syncmers.prints([text, other])
        assert sorted(syncmers.read(syncmers.written(one))[2].tolist()) == _slow_anchors(text)
        assert syncmers.written(one) != syncmers.written(two)
        # a word of the same length costs the few anchors that touch it, whatever the length of the text
        same = " ".join(words[: n_words // 2] + ["q" * len(words[n_words // 2])] + words[n_words // 2 + 1 :])
        lost = (1 - syncmers.likeness(one, syncmers.prints([same])[0])) * len(one[1])
        assert 0 < lost < 30


@pytest.mark.parametrize("size", [30, 3_000])
def test_likeness_survives_insertions(size):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(size)]
    words = r.choices(vocabulary, k=1_000)
    one = syncmers.prints([" ".join(words)])[0]
    once = " ".join(words[:500] + ["qrstuv"] + words[500:])
    assert 0.98 < syncmers.likeness(one, syncmers.prints([once])[0]) < 1
    often = " ".join(w + " qrstuv" * (i % 100 == 50) for i, w in enumerate(words))
    two = syncmers.prints([often])[0]
    assert 0.9 < syncmers.likeness(one, two) == syncmers.likeness(two, one) < 1
    other = syncmers.prints([" ".join(r.choices(vocabulary, k=1_000))])[0]
    assert syncmers.likeness(one, other) < 0.5


def test_likeness_against_brute_force():
    r = random.Random(10)

    def chain(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(30):  # no anchor stands twice
        text = "".join(map(chr, r.sample(range(200, 9_000), 200)))
        cut = sorted(r.choices(range(200), k=4))
        other = text[: cut[0]] + "".join(map(chr, r.sample(range(9_000, 10_000), 9))) + text[cut[1] : cut[3]] + text[cut[0] : cut[1]]
        (a, b), (x, y) = syncmers.prints([text, other]), syncmers._all_anchors([text, other], syncmers.K, syncmers.S)
        want = 2 * chain(x[0].tolist(), y[0].tolist()) / max(len(x[0]) + len(y[0]), 1)
        assert syncmers.likeness(a, b) == (want if len(x[0]) and len(y[0]) else float(len(x[0]) == len(y[0])))


def _slow_compared(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edit = text[: len(text) - cut] + following[:cut]
        one, two, three = syncmers.prints([text, edit, following])
        near = (syncmers.likeness(one, two), syncmers.likeness(one, three))
        digest = hashlib.sha256(edit.encode()).hexdigest()
        out.append((doc_id, len(text), digest, syncmers.written(one), syncmers.written(two), *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_rows", [2, 40, 1_000_000])
def test_successors_across_ranges(spark, sf_dir, range_rows):
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0 or doc_id < 20").repartition(3)
    got = [tuple(x) for x in syncmers.compared(docs, range_rows).collect()]
    assert sorted(got, key=str) == _slow_compared([(x["doc_id"], x["text"]) for x in docs.collect()])


@pytest.mark.parametrize("range_rows", [2, 1_000])
def test_syncmer_edges(spark, range_rows):
    df = _edges(spark)
    assert sorted((tuple(x) for x in syncmers.compared(df, range_rows).collect()), key=str) == _slow_compared(EDGES)
    assert syncmers.compared(df.limit(0)).count() == 0
    one = syncmers.compared(df.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def _shuffled_bytes(df):
    """Bytes of the rows that the largest shuffle of a collected frame has moved, before Spark's own compression."""
    waiting, found = [df._jdf.queryExecution().executedPlan()], [0]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("dataSize").value())
        children = node.children()
        waiting.extend(children.apply(i) for i in range(children.size()))
    return max(found)


@pytest.mark.parametrize("range_rows", [8, 1_000])
def test_texts_are_dealt_to_ranges_compressed(spark, sf_dir, range_rows):
    docs = table(spark, sf_dir, "documents")
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    got = syncmers.compared(docs, range_rows)
    assert len(got.collect()) == docs.count()
    assert 0 < _shuffled_bytes(got) < 0.7 * size


def test_likeness_tells_edits_from_others(spark, sf_dir):
    rows = syncmers.compared(table(spark, sf_dir, "documents")).where("n_chars > 200").collect()
    assert np.mean([x["near_edited"] >= 0.5 for x in rows]) > 0.98
    assert np.mean([x["near_next"] <= 0.2 for x in rows]) > 0.95


# WARC


RECORD = "record_id long, url string, ts timestamp, kind string, status int, headers map<string,string>, body string"


def _records():
    from datetime import datetime, timedelta

    r = random.Random(11)
    begin = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        url = r.choice([None, "http://A.org/x/", "https://a.org:443/x#f", "http://a.org/y?b=2&a=1&utm_source=q", "http://a.org/y?a=1&b=2"])
        ts = r.choice([None] + [begin + timedelta(hours=k) for k in range(30)])
        kind = r.choice(["response", "revisit", "revisit"])
        headers = {"etag": r.choice(['"1"', '"2"', 'W/"1"']), "last-modified": r.choice("ab"), "x-own": str(i), "content-type": "t"}
        headers = {k: v for k, v in headers.items() if r.random() < 0.7}
        status = r.choice([200, 200, 404]) if kind == "response" else 304
        rows.append((i, url, ts, kind, status, headers if r.random() < 0.95 else None, f"body {i}" if kind == "response" else None))
    return rows


def _slow_page(url):
    if url is None:
        return None
    return "//a.org/x" if "/x" in url else "//a.org/y?a=1&b=2"


def test_bases_without_unique_ids(spark):
    from datetime import datetime

    one, two = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [
        (None, "http://a.org/null", one, "response", 200, {"etag": '"1"', "x-own": "null"}, "body null"),
        (7, "http://a.org/a", one, "response", 200, {"etag": '"1"', "x-own": "a"}, "body a"),
        (7, "http://a.org/b", one, "response", 200, {"etag": '"1"', "x-own": "b"}, "body b"),
        (7, "http://a.org/b", one, "response", 200, {"etag": '"1"', "x-own": "b"}, "body b"),
        *[(8, f"http://a.org/{x}", two, "revisit", 304, {"etag": '"1"'}, None) for x in ("null", "a", "b")],
        (9, "http://a.org/a", two, "revisit", 304, {"etag": '"1"'}, None),
        (9, "http://a.org/a", two, "revisit", 304, {"etag": '"2"'}, None),
        (9, "http://a.org/a", two, "revisit", 304, {"etag": '"2"'}, None),
    ]
    got = warc.resolved(spark.createDataFrame(rows, RECORD).repartition(3)).collect()
    found = sorted((x["record_id"], x["url"][13:], str(x["base_id"]), x["outcome"], str(x["body"])) for x in got)
    assert found == [
        (8, "a", "7", "resolved", "body a"),
        (8, "b", "7", "resolved", "body b"),
        (8, "null", "None", "resolved", "body null"),
        (9, "a", "7", "resolved", "body a"),
        (9, "a", "7", "validator_differs", "None"),
        (9, "a", "7", "validator_differs", "None"),
    ]
    assert all(x["headers"]["x-own"] == x["url"][13:] for x in got if x["body"])


def test_revisits_against_brute_force(spark):
    rows = _records()
    df = spark.createDataFrame(rows, RECORD).withColumn("page", F.lit("clash")).withColumn("stretch", F.lit(0)).repartition(5)
    got = {x["record_id"]: x for x in warc.resolved(df).collect()}
    def when(x):
        return (x[2] is not None, x[2], x[0]) if x[2] is not None else (False, 0, x[0])

    assert len(got) == sum(x[3] == "revisit" for x in rows)
    seen = Counter()
    for x in rows:
        if x[3] != "revisit":
            continue
        page = _slow_page(x[1])
        full = [y for y in rows if y[3] == "response" and y[4] == 200 and page and _slow_page(y[1]) == page and when(y) < when(x)]
        base = max(full, key=when, default=None)
        own, theirs = x[5] or {}, (base[5] or {}) if base else {}
        if base is None:
            want = "no_earlier_response"
        elif "etag" in own and "etag" in theirs and not own["etag"].startswith("W/") and not theirs["etag"].startswith("W/"):
            want = "resolved" if own["etag"] == theirs["etag"] else "validator_differs"
        elif "last-modified" in own and "last-modified" in theirs:
            want = "resolved" if own["last-modified"] == theirs["last-modified"] else "validator_differs"
        else:
            want = "no_validator"
        y = got[x[0]]
        assert y["outcome"] == want and y["base_id"] == (base[0] if base else None) and y["page"] == page
        seen[want] += 1
        if want == "resolved":
            merged = theirs | {k: v for k, v in own.items() if k in warc.PERMITTED}
            assert y["headers"] == merged and y["body"] == base[6]
        else:
            assert y["headers"] is None and y["body"] is None
    assert len(seen) == 4


@pytest.mark.parametrize("hot_rows", [5, 1_000])
def test_a_base_that_most_revisits_share(spark, monkeypatch, hot_rows):
    from datetime import datetime, timedelta

    monkeypatch.setattr(warc, "HOT_ROWS", hot_rows)
    begin = datetime(2024, 1, 1)
    rows = [(i, f"http://a.org/{i}", begin, "response", 200, {"etag": '"1"'}, f"body {i}") for i in range(100)]
    rows += [
        (1000 + n, f"http://a.org/{0 if n % 10 < 7 else n % 100}", begin + timedelta(hours=1 + n % 50), "revisit", 304,
         {"etag": '"1"' if n % 90 else '"2"', "date": str(n)}, None)
        for n in range(1600)
    ]
    rows += rows[-40:]  # some revisits twice
    change = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {c: spark.conf.get(c) for c in change}
    try:
        for c, v in change.items():
            spark.conf.set(c, v)
        got = warc.resolved(spark.createDataFrame(rows, RECORD)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert Counter(x["record_id"] for x in got) == Counter(x[0] for x in rows if x[3] == "revisit")
    for x in got:
        n = x["record_id"] - 1000
        assert x["outcome"] == ("resolved" if n % 90 else "validator_differs")
        if n % 90:
            assert x["body"] == f"body {0 if n % 10 < 7 else n % 100}" and x["headers"] == {"etag": '"1"', "date": str(n)}
    most = max(Counter(x["task"] for x in got).values())
    assert (most <= 2.5 * len(got) / 8) == (hot_rows == 5)


def test_repeated_records_and_empty_tables(spark):
    df = spark.createDataFrame(_records()[:60], RECORD)
    twice = warc.resolved(df.unionByName(df))
    assert twice.count() == 2 * warc.resolved(df).count()
    assert warc.resolved(df.limit(0)).count() == 0
