"""All registered queries over odd and over empty tables."""

import pytest

from evenkeel.llm import queries

DOCS = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (None, "words without an id", "fr", "b", 19),
    (None, None, None, None, None), (4, "same text here " * 20, "en", "a", 300), (4, "same text here " * 20, "en", "a", 300),
    (5, "same text here " * 20, "en", "b", 300), (6, "x" * 200_000, "de", "c", 200_000), (7, "a b " * 40_000, "de", "c", 160_000),
    (8, "\u0001\u0000é🙂 <|endoftext|> </s>", "xx", "", 20), (2**40, "far away", "en", "a", 8), (-3, "below zero", "en", "a", 10),
]
TALK = [
    (1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (2, 1, "assistant", "</s>\\"), (2, 1, "tool", "[INST]"),
    (-7, 5, "user", "kept apart?"),
]
VECTORS = [
    (0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
    (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.25]), (9, [-1.0, 0.25]), (40, [3e38, -3e38]),
]
ITEMS = [(1, None), (2, ""), (3, "a b"), (3, "far AWAY"), (None, "same text"), (None, "same text"), (4, "x" * 200_000), (5, "nowhere")]
OWN = {"op3_packing", "op8_warc", "op10_chat", "op11_neighbours", "op12_whitening", "op13_lexical", "pipeline"}


def _write(spark, path, some):
    """The tables with further columns whose names clash with those of results."""
    clash = ["0.5D as score", "'k' as key", "1L as size", "true as kept", "2 as component_id", "'r' as `range`", "3 as n"]
    docs = spark.createDataFrame(DOCS if some else [], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *clash, "9 as toxic").write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (4, 1, 1), (None, 1, 1), (7, None, None)] if some else [], "doc_id long, quality int, toxic int")
    labels.selectExpr("*", "'t' as text", "'l' as lang").write.parquet(f"{path}/labels.parquet")
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/b", "x"), (2, "http://a/b", "x"), (None, "u", "h"), (3, "", "")] if some else [], "page_id long, url string, html string")
    pages.selectExpr("*", "'b' as body", "1 as ts").write.parquet(f"{path}/pages.parquet")
    talk = spark.createDataFrame(TALK if some else [], "conv_id long, turn long, role string, text string")
    talk.selectExpr("*", "'f' as formatted", "1 as layout").write.parquet(f"{path}/conversations.parquet")
    vectors = spark.createDataFrame(VECTORS if some else [], "vec_id long, embedding array<float>")
    vectors.selectExpr("*", "1 as id", "2 as v", "3 as score", "'x' as x").write.parquet(f"{path}/embeddings.parquet")
    items = spark.createDataFrame(ITEMS if some else [], "item_id long, text string")
    items.selectExpr("*", "1 as term", "2 as terms", "3 as doc_id").write.parquet(f"{path}/benchmark.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for name, some in (("odd", True), ("empty", False)):
        made[name] = str(tmp_path_factory.mktemp(name) / "sf")
        _write(spark, made[name], some)
    return made


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, folders, name):
    rows = queries.QUERIES[name](spark, folders["odd"]).collect()
    if name not in OWN:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in DOCS)
    if name == "op3_packing":
        assert {str(r["doc_id"]) for r in rows} == {str(d[0]) for d in DOCS}
    if name == "op10_chat":
        assert {r["conv_id"]: r["n_turns"] for r in rows} == {1: 2, None: 1, 2: 2, -7: 3}
    if name == "op11_neighbours":
        assert {r["query_id"] for r in rows} == {0, 20, 40}
    if name == "op12_whitening":
        assert {r["vec_id"] for r in rows} == {0, 20, None, 3, 8, 9}  # 3e38 is beyond the grid
    if name == "op13_lexical":
        assert {r["item_id"] for r in rows} == {3, None, 4}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, folders, name):
    rows = queries.QUERIES[name](spark, folders["empty"]).collect()
    assert len(rows) == (1 if name == "op10_chat" else 0)
