"""The registered queries against their twins, and the stages of the pipeline against brute-force versions."""

import os
import sys

import pytest

import corpus_pipeline
import oracle
from evenkeel.llm import mixing, packing, queries, repetition, simhash, toxicity
from evenkeel.llm.common import table


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, sf_dir, duck, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name]) == []


CONTRACT = {
    "op1_sharding": ["doc_id", "slot", "shard"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split(),
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_syncmers": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split(),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_covers_its_table(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.columns == CONTRACT[name]
    ids = sorted(x["doc_id"] for x in got.select("doc_id").distinct().collect())
    assert ids == sorted(x["doc_id"] for x in table(spark, sf_dir, "documents").select("doc_id").collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "mixing", "packing"]
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, steps[-1], sf_dir).write.parquet(path)
        steps.append(spark.read.parquet(path))
    for step in steps[1:-1]:
        assert step.dtypes == docs.dtypes
    rows = [{x["doc_id"]: x["text"] for x in s.select("doc_id", "text").collect()} for s in steps[:4]]
    # toxicity: the verdicts of the operator
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    ids = sorted(rows[0])
    scores = model.scores([rows[0][i] for i in ids])
    assert rows[1] == {i: rows[0][i] for i, s in zip(ids, scores, strict=True) if s < 0.5}
    # quality rules
    kept = repetition.judged(repetition.measured(steps[1])).where("kept").select("doc_id").collect()
    assert sorted(rows[2]) == sorted(x[0] for x in kept)
    # near-duplicates: nothing left within reach, and nothing gone without a document that stays
    values = {i: simhash.fingerprint(t) for i, t in rows[2].items()}
    stay = sorted(rows[3])
    assert all(bin(values[a] ^ values[b]).count("1") > 3 for k, a in enumerate(stay) for b in stay[:k])
    groups = simhash.near_duplicates(simhash.fingerprinted(steps[2])).collect()
    assert sorted({x["component_id"] for x in groups}) == stay
    # mixing and packing
    taken = {x["doc_id"]: x["taken"] for x in mixing.taken_words(steps[3]).collect()}
    words = {x["doc_id"]: x["n"] for x in steps[4].selectExpr("doc_id", "size(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) as n")
             .groupBy("doc_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert words == {i: n for i, n in taken.items() if n}
    tokens = sum(len(packing.encoded(x["text"], queries.TOKENIZER)) + 1 for x in steps[4].collect())
    assert steps[5].selectExpr("sum(length)").first()[0] == tokens
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[5].count()


def test_stages_of_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_entry_works_without_the_subpackage(tmp_path):
    """The queries of the library stay when this subpackage and the pipeline are gone."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 90 and 'pipeline' not in q, q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)
