"""The pipeline against its stages' brute-force forms, on the small tables."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from test_llm_operators import jaccard_components, library


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name != "packing":
            assert got.columns == names
        out[name] = got.collect()
        docs = spark.createDataFrame(out[name], got.schema)
    kept = [(r.doc_id, r.text) for r in out["quality rules"]]
    assert sorted(r.doc_id for r in out["minhash near-dedup"]) == sorted(i for i, (_, c) in jaccard_components(kept, 5).items() if i == c)
    clean = {r.doc_id: r.text for r in out["secret scans"]}
    assert sorted(clean) == sorted(r.doc_id for r in out["minhash near-dedup"])
    assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", t) for t in clean.values())
    t = library("word_bpe_49k.json")
    assert sum(r.length for r in out["packing"]) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in clean.values())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.agg(F.sum("length")).first()[0] == sum(r.length for r in out["packing"])


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null, empty, long and repeated texts, null ids, clashing columns; then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, node string"
    some = " ".join(f"word{i}" for i in range(120))
    secret = " ".join(f"other{i}" for i in range(90)) + " password=hunter2hunter2"
    long = " ".join(f"l{i}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, "too short"), (4, some), (5, some), (6, secret), (None, some), (7, long), (7, long)]
    rows = [(i, t, None, "s", len(t) if t else None, "x", "y") for i, t in texts]
    folder = str(tmp_path / "odd")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 0), (1, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    t = library("word_bpe_49k.json")
    clean = secret.replace("password=hunter2hunter2", "[secret]")
    kept = [(4, some), (6, clean), (None, some), (7, long), (7, long)]
    assert {r.doc_id for r in out} == {i for i, _ in kept}
    assert sum(r.length for r in out) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in kept)
    folder = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    labels.limit(0).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
