"""What the driver's contract asks of the text queries."""

import __spark_entry__ as entry
import corpus_pipeline
from furrow.llm import queries


def test_registered():
    known = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(known)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "secret scans", "packing"]
    assert set(entry.oracle_sql()) <= set(known)


def test_every_query_on_the_small_tables(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for name, query in queries.QUERIES.items():
        got = query(spark, sf_dir).count()
        if name in ("op9_url_filters", "op13_html_text"):
            assert got == pages
        elif name == "op11_whitening":
            assert got == 16 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
        elif name == "op5_packing":
            assert got >= documents
        elif name != "op4_license_scans":
            assert got == documents, name
