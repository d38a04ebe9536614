"""The pipeline's stages on planted rows, and its registration."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from conftest import FOLDER
from holdfast.llm import near_dedup


def test_registered():
    known = contract.queries()
    assert {n.split("_")[0] for n in known if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in known and "pipeline" not in contract.oracle_sql()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe"]


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    top = docs.agg(F.max("doc_id")).first()[0]
    text = docs.filter("lang = 'en' and n_chars > 400").orderBy("doc_id").first().text
    extra = [(top + 1, text.upper(), "en", "src1", 5), (top + 2, text + " also", "en", "src1", 5), (top + 3, "1234", "en", "src1", 4), (top + 4, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == names
    known = {r.doc_id for r in seen["language_id"].collect()}
    assert top + 3 not in known and top + 4 not in known and len(known) >= 0.98 * before.count() / 2
    bodies = [r.text.lower() for r in seen["exact_dedup"].collect()]
    assert len(bodies) == len(set(bodies))
    near = near_dedup.near_components(seen["exact_dedup"], words=5).collect()
    assert {r.doc_id for r in near if r.kept} == {r.doc_id for r in seen["near_dedup"].collect()}
    assert top + 2 not in {r.doc_id for r in seen["near_dedup"].collect()}
    mixed = Counter(r.doc_id for r in seen["mix_sources"].collect())
    assert set(mixed) <= {r.doc_id for r in seen["near_dedup"].collect()}
    last = seen["bpe"].collect()
    assert Counter(r.doc_id for r in last) == mixed and all(len(r.ids) == r.n_tokens for r in last)
