"""The pipeline: each stage's decisions take effect on what the stage before it kept."""

import corpus_pipeline
import duckdb
import numpy as np
from tokenizers import Tokenizer

from digestlake.session import stash
from tests.conftest import SF
from tests.llm.test_llm import brute_hits, brute_near


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_masking", "bpe_encoding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != "bpe_encoding":
            assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        ids = sorted(r["doc_id"] for r in kept[name])
        if name == "near_duplicates":
            assert ids == sorted(d for d, _, _, k in brute_near(rows, 5, 80) if k)
        if name == "decontamination":
            assert ids == sorted(g[0] for g in brute_hits(rows, bench) if not g[4])
        if name in ("secret_masking", "bpe_encoding"):
            assert ids == sorted(d for d, _ in rows)
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in kept["secret_masking"]}
    for r in kept["bpe_encoding"]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(texts)
