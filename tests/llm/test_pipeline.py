"""The whole pipeline and each of its stages beside plain versions."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import near, secrets, toxicity

SF = "/root/testdata/sf0.001"
CLASHES = ["score", "predicted", "_row", "_text", "node", "spans", "_sha", "_id", "_k0"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("clash") for c in CLASHES})
    text = rows.orderBy("doc_id").first().text
    odd = spark.createDataFrame([(None, None), (None, ""), (10**9, text), (10**9 + 1, text + " token=abcdefgh1234 more words here"), (10**9 + 2, "-----BEGIN PRIVATE KEY-----\nMIIabc\n-----END PRIVATE KEY----- end")], "doc_id long, text string")
    return rows.unionByName(odd, allowMissingColumns=True)


def test_stages(spark, docs):
    now, labels = docs, {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [r.asDict() for r in now.collect()]
        out = corpus_pipeline.save(stage(spark, now, SF), "test")
        after = [r.asDict() for r in out.collect()]
        assert out.columns == docs.columns, name
        if name == "secrets":
            assert len(after) == len(before) and not any("MIIabc" in (r["text"] or "") or "abcdefgh1234" in (r["text"] or "") for r in after)
            assert all(not r.spans for r in secrets.find_secrets(out.select("doc_id", "text"), ["doc_id"], secrets.HIDDEN).collect())
        else:  # rows are dropped whole
            left = Counter(map(str, before)) - Counter(map(str, after))
            assert not Counter(map(str, after)) - Counter(map(str, before))
            gone = [r for r in before if str(r) in left]
        if name == "toxicity":
            assert sum(labels.get(r["doc_id"], 0) for r in gone) >= 0.5 * len(gone)
        if name == "near copies":
            texts = [set(near.shingles(r["text"], 5)) for r in after]
            for r in gone:
                own = set(near.shingles(r["text"], 5))
                assert any(r["text"] == a["text"] for a in after) or not own or max(len(own & s) / len(own | s) for s in texts) > 0.6
            assert len({r["text"] for r in after}) == len(after)
        now = out


def test_toxicity_stage_equals_scores(spark, docs):
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    plain = toxicity.score(docs, model, ["doc_id", "text"]).where("predicted = 0")
    assert Counter((r.doc_id, r.text) for r in plain.collect()) == Counter((r.doc_id, r.text) for r in toxicity.drop_toxic(docs, model).collect())


def test_run_gives_ids_of_what_is_kept(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.save(stage(spark, now, SF), "test")
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, zlib.crc32(np.array(coder.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for r in now.collect())
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    got = Counter((i, zlib.crc32(np.array([x for _, ids in sorted(p) for x in ids], "<u4").tobytes())) for i, p in pieces.items())
    assert got == want


def test_empty_tables(spark, docs):
    now = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
