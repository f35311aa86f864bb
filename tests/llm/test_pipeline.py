"""The pipeline on planted cases: each stage's decision takes effect, clean documents stay."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline

from .cases import edited, words, written


def planted(spark, folder):
    rng = random.Random(9)
    bad = ["wretchedfool", "grumblescum", "vilething"]
    docs, labels = [], []
    clean = {}
    for i in range(240):
        t = words(rng, 130 if i == 1 else rng.randint(40, 120))
        if i % 4 == 0:
            t += " " + " ".join(rng.choice(bad) for _ in range(3))
        else:
            clean[i] = t
        docs.append((i, t))
        labels.append((i, 1, int(i % 4 == 0)))
    passage = words(rng, 40)
    docs.append((1000, words(rng, 50) + " " + passage + " " + words(rng, 50)))
    docs += [(1001 + k, edited(rng, clean[1], k)) for k in range(3)] + [(1010, clean[2]), (1011, None), (1012, "")]
    docs = [(i, t if t is None else "site menu home\n" + t, "en", "s0", 0, "x") for i, t in docs]
    return written(
        folder,
        documents=spark.createDataFrame(docs + docs[1:2], "doc_id long, text string, lang string, source string, n_chars long, ids string"),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string"),
    ), clean, passage


def test_pipeline_on_planted_cases(spark, tmp_path):
    folder, clean, passage = planted(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != "byte_bpe":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    assert set(clean) <= ids["toxicity"] and not {i for i in range(0, 240, 4)} & ids["toxicity"]
    assert ids["line_dedup"] == ids["toxicity"] and not any("site menu" in (r["text"] or "") for r in seen["line_dedup"])
    assert ids["near_copies"] == ids["line_dedup"] - {1001, 1002, 1003, 1010}
    assert len(seen["near_copies"]) == len(ids["near_copies"])
    assert ids["decontamination"] == ids["byte_bpe"] == ids["near_copies"]
    texts = {r["doc_id"]: r["text"] for r in seen["byte_bpe"]}
    assert passage.split(" ")[20] not in (texts[1000] or "").split(" ") and len(texts[1000].split()) == 100
    assert all(texts[i] == t for i, t in clean.items())
    for r in seen["byte_bpe"]:
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256").collect()}
    assert whole == {r["doc_id"]: r["ids_sha256"] for r in seen["byte_bpe"]}


def test_pipeline_of_no_documents(spark, tmp_path):
    folder, _, _ = planted(spark, tmp_path / "some")
    empty = tmp_path / "none"
    written(empty, **{t: spark.read.parquet(f"{folder}/{t}.parquet").filter(F.lit(False)) for t in ("documents", "labels", "benchmark")})
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
