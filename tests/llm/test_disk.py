"""What the n-gram join and the pipeline leave on disk while they run."""

import os
import random

import numpy as np

import corpus_pipeline
from tessera.llm import ngram_join

from .cases import by_id, edited, frame, words, written
from .test_pairs_and_strings import groups, shingle_sets


def test_nodes_of_a_large_component_are_written_once(spark, monkeypatch):
    rng = random.Random(4)
    base = words(rng, 100)
    values = [edited(rng, base, rng.randint(0, 6)) for _ in range(120)]
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    seen, staged = [], ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, kind: seen.append((kind, staged(df, kind))) or seen[-1][1])
    found = by_id(ngram_join.ngram_components(frame(spark, values)))
    packs = [r for kind, df in seen if kind == "packs" for r in df.collect()]
    nodes = np.concatenate([np.frombuffer(r["node"], np.int64) for r in packs])
    assert len(packs) > 4 and len(nodes) == len(set(nodes.tolist()))
    assert {i: r["component_id"] for i, r in found.items()} == groups(range(len(values)), shingle_sets(values))


def test_shuffle_files_of_heavy_steps_are_let_go(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ngram_join, "free", calls.append)
    ngram_join.ngram_components(frame(spark)).count()
    assert not calls
    monkeypatch.setattr(ngram_join, "HEAVY", 0)
    ngram_join.ngram_components(frame(spark)).count()
    assert len(calls) == 3


def test_the_pipeline_keeps_no_table_that_is_read_no_more(spark, monkeypatch, tmp_path):
    folder = written(tmp_path, documents=frame(spark))
    made, staged = [], corpus_pipeline.staged
    monkeypatch.setattr(corpus_pipeline, "staged", lambda df, kind: made.append(staged(df, kind)) or made[-1])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(x, lambda spark, docs, sf_dir: docs) for x in "abcd"])
    out = corpus_pipeline.run(spark, folder)
    assert [os.path.exists(x.staged_at.removeprefix("file:")) for x in made] == [False, False, True]
    assert out.count() == frame(spark).count()
