"""The n-gram join, removal of repeated strings, and decontamination against brute force."""

import re
import zlib

import numpy as np
import pytest

from tessera.llm import decontaminate, ngram_join, substring_dedup
from tessera.llm.components import components

from .cases import by_id, edited, frame, texts, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_sets(values):
    out = []
    for t in values:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def groups(ids, sets):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, sets):
        for j, b in zip(ids, sets):
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_ngram_components_equal_brute_force(spark):
    values = texts()
    found = by_id(ngram_join.ngram_components(frame(spark, values)))
    sets = shingle_sets(values)
    expected = groups(range(len(values)), sets)
    for i, s in enumerate(sets):
        assert (found[i]["n_shingles"], found[i]["component_id"]) == (len(s), expected[i])


@pytest.mark.parametrize("few", [40, 2])
def test_ngram_components_of_a_large_group_of_near_copies(spark, monkeypatch, few):
    import random

    rng = random.Random(3)
    base = words(rng, 100)
    values = [edited(rng, base, rng.randint(0, 6)) for _ in range(150)] + [words(rng, 60) for _ in range(20)]
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 16)
    found = by_id(ngram_join.ngram_components(frame(spark, values)))
    expected = groups(range(len(values)), shingle_sets(values))
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert len(set(expected.values())) > 21


def test_ngram_join_null_and_repeated_ids_and_no_rows(spark):
    t = "a b c d e f g"
    rows = ngram_join.ngram_components(frame(spark, [t, t, t, "x y", None], [4, 4, None, 9, 2])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows) == [(False, 2, 0, 2), (False, 4, 3, 4), (False, 4, 3, 4), (False, 9, 1, 9), (True, 0, 3, None)]
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []


def test_every_linked_pair_shares_a_signature():
    """PartEnum's promise, over random pairs at the very threshold."""
    rng = np.random.default_rng(1)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            both = (8 * size + 8) // 9 if size > 4 else size
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = np.concatenate((a[:both], rng.integers(0, 1 << 63, size - both, dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            i = len(np.intersect1d(a, b))
            if 100 * i >= 80 * (len(a) + len(b) - i):
                shared = set(ngram_join.signatures(a).tolist()) & set(ngram_join.signatures(b).tolist())
                assert len(shared) >= 1
                if min(ngram_join.needed(a), ngram_join.needed(b)) > 1:
                    assert len(shared) >= max(ngram_join.needed(a), ngram_join.needed(b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


def removed(values):
    seen, out = set(), []
    for t in values:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1]))
        out.append((len(b), sum(mark), spans, bytes(x for x, m in zip(b, mark) if not m)))
    return out


def test_repeated_strings_equal_brute_force(spark, monkeypatch):
    values = texts()
    values += [values[17][1000:1099], values[17][1000:1100], "ab" * 400, "ab" * 60, "x" + values[13] + "y" + values[13]]
    monkeypatch.setattr(substring_dedup, "HELD", 500)
    found = by_id(substring_dedup.remove_repeats(frame(spark, values)))
    for i, (n, gone, spans, kept) in enumerate(removed(values)):
        r = found[i]
        assert (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) == (n, gone, spans, kept), i


def test_repeated_strings_follow_ids_and_bear_odd_rows(spark):
    t = words(__import__("random").Random(1), 40)
    found = {(r["doc_id"], len(r["kept"])) for r in substring_dedup.remove_repeats(frame(spark, [t, t, t, t, None], [5, -3, 5, 9, None])).collect()}
    assert found == {(5, 0), (-3, len(t)), (9, 0), (None, 0)}
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_repeated_strings_of_repeated_rows(spark, monkeypatch, parts):
    """Equal rows are one document, however they are dealt; rows of one id and different texts are documents of their own."""
    rng = __import__("random").Random(2)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(5, a), (5, a), (5, a), (7, b + a[20:170]), (7, b + a[20:170]), (2, c), (None, c), (None, c), (9, b), (9, c[:150]), (9, b)]
    monkeypatch.setattr(substring_dedup, "HELD", 200)
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(parts)
    one = sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0], zlib.crc32(r[1].encode()) & (1 << substring_dedup.TAG_BITS) - 1))
    expected = {key: kept for key, (_, _, _, kept) in zip(one, removed([t for _, t in one]))}
    found = substring_dedup.remove_repeats(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["kept"])) for r in found) == sorted((i is None, i or 0, expected[i, t]) for i, t in rows)
    assert expected[5, a] == a.encode() and len(expected[7, b + a[20:170]]) == len(b)


def test_phrases_of_a_long_text_do_not_depend_on_the_chunks(spark, monkeypatch):
    rng = __import__("random").Random(4)
    one = words(rng, 3000)
    values = [one, words(rng, 10) + one[50:9000] + words(rng, 10)]
    monkeypatch.setattr(substring_dedup, "CHUNK", 4096)
    found = by_id(substring_dedup.remove_repeats(frame(spark, values)))
    for i, (_, _, _, kept) in enumerate(removed(values)):
        assert bytes(found[i]["kept"]) == kept


def test_the_last_window_of_a_text_just_short_of_chunks_counts(spark, monkeypatch):
    rng = __import__("random").Random(7)
    monkeypatch.setattr(substring_dedup, "CHUNK", 4096)
    end = words(rng, 60)[:100]
    for n in (4195, 4196, 4197):
        one = words(rng, 2000)[: n - 100] + end
        values = [one, words(rng, 20) + end + words(rng, 20)]
        assert len(one) == n
        found = by_id(substring_dedup.remove_repeats(frame(spark, values)))
        for i, (_, _, _, kept) in enumerate(removed(values)):
            assert bytes(found[i]["kept"]) == kept, (n, i)


def brute_hits(values, items, width=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    window = {}
    for name, t in items:
        w = pattern.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            names = window.setdefault(tuple(w[k : k + width]), set())
            if name is not None:
                names.add(str(name))
    out = []
    for t in values:
        w, hit, names = pattern.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in window}:
            for k in range(len(w) - n + 1):
                if (found := window.get(tuple(w[k : k + n]))) is not None:
                    names |= found
                    hit.update(range(k, k + n))
        out.append((len(w), hit, sorted(names)))
    return out


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    values = texts()
    long = values[17].split(" ")
    items = [(1, " ".join(long[500:530])), (1, " ".join(long[510:545])), (2, values[6].upper()), (3, "one"), (4, None), (5, ""), (6, "?!"), (None, "ein wort"), (7, " ".join(long[39990:])), (8, values[9]), (9, "in in in in in in in in in in in in")]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 20000)
    monkeypatch.setattr(decontaminate, "LONG_SHARD_BYTES", 20000)
    docs, bench = frame(spark, values), spark.createDataFrame(items, "item_id long, text string")
    found = by_id(decontaminate.contamination(docs, bench))
    cut = by_id(decontaminate.decontaminate(docs, bench))
    assert cut[0].asDict().keys() == {*docs.columns}
    for i, (n, hit, names) in enumerate(brute_hits(values, items)):
        r = found[i]
        assert (r["__words"], {k for x in r["__hits"] for k in range(x["start"], x["end"])}, r["__items"]) == (n, hit, names)
        left = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (cut[i]["text"] or "").translate(LOW))
        assert len(left) == n - len(hit) and (hit or cut[i]["text"] == values[i])


def test_decontamination_without_items_or_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["__items"] for r in decontaminate.contamination(frame(spark, ["a b"]), bench).collect()] == [[]]
    assert decontaminate.contamination(frame(spark, []), bench).collect() == []


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    text = np.concatenate(([0], *[np.append(rng.integers(1, 5, n), 0) for n in (3, 50, 1, 200)]))
    index = decontaminate.FMIndex(text, 4)
    for n in (1, 2, 3, 5):
        for at in range(1, len(text) - n):
            w = text[at : at + n]
            if (w > 0).all():
                low, high = index.search(np.pad(w, (0, 5 - n))[None, :])
                places = index.locate(np.arange(low[0], high[0]))
                assert sorted(places) == [k for k in range(len(text) - n + 1) if (text[k : k + n] == w).all()]
    assert index.search(np.array([[1, 1, 1, 1, 1, 2, 2, 2, 2, 2]]))[1] >= 0

