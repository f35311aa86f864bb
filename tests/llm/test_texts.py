"""Encoders, fingerprints, models, filters and the pipeline on the awkward documents."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, language_id, line_dedup, spotsigs, token_records, toxicity, url_filter
from tessera.llm.common import range_blocks

from .cases import by_id, frame, texts, words, written


def public():
    return pytest.importorskip("public_tokenizers")


def test_byte_bpe_round_trip(spark, monkeypatch):
    P = public()
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    values = [*texts(), "x" * 3000 + " y" * 3000, " " * 5000 + "end"]
    whole = [bpe.encoding(ranks, P.PATTERN).encode_ordinary(t or "") for t in values]
    monkeypatch.setattr(bpe.parts, "__defaults__", (100,))
    df = bpe.unpack(bpe.decode(bpe.encode(frame(spark, values), ranks, P.PATTERN), ranks, P.PATTERN))
    for i, r in by_id(df).items():
        assert list(r["id_array"]) == whole[i]
        assert bytes(r["decoded"]) == (values[i] or "").encode()
    assert all("".join(bpe.parts(t, 7)) == t for t in values if t)


def test_token_records_equal_the_library_and_hold_order(spark, tmp_path):
    from tokenizers import Tokenizer

    P = public()
    file = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    values = [*texts(), "ÀÉ Straße ﬁ İstanbul ΣΑΣ e\u0301 \u00a0x\u2003y don't DON'T we'll; a.b, ...", "\x1c a\x1fb"]
    ids = [3 * k - 5 for k in range(len(values))]
    blocks = 5
    folder = f"file://{tmp_path}/records"
    docs = range_blocks(frame(spark, values, ids), "doc_id", blocks)
    files = token_records.write_records(token_records.encode_words(docs, file), folder, token_records.words(file).width, blocks)
    found = by_id(token_records.read_records(files, folder))
    start = 0
    for i, t in zip(ids, values):
        expected = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        r = found[i]
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == expected, t
        assert (r["start"], r["n_tokens"]) == (start, len(expected))
        start += len(expected)
    damaged = next(tmp_path.glob("records/*.rec"))
    data = bytearray(damaged.read_bytes())
    data[30] ^= 1
    damaged.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        token_records.read_records(files, folder).collect()


def test_words_are_encoded_as_by_the_library(monkeypatch):
    """Specials, letters that grow in lower case, combining marks, apostrophes, digits and all kinds of space, in random order."""
    from tokenizers import Tokenizer

    P = public()
    file = P.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(file), random.Random(8)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "İ", "İ..", "İ!?", "\u0307", "e\u0301", "\u0323\u0307", "\u1100\u1161", "ß", "Σ", "ΑΣ", "ﬁ", "ª", "ǅ", "'s", "'LL", "'", "don't", "Word", "WORDS.", "a.b", "x,", "...", "!?", "12", "٣", "²", "日本", "\U0001f600", "\u200d", "\u00ad"]
    pieces += [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\u0085", "\x0b", "\x1c", "\x1f", "\u200b", "\ufeff", "\x00"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    known = token_records.Words(file)
    monkeypatch.setattr(token_records, "CACHE_WORDS", 3000)
    for t in values:
        assert np.frombuffer(known.encode(t), f"<u{known.width}").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("tree", [512, 0])
def test_range_blocks_rise_with_the_key(spark, monkeypatch, tree):
    monkeypatch.setattr(common, "TREE_BOUNDS", tree)
    df = spark.createDataFrame([(i % 50 if i % 7 else None,) for i in range(400)], "k long")
    rows = range_blocks(df, "k", 6).groupBy("block").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    assert len(rows) == 6 and all(x["b"] < y["a"] for x, y in zip(rows, rows[1:]))


def test_spotsigs_of_edited_texts(spark, tmp_path):
    values = [t for t in texts()]
    ids = [7 * k for k in range(len(values))]
    folder = written(tmp_path, documents=frame(spark, values, ids))
    found = by_id(spotsigs.op4_spotsigs(spark, folder))
    whole = [t or "" for t in values]
    sets = [set(x.tolist()) for x in spotsigs.signatures(whole)]
    near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, i in enumerate(ids):
        t, n = whole[k], whole[(k + 1) % len(whole)]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r["near_next"] - near(sets[k], sets[(k + 1) % len(sets)])) < 1e-12
        assert abs(r["near_edited"] - near(sets[k], set(spotsigs.signatures([e])[0].tolist()))) < 1e-12
    prints = by_id(spotsigs.fingerprints(frame(spark, values)))
    assert prints[6]["fingerprint"] == prints[7]["fingerprint"] == prints[8]["fingerprint"] != prints[9]["fingerprint"]


def test_spotsigs_of_one_and_no_document(spark, tmp_path):
    one = written(tmp_path / "one", documents=frame(spark, ["alone in the house"]))
    assert [r["near_next"] for r in spotsigs.op4_spotsigs(spark, one).collect()] == [1.0]
    none = written(tmp_path / "none", documents=frame(spark, []))
    assert spotsigs.op4_spotsigs(spark, none).collect() == []


def test_language_profiles(spark):
    rng = random.Random(1)
    kinds = {"aa": ["kala", "mina", "pori", "suvi"], "bb": ["thwash", "brick", "strong", "gripth"]}
    say = lambda lang, n: " ".join(rng.choice(kinds[lang]) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    profiles = language_id.learn(spark.createDataFrame(rows + [(99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    tests = [say("aa", 5), say("bb", 5).upper(), None, "", "12 34 !!", "\U0001d4d0 kala", "日本"]
    found = [(r["lang_pred"], r["score"]) for r in language_id.predict(frame(spark, tests), profiles).orderBy("doc_id").collect()]
    assert [x for x, _ in found[:6]] == ["aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= s <= 1 for _, s in found) and found[2][1] == 0
    assert {r["lang_pred"] for r in language_id.predict(frame(spark, tests), language_id.learn(frame(spark, []))).collect()} == {"und"}


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x://y/z", "ftp://com/en/", "http://xcom/en/1", "https://www.a.net/de/8/..", "https://example.net/de/81#t", "http://b.org/es/?q", "http://b.org?x=/es/", "a://b://c/d", "http://é.com/en/ü\nx"]


def test_url_rules_hosts_and_paths(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    found = [(r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else "") for r in url_filter.judge(df).orderBy("page_id").collect()]
    assert found == [
        *[("", "", None, "")] * 4,
        ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("com", "/en/", "com/en/", "block"),
        ("xcom", "/en/1", None, ""),
        ("www.a.net", "/de/8/..", "net/de/", "allow"),
        ("example.net", "/de/81", "example.net/de/8", "block"),
        ("b.org", "/es/", "org/es/", "block"),
        ("b.org", "", None, ""),
        ("b:", "//c/d", None, ""),
        ("é.com", "/en/ü\nx", "com/en/", "block"),
    ]
    assert url_filter.judge(df.limit(0)).collect() == []


def test_url_models_follow_the_rules(spark):
    rng = random.Random(2)
    rows = [(f"http://{words(rng, 1)}.com/en/{words(rng, 1)}",) for _ in range(300)] + [(f"http://{words(rng, 1)}.net/de/{words(rng, 1)}",) for _ in range(300)]
    rows += [(f"http://{words(rng, 1)}.dom/en/{words(rng, 1)}",) for _ in range(60)] + [(f"http://{words(rng, 1)}.bet/de/{words(rng, 1)}",) for _ in range(60)]
    found = url_filter.judge(spark.createDataFrame(rows, "url string")).filter("rule is null").collect()
    right = sum((r["verdict"] == "block") == ("/en/" in r["url"]) for r in found)
    assert len(found) == 120 and right >= 110


def test_url_models_count_exactly(spark):
    """Scores are those of plain counts, where the n-grams are many and a block of URLs is one of several."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-é") for _ in range(rng.randint(8, 30)))
    urls = [f"http://{word()}.{rng.choice(['com/en', 'net/de', 'dom/en', 'bet/de'])}/{word()}" for _ in range(5000)] + ["http://HOT.com/en/1"] * 40 + [None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    site = F.lower(F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://", ""))
    rows = url_filter.ruled(df, "url").select("page_id", "ruling", site.alias("site"), (F.pmod(F.xxhash64(F.lit("calibrate"), site), F.lit(url_filter.HOLD)) == 0).alias("kept")).collect()
    n = {v: Counter() for v in ("allow", "block")}
    fold = lambda text: [0] * 5 + [x + 1 for x in text.encode()] + [0]
    for r in rows:
        if r["ruling"] and not r["kept"]:
            x = fold(r["site"])
            for i in range(5, len(x)):
                for k in range(6):
                    n[r["ruling"]][(k, *x[i - k : i + 1])] += 1
                    n[r["ruling"]][("context", k, *x[i - k : i])] += 1

    def chance(counts, x, i):
        p = 1 / 257
        for k in range(6):
            p = (counts[(k, *x[i - k : i + 1])] + 3 * p) / (counts[("context", k, *x[i - k : i])] + 3)
        return p

    found = {r["page_id"]: r["score"] for r in url_filter.judge(df).collect()}
    assert len(found) == len(urls)
    for r in rows:
        x = fold(r["site"])
        each = [math.log(chance(n["block"], x, i)) - math.log(chance(n["allow"], x, i)) for i in range(5, len(x))]
        assert found[r["page_id"]] == pytest.approx(sum(each) / len(each), abs=1e-9)


def test_toxicity_finds_misspelt_words_in_long_texts(spark):
    rng = random.Random(3)
    bad = ["wretchedfool", "grumblescum", "vilething"]
    spoil = lambda t, n: " ".join([*(p := t.split(" "))[: len(p) // 2], *(rng.choice(bad) for _ in range(n)), *p[len(p) // 2 :]])
    values = [words(rng, rng.randint(10, 200)) for _ in range(300)]
    marks = [int(i % 3 == 0) for i in range(300)]
    values = [spoil(t, 2) if m else t for t, m in zip(values, marks)]
    labels = spark.createDataFrame([*enumerate(marks), (5, None), (None, 1), (999, 1), (7, 5), (8, -1)], "doc_id long, toxic int")
    model = toxicity.learn(toxicity.sample(frame(spark, values), labels))
    tests = [words(rng, 3000) + " wretchedfoools " + words(rng, 3000), words(rng, 300), None, "", "...", "vilethings"]
    found = [r["score"] for r in toxicity.score(frame(spark, tests), model).orderBy("doc_id").collect()]
    assert found[0] > 0.7 > found[1] and found[2] == found[3] == found[4] and found[5] > 0.7
    assert all(0 <= s <= 1 for s in found)
    assert {r["score"] for r in toxicity.score(frame(spark, tests), toxicity.learn([])).collect()} == {0.0}


def test_line_dedup_by_site(spark):
    rows = [(i, "head\n  menu  \n" + f"line {i}\n\nfoot", "big") for i in range(20)] + [(100 + i, "menu\nbody", None) for i in range(12)] + [(200, "menu\nfoot", "small"), (201, None, "big"), (202, "", "big"), (203, "menu", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = by_id(line_dedup.drop_boilerplate(docs, n_lines="n", n_dropped="d"))
    assert (found[3]["text"], found[3]["n"], found[3]["d"]) == ("line 3\n", 5, 3)
    assert (found[101]["text"], found[101]["d"]) == ("", 2)
    assert found[200]["text"] == "menu\nfoot" and found[201]["text"] is None and (found[201]["n"], found[201]["d"]) == (0, 0)
    assert found[202]["text"] == "" and found[203]["text"] == ""
    assert line_dedup.drop_boilerplate(docs.limit(0)).collect() == []


@pytest.mark.parametrize("pages", [5, 20, 50])
def test_line_dedup_of_small_sites(spark, pages):
    """Boilerplate of a site of a few pages goes; what a page and its copy share stays, where the ratio or the floor lets it."""
    rows = [(i, f"home menu\nown line {i}\n  home menu", "small") for i in range(pages)] + [(1000 + i, "two\nthe same", "copies") for i in range(2)]
    found = by_id(line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert {found[i]["text"] for i in range(pages)} == {f"own line {i}" for i in range(pages)}
    assert found[1000]["text"] == found[1001]["text"] == "two\nthe same"


@pytest.mark.parametrize("rows", [line_dedup.BROADCAST_ROWS, 0])
def test_line_dedup_equals_sql(spark, tmp_path, monkeypatch, rows):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    rng = random.Random(4)
    some = [words(rng, 3) for _ in range(12)] + ["", "  "]
    docs = [(i, None if i % 50 == 0 else "\n".join(rng.choice(some[: 4 + i % 10]) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9))), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    folder = written(tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string, source string"))
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    found = line_dedup.op2_line_dedup(spark, folder)
    expected = duckdb.sql(line_dedup.OP2_SQL)
    pick = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(tuple(r[c] for c in pick) for r in found.collect()) == sorted(tuple(dict(zip(expected.columns, r))[c] for c in pick) for r in expected.fetchall())


def test_held_out_rows_are_those_of_the_checksum(spark):
    from tessera.llm.common import held_out

    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("out", held_out()).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
