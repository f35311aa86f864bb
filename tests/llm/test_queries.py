"""The opN queries themselves, over tables with null, repeated and awkward rows, against plain Python, the libraries and DuckDB."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bpe, decontaminate, language_id, ngram_join, spotsigs, substring_dedup, token_records, toxicity, url_filter
from tessera.llm.queries import QUERIES

from .cases import texts, words, written
from .test_pairs_and_strings import removed

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    """(doc_id, text, lang): a null id, a repeated one with equal texts and one with different texts among others."""
    rng = random.Random(12)
    values = texts()
    out = [(7 * k - 20, t) for k, t in enumerate(values)] + [(None, words(rng, 30)), (1000, values[6]), (1000, values[6]), (1007, "a b c d e f"), (1007, "z y x " * 9)]
    langs = ["aa", "bb", None]
    return [(i, t, langs[k % 3]) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = rows()
    docs = spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "x", 1) for i, t, g in base], "doc_id long, text string, lang string, source string, n_chars long, ids string, block int")
    labels = spark.createDataFrame([(i, 1, int(k % 2)) for k, (i, _, _) in enumerate(base)], "doc_id long, quality int, toxic int")
    long = base[17][1].split(" ")
    bench = spark.createDataFrame([(1, " ".join(long[500:530])), (2, None), (3, "one"), (None, "ein wort"), (4, "In in in in IN in in in in in")], "item_id long, text string")
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate([None, "", "http://a.com/en/1", "http://b.net/de/2", "http://q.org/x", "http://q.org/x"])], "page_id long, url string, html string")
    return written(tmp_path_factory.mktemp("tables"), documents=docs.repartition(3), labels=labels, benchmark=bench, pages=pages)


def ordered(base):
    return sorted(base, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def key(x):
    return tuple((v is None, 0 if v is None else v) for v in x)


def test_all_queries_return_their_columns(spark, folder):
    expected = {
        "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op3_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op4_spotsigs": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op5_substring_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op7_url_filter": "page_id bigint, host string, path string, rule string, verdict string, score double",
        "op8_token_records": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op10_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    }
    for name, columns in expected.items():
        found = QUERIES[name](spark, folder)
        assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == columns, name
        assert found.count() == (6 if name == "op7_url_filter" else len(rows())), name


def test_op1_scores_follow_the_labels_that_it_may_learn_from(spark, tmp_path):
    rng = random.Random(3)
    bad = ["wretchedfool", "grumblescum", "vilething"]
    spoil = lambda t: " ".join([*t.split(" ")[:9], rng.choice(bad), *t.split(" ")[9:], rng.choice(bad)])
    docs = [(i, spoil(words(rng, 60)) if i % 3 == 0 else words(rng, 60)) for i in range(400)] + [(None, "x"), (400, None), (401, "")]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(400)]
    held = {i for i in range(402) if zlib.crc32(str(i).encode()) % 3 == 1}
    folder = written(tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, folder).collect()}
    assert all(r["held_out"] == (i in held) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in found.items())
    right = [found[i]["predicted"] == int(i % 3 == 0) for i in sorted(held) if i < 400]
    assert np.mean(right) > 0.97
    # other labels of held-out rows change nothing: they aren't learnt from
    other = written(tmp_path / "other", documents=spark.createDataFrame(docs, "doc_id long, text string"), labels=spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["score"] for r in toxicity.op1_toxicity(spark, other).collect()} == {i: r["score"] for i, r in found.items()}


def test_op3_and_op10_equal_their_sql(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    # for SQL, rows of one id are not one document, and a long text's list of words goes with each of its windows: both stay out
    ids = Counter(i for i, _, _ in rows())
    some = [i for i, t, _ in rows() if ids[i] == 1 and i is not None and len(t or "") < 20000]
    for name, query, sql in (("op3", decontaminate.op3_decontamination, decontaminate.OP3_SQL), ("op10", ngram_join.op10_ngram_join, ngram_join.OP10_SQL)):
        kept = spark.read.parquet(f"{folder}/documents.parquet").filter(f"doc_id in ({', '.join(map(str, some))})")
        place = f"{folder}/{name}"
        kept.write.parquet(f"{place}/documents.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{place}/benchmark.parquet")
        for t in ("documents", "benchmark"):
            duckdb.sql(f"create or replace view {t} as select * from read_parquet('{place}/{t}.parquet/*.parquet')")
        expected = duckdb.sql(sql)
        found = query(spark, place)
        assert sorted(expected.columns) == sorted(found.columns)
        theirs = sorted(tuple(dict(zip(expected.columns, r))[c] for c in found.columns) for r in expected.fetchall())
        assert sorted(tuple(r) for r in found.collect()) == theirs
    hit = {r["doc_id"]: r for r in decontaminate.op3_decontamination(spark, folder).collect()}
    assert hit[15]["n_hit"] == 2 and hit[15]["n_items"] == 0  # an item without an id hits, but has no name


def spotsigs_of(text):
    """Signatures as tuples of words, by the rule as it is stated."""
    anchors, w = set(spotsigs.ANCHORS), WORDS.findall((text or "").translate(LOW))
    content, out = [i for i, x in enumerate(w) if x not in anchors], set()
    for i, x in enumerate(w):
        if x in anchors or not any(y in anchors for y in w[max(0, i - spotsigs.REACH + 1) : i + 1]):
            at = bisect.bisect_right(content, i)
            out.add((x, *[w[k] for k in content[at : at + spotsigs.CHAIN]]))
    return out


def test_op4_equals_spotsigs_by_hand(spark, folder):
    near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    base = ordered(rows())
    expected = []
    for k, (i, t, _) in enumerate(base):
        t, n = t or "", base[(k + 1) % len(base)][1] or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), len(spotsigs_of(t)), round(near(spotsigs_of(t), spotsigs_of(e)), 9), round(near(spotsigs_of(t), spotsigs_of(n)), 9)))
    found = [(r["doc_id"], r["n_chars"], r["edited_sha256"], len(r["fingerprint"]) // 10, round(r["near_edited"], 9), round(r["near_next"], 9)) for r in spotsigs.op4_spotsigs(spark, folder).collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_op5_equals_brute_force(spark, folder):
    base = rows()
    tag = lambda t: zlib.crc32((t or "").encode()) & (1 << substring_dedup.TAG_BITS) - 1
    one = sorted({(i, t) for i, t, _ in base}, key=lambda r: (r[0] is not None, r[0] or 0, tag(r[1])))
    known = dict(zip(one, removed([t for _, t in one])))
    expected = sorted(((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, t, _ in base for n, gone, spans, kept in [known[i, t]]), key=key)
    assert sorted((tuple(r) for r in substring_dedup.op5_substring_dedup(spark, folder).collect()), key=key) == expected


def grams(text):
    x = "".join(c if c.isalpha() else " " for c in text.lower())
    if not x.strip(" "):
        return Counter()
    x = " " + " ".join(x.split(" ")) + " "
    x = re.sub(" +", " ", x)
    return Counter(x[i : i + n] for n in range(1, 5) for i in range(len(x) - n + 1) if x[i : i + n] != " ")


def profile(counts):
    code = lambda g: sum((ord(c) & 0xFFFF) << 16 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: language_id.TOP]]


def test_op6_equals_out_of_place_distances(spark, folder):
    base = rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    total = {}
    for i, t, g in base:
        if g and t is not None and not held(i):
            total.setdefault(g, Counter()).update(grams(t))
    place = {g: {x: k for k, x in enumerate(profile(c))} for g, c in total.items()}
    expected = []
    for i, t, _ in base:
        own = profile(grams(t or ""))
        if not own:
            expected.append((i, held(i), "und", 0.0))
            continue
        far = {g: sum(abs(p[x] - k) if x in p else language_id.TOP for k, x in enumerate(own)) for g, p in place.items()}
        best = min(sorted(far), key=far.get)
        expected.append((i, held(i), best, round(1 - far[best] / (language_id.TOP * len(own)), 9)))
    found = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language_id.op6_language_id(spark, folder).collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_op7_rows(spark, folder):
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.op7_url_filter(spark, folder).filter("rule is not null").collect())
    assert found == [(2, "a.com", "/en/1", "com/en/", "block"), (3, "b.net", "/de/2", "net/de/", "allow")]
    rest = {r["page_id"]: (r["verdict"], r["score"]) for r in url_filter.op7_url_filter(spark, folder).filter("rule is null").collect()}
    assert rest[4] == rest[5] and rest[0] == rest[1] and all(v in ("allow", "block") for v, _ in rest.values())


def test_op8_equals_the_library(spark, folder):
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coded = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u2").tobytes()) for i, t, _ in rows()]
    start, expected = 0, []
    for i, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        expected.append((i, start, len(ids) // 2, zlib.crc32(wide)))
        start += len(ids) // 2
    assert sorted((tuple(r) for r in token_records.op8_token_records(spark, folder).collect()), key=key) == sorted(expected, key=key)


def test_op9_equals_the_library(spark, folder):
    P = pytest.importorskip("public_tokenizers")
    library = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows() for ids in [library.encode_ordinary(t or "")]]
    assert sorted((tuple(r) for r in bpe.op9_byte_bpe(spark, folder).collect()), key=key) == sorted(expected, key=key)
