"""Collocations, the conversation trie and WARC archives, against plain Python, DuckDB and round trips, with awkward rows."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations, conversation_trie, warc
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.radix_tree import RadixTree

from .cases import written

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sql(folder, table, name):
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = connection.sql(ORACLE_SQL[name])
    return sorted(str(dict(zip(sorted(found.columns), (r[found.columns.index(c)] for c in sorted(found.columns))))) for r in found.fetchall())


def by_query(df):
    return sorted(str({c: r[c] for c in sorted(df.columns)}) for r in df.collect())


# collocations


def plain_collocations(rows, top, least, longest, share):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        longer = Counter()
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and 100 * longer[p] < share * a:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def babble(seed, n, vocabulary):
    rng = random.Random(seed)
    glue = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n"]
    return ["".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_collocations_equal_a_plain_count(spark):
    texts = babble(1, 500, ["x", "y", "zé", "Foo", "bar", "q r s", "日本", "A\x00b"])
    rows = [((None, "und", "aa", "bb")[k % 4], t) for k, t in enumerate(texts)] + [("aa", None), ("cc", ""), ("aa", " . , ;"), ("dd", "one two three four five")] + [("dd", "one two three four five")] * 39
    df = spark.createDataFrame([(g, t, 1, "x", 2) for g, t in rows], "lang string, text string, n long, phrase string, words int")
    got = sorted(tuple(r) for r in collocations.collocations(df.repartition(3), top=15).collect())
    assert got == plain_collocations(rows, 15, 30, 4, 80)
    assert any(r[0] == "dd" and r[2] == "two three four five" for r in got)  # longer than 4 words: the ends of it stay
    assert {r[0] for r in got} == {"und", "aa", "bb", "dd"}


@pytest.mark.parametrize("batch, longest", [(8, 3), (40, 5)])
def test_collocations_grow_in_several_rounds(spark, monkeypatch, batch, longest):
    monkeypatch.setattr(collocations, "BATCH", batch)
    rows = [("aa", t) for t in babble(2, 120, ["x", "y", "z w"])]
    got = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), top=4, least=20, longest=longest).collect())
    assert got == plain_collocations(rows, 4, 20, longest, 80)


def test_collocations_leave_out_what_is_bounded_below_the_floor(spark, monkeypatch):
    """Two fixed phrases fill the list; the many pairs of very common words are bounded below them and are never grown."""
    grown = []
    taken = collocations._best

    def best(frontier, turn):
        found = taken(frontier, turn)
        grown.extend([] if found is None else [r["phrase"] for r in found.collect()])
        return found

    monkeypatch.setattr(collocations, "BATCH", 4)
    monkeypatch.setattr(collocations, "_best", best)
    rng = random.Random(4)
    rows = [("aa", "rare bird. odd fish")] * 40 + [("aa", " ".join(rng.choice("abcdefg") for _ in range(40))) for _ in range(60)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), top=2).collect()
    assert sorted(r["phrase"] for r in got) == ["odd fish", "rare bird"] and all(r["score"] == 1_000_000 for r in got)
    assert set(grown) == {"rare bird", "odd fish"}


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("aa", None), (None, "a b")], "lang string, text string")).count() == 0


def test_scores_of_counts_beyond_64_bits_of_product(spark):
    row = spark.createDataFrame([(9 * 10**17, 8 * 10**17, 10**18)], "a long, l long, r long").select(collocations._score("a", "l + r").alias("s")).first()
    assert row["s"] == 2_000_000 * 9 * 10**17 // (18 * 10**17)


def test_op11_equals_its_sql(spark, tmp_path):
    rows = [((None, "aa")[k % 2], t) for k, t in enumerate(babble(3, 300, ["x", "y", "zé", "Foo", "q r"]))] + [("aa", None)]
    folder = written(tmp_path, documents=spark.createDataFrame(rows, "lang string, text string"))
    assert by_query(QUERIES["op11_collocations"](spark, folder)) == by_sql(folder, "documents", "op11_collocations")


# the trie


def test_radix_tree_keeps_the_order_of_keys_through_all_layouts():
    rng = random.Random(6)
    keys = {bytes([a]) + bytes(rng.choices(range(3), k=rng.randrange(6))) for a in range(256) for _ in range(4)} | {b"", b"\x00", b"ab", b"abc", b"abd" * 50, b"abd" * 49 + b"x"}
    tree, seen = RadixTree(), set()
    for k in rng.sample(sorted(keys), len(keys)):
        tree.insert(k, k)
        seen.add(tree.root.places)
    walked = [(node.value, depth) for node, depth, done in tree.walk() if not done and node.value is not None]
    assert walked == [(k, len(k)) for k in sorted(keys)] and seen == {4, 16, 48, 256}
    assert all(len(list(node.children())) != 1 or node.value is not None or node is tree.root for node, _, done in tree.walk() if not done)  # one-way paths are compressed


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        members[c] = tuple(own.get(c - c % 20, [])[:h] + t[h:])
    nodes = defaultdict(list)
    for c, seq in members.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = Counter(), Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(members[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items())


def talk(seed, n, most=6):
    rng = random.Random(seed)
    say = ["hi", "Hi", "a b  c", "", None, "x\ty\nz", "é" * 9, "w " * 40]
    return [(c, rng.choice([None, 0, k, k]), rng.choice(["user", "bot", None]), rng.choice(say)) for c in rng.sample(range(3 * n), n) for k in range(rng.randrange(1, most))]


_TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("tree_keys, fan", [(1, 2), (3, 3), (4096, 256)])
def test_trie_equals_a_plain_one(spark, tree_keys, fan):
    rows = talk(8, 150) + [(None, 0, "user", "lost"), (1000, 0, "user", "hi")] + [(2000, k, "user", f"t{k}") for k in range(60)] + [(2020 + c, k, "user", f"t{k}") for c in range(30) for k in range(20 + c)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], _TALK + ", key string, n long").repartition(3)
    found = conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.turns(df)), tree_keys, fan)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]) == plain_trie(rows)


def test_trie_of_many_copies_and_of_lists_of_ids_in_parts(spark):
    rows = [(c, k, "user", "same") for c in range(0, 12000, 2) for k in (1, 2)]
    found = conversation_trie.prefix_trie(conversation_trie.turns(spark.createDataFrame(rows, _TALK)))
    got = {r["depth"]: r for r in found.collect()}
    assert [(got[d]["n_convs"], got[d]["conv_id"], got[d]["n_leaves"], got[d]["saved_tokens"]) for d in range(3)] == [(6000, 0, 1, 11998), (6000, 0, 1, 11998), (6000, 0, 1, 5999)]
    assert got[2]["ends_sha256"] == hashlib.sha256(",".join(str(c) for c in range(0, 12000, 2)).encode()).hexdigest()
    assert conversation_trie.prefix_trie(conversation_trie.turns(spark.createDataFrame([], _TALK))).count() == 0


def test_op12_equals_its_sql(spark, tmp_path):
    rows = sorted(set(talk(9, 80)), key=str)
    folder = written(tmp_path, conversations=spark.createDataFrame(rows, _TALK))
    assert by_query(QUERIES["op12_conversation_trie"](spark, folder)) == by_sql(folder, "conversations", "op12_conversation_trie")


# archives

INNER = warc.record("response", "urn:page:77", [("WARC-Payload-Digest", "sha1:X")], b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", "application/http").decode()
PAGES = "page_id long, url string, html string, file string, at long"


def pages(seed=1):
    rng = random.Random(seed)
    html = [None, "", "a", "a", "é" * 50, INNER, INNER * 3, "WARC/1.0\r\n", "x" * 5000 + INNER + "y" * 100, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n", "WARC/1.1\r\nFoo", "\r\n\r\n"]
    urls = ["http://a/%20 b\r\nX: y<>", "", None, "http://x/" + "é" * 300]
    out = [(k, rng.choice(urls), rng.choice(html)) for k in range(120)]
    return out + [(None, "u", "a"), (None, "u", "alone"), (3, "u", "q1"), (3, "u", "a"), (-5, None, "q1")]


@pytest.mark.parametrize("piece_bytes, file_bytes", [(300, 1 << 20), (5000, 20000), (warc.PIECE_BYTES, warc.FILE_BYTES)])
def test_archives_come_back_whole_whatever_payloads_hold(spark, tmp_path, piece_bytes, file_bytes):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(2)
    files = warc.write_warc(df, str(tmp_path), file_bytes=file_bytes)
    assert (files.count() > 2) == (file_bytes < 1 << 20) and files.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_warc(files, str(tmp_path), piece_bytes=piece_bytes).collect()
    first = defaultdict(list)
    for page, _, html in rows:
        first[html or ""] += [] if page is None else [page]
    key = lambda r: tuple((x is None, x or type(x)()) for x in r)
    expected = []
    for page, url, html in rows:
        least = min(first[html or ""], default=None)
        again = page != least
        data = (html or "").encode()
        expected.append((page, "revisit" if again else "response", least if again else None, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None if again else data))
    plain = [(*tuple(r)[:6], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(map(repr, plain)) == sorted(map(repr, expected)), key


def test_small_payloads_are_no_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    files = warc.write_warc(df, str(tmp_path), least=3)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(files, str(tmp_path)).collect()) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_a_broken_chain_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", "x" * 50) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(df, str(tmp_path))
    path = tmp_path / files.first()["file"]
    data = path.read_bytes()
    at = data.index(b"Content-Length", len(data) // 2)
    path.write_bytes(data[:at] + b"Content-length: 9" + data[at + 17 :])
    with pytest.raises(Exception, match="chain of records"):
        warc.verified(files, str(tmp_path), 500)
    path.write_bytes(data.replace(b"x" * 50, b"x" * 49 + b"y", 1))
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(files, str(tmp_path)).collect()


@pytest.mark.parametrize("read_bytes", [1, 7, 64, 1 << 20])
def test_candidates_don_t_depend_on_the_size_of_reads(monkeypatch, read_bytes):
    monkeypatch.setattr(warc, "READ_BYTES", max(read_bytes, len(warc.MAGIC)))
    data = b"".join(warc.record("response", f"urn:page:{k}", [("WARC-Target-URI", "u" * (90 * k))], (INNER * k).encode(), "x") for k in range(4))
    found = warc._candidates(io.BytesIO(data), len(data), 0, len(data))
    heads = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", data)]
    assert [at for at, _ in found] == heads and found[0][1] in heads
    middle = heads[3] + 1
    assert warc._candidates(io.BytesIO(data), len(data), 0, middle) + warc._candidates(io.BytesIO(data), len(data), middle, len(data)) == found
    stream = warc._Stream(io.BytesIO(data), 0)
    assert len(stream.take(int(stream.head()[b"content-length"]))) == 0


def test_op13_equals_its_sql(spark, tmp_path):
    folder = written(tmp_path, pages=spark.createDataFrame(pages(2), "page_id long, url string, html string"))
    assert by_query(QUERIES["op13_warc"](spark, folder)) == by_sql(folder, "pages", "op13_warc")
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none")).count() == 0


def test_hashes_are_summed_by_value():
    x = np.array([(5, 2), (3, 1), (5, 0xFFFFFFFF)], collocations._HASH)
    assert collocations._summed([x[:2], x[2:]]).tolist() == [(3, 1), (5, 0xFFFFFFFF)]
