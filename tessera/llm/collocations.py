"""Phrase collocations of each language, by best-first branch and bound over phrases that grow a word at a time.

A phrase of two to `longest` words counts from `least` occurrences on. Its score is the least over its cuts of
floor(2000000 * a / (l + r)), where a, l and r count the phrase and its two parts. It is dropped where a phrase a word longer
(and hence any longer one) holds it and has at least 80 % of its occurrences.

Bounds. A phrase that begins with p has a <= f(p), and its cut behind p's first word w has l = f(w), r >= a: its score is at most
floor(2000000 * f(p) / (f(p) + f(w))), p's bound to the right; its last word bounds what ends with p likewise. So a frontier of
(phrase, direction) is grown best bound first: to grow p to the right is to count all phrases of one word more that begin
with it. A phrase is settled when both sides are grown, as that shows all that may drop it. Once a language has `top` settled
survivors, the score of the last of them is its floor: what is bounded below it is never grown, and the search ends when
nothing at or above it is left, ties included. Phrases below the floor may lack the count of a part; those at or above it
can't, by the same bounds.

Plan. Tasks count 64-bit hashes of words and pairs over all texts; the sums are dealt by hash, and hashes of enough occurrences set
bits of a filter of fixed size (a false positive costs a count, never a result). One more pass counts the words and pairs of
the filter as they are written, and writes down the runs of three and more words whose pairs all passed. Longer phrases of
enough occurrences stand inside such runs, so each round of growth reads these alone, with at most BATCH phrases to grow,
whatever the tables' size. Counts are exact: they are of the phrases themselves. Floors and bounds are histograms of scores
(0 to 1,000,000) by language, so a language with a third of all texts is no task's group.

Null texts are empty, null languages are `und`. Repeated rows count. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, over_arrow, settled, slices, staged
from .textbytes import FOLD, byte_set, mix, utf8, word_hashes, word_spans

TOP, LEAST, LONGEST, SHARE = 2000, 30, 4, 80
#: Phrases grown in a round; bits of the filter; bytes of text of a step; hashes that a task holds before it sends them; bytes of text to a block of hashes.
BATCH, FILTER_BITS, STEP_BYTES, HELD, BLOCK_BYTES = 1 << 17, 26, 2 << 20, 1_500_000, 64 << 20
SCALE = 2_000_000
_WORD = byte_set((0x20, 0x20), (0x09, 0x0D), *((b, b) for b in b".,;:!?"))
_BREAK = ~byte_set((0x0A, 0x0D), *((b, b) for b in b".,;:!?"))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_HASH = np.dtype([("hash", "<u8"), ("n", "<u4")])


class _Words:
    """The words of a batch of texts: where they stand, their hashes by language, and which follows the one before within a piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = utf8(batch["text"])
        self.data = FOLD[data]
        self.start, self.end, first = word_spans(self.data, offsets, _WORD)
        number = np.diff(first)
        lang = pc.fill_null(batch["lang"], "und").dictionary_encode()
        self.langs: list[str] = lang.dictionary.to_pylist()
        codes = lang.indices.to_numpy(zero_copy_only=False)
        self.lang = np.repeat(codes, number).astype(np.int64)
        self.tokens = np.bincount(codes, number, len(self.langs)).astype(np.int64)
        salt = np.array([_text_hash(x) for x in self.langs], np.uint64)
        self.hash = mix(word_hashes(self.data, self.start, self.end) + salt[self.lang]) if len(self.start) else np.zeros(0, np.uint64)
        breaks = np.flatnonzero(_BREAK[self.data])
        piece = np.searchsorted(breaks, self.start)
        text = np.repeat(np.arange(len(number)), number)
        self.follows = np.zeros(len(self.start), bool)  # whether a word has one before it in its piece
        self.follows[1:] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])

    def pairs(self) -> np.ndarray:
        """The hash of each word and the one before it, where there is one."""
        at = np.flatnonzero(self.follows)
        return mix(self.hash[at - 1] * _PAIR + self.hash[at])

    def strings(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number, and the words by number."""
        ends = np.concatenate(([0], np.cumsum(self.end - self.start)))
        found = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends), pa.py_buffer(self.data[_WORD[self.data]])).dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.cast(pa.string())


def _text_hash(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 1


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Equal hashes of several tables as one, sorted. A number beyond 32 bits stays at the greatest: it is compared with a small one only."""
    x = np.concatenate(parts)
    order = np.argsort(x["hash"], kind="stable")
    x = x[order]
    first = np.flatnonzero(np.concatenate(([True], x["hash"][1:] != x["hash"][:-1]))) if len(x) else np.zeros(0, np.int64)
    out = np.empty(len(first), _HASH)
    out["hash"] = x["hash"][first]
    out["n"] = np.minimum(np.add.reduceat(x["n"].astype(np.uint64), first), 0xFFFFFFFF) if len(first) else 0
    return out


def _hashed(blocks: int):
    """Tables of hashes, summed over a task's texts, dealt to blocks by their high bits."""

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        x = _summed(held)
        block = (x["hash"] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        cut = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
        rows = [k for k in range(blocks) if cut[k] < cut[k + 1]]
        return pa.RecordBatch.from_pydict({"block": pa.array(rows, pa.int32()), "data": pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text", STEP_BYTES):
            words = _Words(batch)
            values, n = np.unique(np.concatenate((words.hash, words.pairs())), return_counts=True)
            part = np.empty(len(values), _HASH)
            part["hash"], part["n"] = values, n
            held.append(part)
            size += len(part)
            if size >= HELD:
                held = [_summed(held)]
                size = len(held[0])
                if size >= HELD // 2:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    return run


def _often(least: int):
    @settled
    def run(table: pa.Table) -> pa.Table:
        x = _summed([np.frombuffer(d.as_py(), _HASH) for d in table["data"]])
        place = np.unique(x["hash"][x["n"] >= least] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        word = place >> 5
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(np.int64(1) << (place & 31), first) if len(first) else np.zeros(0, np.int64)
        return pa.table({"place": pa.array(word[first], pa.int64()), "bits": pa.array(bits, pa.int64())})

    return run


def _filter(hashes: DataFrame, least: int) -> np.ndarray:
    """The filter, of 2 ** FILTER_BITS bits however many hashes there are."""
    rows = hashes.groupBy("block").applyInArrow(_often(least), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    out[rows["place"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def _passes(filter: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (filter[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


_SHAPE = "lang string, phrase string, words int, n long"
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _grams(langs: list[str], lang: np.ndarray, words: pa.Array, codes: np.ndarray, at: np.ndarray, width: int, weight: np.ndarray | None = None) -> pa.RecordBatch:
    """The phrases of `width` words that begin at the places `at`, counted."""
    key = lang[at]
    for k in range(width):
        key = key * len(words) + codes[at + k] if k < 2 else np.unique(key, return_inverse=True)[1] * len(words) + codes[at + k]
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    n = np.bincount(back, weight[at] if weight is not None else None, len(first)).astype(np.int64)
    place = at[first]
    phrase = _joined(words, codes, place, width)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[place])), phrase, pa.array(np.full(len(place), width, np.int32)), pa.array(n)], schema=_COUNTS)


def _joined(words: pa.Array, codes: np.ndarray, place: np.ndarray, width: int) -> pa.Array:
    each = [words.take(pa.array(codes[place + k])) for k in range(width)]
    return (pc.binary_join_element_wise(*each, " ") if width > 1 else each[0])


def _counted(filter: np.ndarray):
    """Words and pairs that pass, counted (words 1 and 2), the runs of three words and more whose pairs all pass (words 0), and each language's words (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            w = _Words(batch)
            n = len(w.langs)
            yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.string()), pa.nulls(n, pa.string()), pa.array(np.full(n, -1, np.int32)), pa.array(w.tokens)], schema=_COUNTS)
            if not len(w.start):
                continue
            codes, words = w.strings()
            yield _grams(w.langs, w.lang, words, codes, np.flatnonzero(_passes(filter, w.hash)), 1)
            linked = np.zeros(len(codes) + 1, bool)  # with the word before it, by a pair that passes
            at = np.flatnonzero(w.follows)
            linked[at[_passes(filter, w.pairs())]] = True
            yield _grams(w.langs, w.lang, words, codes, np.flatnonzero(linked) - 1, 2)
            begin = np.flatnonzero(~linked[:-1] & linked[1:])
            end = np.flatnonzero(linked[:-1] & ~linked[1:]) + 1
            long = end - begin >= 3
            begin, size = begin[long], (end - begin)[long]
            inside = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), words.take(pa.array(codes[inside])))
            yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.string()).take(pa.array(w.lang[begin])), pc.binary_join(runs, " "), pa.array(np.zeros(len(begin), np.int32)), pa.array(np.ones(len(begin), np.int64))], schema=_COUNTS)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, up to STEP_BYTES: a set of phrases is looked up once for all of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STEP_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _growing(right: list[pa.Array], left: list[pa.Array], longest: int):
    """Counts the phrases a word longer than those that are grown: by width, `right` and `left` have (language, phrase) as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_gathered(batches), "phrase", STEP_BYTES):
            lang = batch["lang"].dictionary_encode()
            langs = lang.dictionary.to_pylist()
            split = pc.split_pattern(batch["phrase"], " ")
            size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            found = split.flatten().dictionary_encode()
            codes, words = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
            of = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
            weight = np.repeat(batch["n"].to_numpy(zero_copy_only=False), size)
            rest = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # words from here to the run's end
            for width in range(2, longest):
                if not len(right[width]) and not len(left[width]):
                    continue
                at = np.flatnonzero(rest >= width)
                key = of[at]
                for k in range(width):
                    key = key * len(words) + codes[at + k] if k < 2 else np.unique(key, return_inverse=True)[1] * len(words) + codes[at + k]
                _, first, back = np.unique(key, return_index=True, return_inverse=True)
                place = at[first]
                names = pc.binary_join_element_wise(pa.array(langs, pa.string()).take(pa.array(of[place])), _joined(words, codes, place, width), " ")
                grown = np.zeros(len(codes) + 1, bool)
                grown[at] = pc.is_in(names, right[width]).to_numpy(zero_copy_only=False)[back]
                ended = np.zeros(len(codes) + 1, bool)
                ended[at] = pc.is_in(names, left[width]).to_numpy(zero_copy_only=False)[back]
                begin = np.flatnonzero((rest >= width + 1) & (grown[:-1] | ended[1:]))
                if len(begin):
                    yield _grams(langs, of, words, codes, begin, width + 1, weight)

    return run


def _sum(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def _score(a: str, total: str) -> Column:
    """floor(SCALE * a / total); the product may pass 64 bits."""
    return F.expr(f"(cast({a} as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div cast({total} as decimal(20,0))")


def _state(words: DataFrame, grams: DataFrame, done: DataFrame | None, longest: int, share: int) -> DataFrame:
    """Each phrase with its lowest-scoring cut (null where a part isn't counted yet), its bounds, whether a longer phrase drops it, and what is grown."""
    known = words.unionByName(grams.select("lang", "phrase", "f"))
    parts = F.split("phrase", " ")
    join = lambda x: F.array_join(x, " ")
    cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": join(F.slice(parts, F.lit(1), F.col("k"))), "rest": join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")))})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"], "left")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "left")
    cut = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.struct(_score("f", "l + r").alias("score"), "k", "l", "r"))
    state = cuts.groupBy("lang", "phrase", "words", "f").agg(
        F.min(cut).alias("cut"), (F.count(cut) == F.col("words") - 1).alias("whole"), F.max(F.when(F.col("k") == 1, F.col("l"))).alias("begins"), F.max(F.when(F.col("k") == F.col("words") - 1, F.col("r"))).alias("ends")
    )
    state = state.select("lang", "phrase", "words", "f", F.when(F.col("whole"), F.col("cut")).alias("cut"), _score("f", "f + begins").alias("right"), _score("f", "f + ends").alias("left"))
    # the two phrases that a longer one has inside, a word shorter
    inner = F.array(join(F.slice(parts, F.lit(1), F.col("words") - 1)), join(F.slice(parts, F.lit(2), F.col("words") - 1)))
    longer = grams.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    state = state.join(longer, ["lang", "phrase"], "left")
    wide = lambda c, times: F.col(c).cast("decimal(20,0)") * times
    state = state.withColumn("dropped", F.coalesce(wide("longer", 100) >= wide("f", share), F.lit(False))).drop("longer")
    if done is None:
        return state.withColumns({"grew_right": F.lit(False), "grew_left": F.lit(False)})
    grew = done.groupBy("lang", "phrase").agg(F.max(F.col("side") == "right").alias("grew_right"), F.max(F.col("side") == "left").alias("grew_left"))
    state = state.join(grew, ["lang", "phrase"], "left")
    return state.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("grew_right", "grew_left")})


def _floors(survivors: DataFrame, top: int) -> DataFrame:
    """(lang, floor): the score of the `top`-th survivor of each language that has as many. Scores are counted first: a language has a million at most."""
    counts = survivors.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    upper = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("above", F.sum("n").over(upper)).filter(F.col("above") >= top).groupBy("lang").agg(F.max("score").alias("floor"))


def _survivors(state: DataFrame, longest: int) -> DataFrame:
    """The phrases whose score is known and that no longer phrase, counted or still to be counted, drops."""
    settled = state.filter((F.col("words") == longest) | F.col("grew_right") & F.col("grew_left")).filter("cut is not null and not dropped")
    return settled.withColumn("score", F.col("cut.score"))


def _best(frontier: DataFrame, turn: int) -> DataFrame | None:
    """About BATCH of the frontier of the best bounds; None if it is empty."""
    counts = frontier.groupBy((F.col("bound") / 1000).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bucket")).collect()  # 1001 rows at most
    if not counts:
        return None
    total, level = 0, counts[0]["bucket"]
    for r in counts:
        if total and total + r["n"] > BATCH:
            break
        total, level = total + r["n"], r["bucket"]
    some = frontier.filter(F.col("bound") >= level * 1000)
    shares = -(-total // BATCH)  # one bucket may have more than a batch
    return some if shares == 1 else some.filter(F.pmod(F.xxhash64("lang", "phrase", "side", F.lit(turn)), F.lit(shares)) == 0)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, least: int = LEAST, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, then a, both descending, then phrase."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    hashes = over_arrow(docs, _hashed(blocks), "block int, data binary")
    counts = staged(over_arrow(docs, _counted(_filter(hashes, least)), _SHAPE), "counts")
    tokens = staged(counts.filter("words = -1").groupBy("lang").agg(F.sum("n").alias("n")), "tokens")
    runs = staged(counts.filter("words = 0").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "runs")
    often = staged(_sum(counts.filter("words > 0"), least), "often")
    discard(counts)
    words, grams = often.filter("words = 1").select("lang", "phrase", "f"), often.filter("words = 2")
    done, turn = None, 0
    while True:
        state = staged(_state(words, grams, done, longest, share), "state")
        floors = staged(_floors(_survivors(state, longest), top), "floors")
        sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("bound"), F.col(f"grew_{x}").alias("grew")) for x in ("right", "left")]))
        frontier = state.filter(F.col("words") < longest).select("lang", "phrase", "words", sides.alias("x")).select("lang", "phrase", "words", "x.*").filter("not grew")
        frontier = frontier.join(floors, "lang", "left").filter("floor is null or bound >= floor").drop("floor", "grew")
        chosen = _best(frontier, turn)
        if chosen is None:
            break
        turn += 1
        chosen = staged(chosen, "grown")
        asked = chosen.select("side", "words", F.concat_ws(" ", "lang", "phrase").alias("name")).toArrow()  # a batch
        take = lambda side, width, asked=asked: asked.filter(pc.and_(pc.equal(asked["side"], side), pc.equal(asked["words"], width)))["name"].combine_chunks()
        right, left = ([pa.array([], pa.string())] * 2 + [take(side, width) for width in range(2, longest)] for side in ("right", "left"))
        grown = _sum(over_arrow(runs, _growing(right, left, longest), _SHAPE), least)
        grams = staged(grams.unionByName(grown).dropDuplicates(["lang", "phrase"]), "grams")
        done = chosen if done is None else done.unionByName(chosen)
    found = _survivors(state, longest).join(floors, "lang", "left").filter("floor is null or score >= floor")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(tokens, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to four words."""
    return collocations(documents(spark, sf_dir, "lang", "text"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) r(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[2:], ' '), array_to_string(string_split(phrase, ' ')[:m - 1], ' ')]) AS phrase, f FROM f WHERE m > 2),
o AS (SELECT lang, phrase, max(f) AS f FROM h GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""
