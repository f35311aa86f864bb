"""Toxicity by bags of subwords: averaged embeddings under a linear softmax, trained jointly with numpy.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A bag holds the words of a window (WORDS
consecutive words of a text) and their n-grams of GRAMS bytes, with a mark before and after each word, as hashes into
CELLS cells; so a misspelt or inflected word shares most of its cells with the word. A bag's vector is the mean of its
cells' embeddings; a linear softmax over it gives the chances of both labels, and embeddings and softmax are trained
together (AdaGrad). A text's score is the greatest chance of label 1 among its windows, all of which are judged: a few
toxic words show in a text of any length. A null text, or one without words, gets the chance of an empty bag.

Labels are those of texts, so training takes from a marked text the window that the model itself finds worst, and
from others the worst and a random one; the first round takes random ones from both. Each round judges all windows.

The model learns from about MARKED and CLEAN labelled rows (all, if there are fewer), taken by a hash of the id; from
fewer where they have more than SAMPLE_BYTES of text, and from none whose text has more than ROW_BYTES. That bounds what
the driver holds; the rows that are taken are taken whole. A row is marked if any label of its id is 1; labels that are
null, or neither 0 nor 1, teach nothing. Without rows of both labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, over_arrow, plus, slices, staged
from .textbytes import ALNUM, FOLD, U64, Rolling, utf8, word_spans

WORDS, GRAMS, CELL_BITS, SIZE = 8, (3, 4, 5), 17, 8
CELLS = 1 << CELL_BITS
MARKED, CLEAN, SAMPLE_BYTES, ROW_BYTES = 2000, 3000, 8 << 20, 1 << 16
ROUNDS, BATCH, RATE, SEED = 8, 64, 0.2, 7
THRESHOLD = 0.7


class Bags:
    """The windows of texts that stand in a row, over a stream of their words with a mark before each and at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = FOLD[data]
        start, end, first = word_spans(data, offsets, ALNUM)
        length, words = end - start, np.diff(first)
        self.number = -(-words // WORDS)
        self.first = np.concatenate(([0], np.cumsum(self.number)))
        block = np.cumsum(length + 1) - (length + 1)  # of each word, its mark included, in the stream
        if len(start):
            inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            self.stream = np.full(int(length.sum()) + len(length) + 1, 32, np.uint8)
            self.stream[np.repeat(block + 1, length) + inside] = data[np.repeat(start, length) + inside]
        else:
            self.stream = np.zeros(0, np.uint8)
        within = np.arange(len(start)) - np.repeat(first[:-1], words)
        self.begin = block[within % WORDS == 0]
        self.words, self.ends = block + 1, block + 1 + length

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in the stream, cell) of all features, a kind at a time."""
        rolling, far = Rolling(self.stream), U64(64 - CELL_BITS)
        yield self.words, (rolling.spans(self.words, self.ends) >> far).astype(np.int32)
        marks = np.concatenate(([0], np.cumsum(self.stream == 32, dtype=np.int32)))
        for n in GRAMS:
            cell = (rolling.windows(n) >> far).astype(np.int32)
            whole = np.flatnonzero(marks[n - 1 : n - 1 + len(cell)] == marks[1 : 1 + len(cell)])
            yield whole, cell[whole]

    def means(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each window's cells."""
        if not len(self.begin):
            return np.zeros(0)
        total, count = np.zeros(len(self.stream)), np.zeros(len(self.stream), np.int32)
        for place, cell in self.cells():
            total[place] += weights[cell]
            count[place] += 1
        return np.add.reduceat(total, self.begin) / np.maximum(1, np.add.reduceat(count, self.begin))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells of all windows, window by window, and how many each has."""
        place, cell = (np.concatenate(x) for x in zip(*self.cells(), strict=True))
        window = np.searchsorted(self.begin, place, "right") - 1
        return cell[np.argsort(window, kind="stable")], np.bincount(window, minlength=len(self.begin))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[int, str]]:
    """(label, text) of the sampled rows, in the order of their ids and texts: MARKED + CLEAN rows or so, SAMPLE_BYTES or so."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label")).filter("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda label, most: (1 << 20) * min(1.0, most / max(1, total.get(label, 0)))
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 20))
    taken = marks.filter(place("toxicity") < F.when(F.col("label") == 1, share(1, MARKED)).otherwise(share(0, CLEAN)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.octet_length("text") <= ROW_BYTES).join(F.broadcast(taken), "doc_id")
    rows = staged(rows.select("doc_id", "label", "text"), "sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = rows.filter(place("thinner") < (1 << 20) * min(1.0, SAMPLE_BYTES / max(1, size))).collect()
    return [(r["label"], r["text"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


class Model:
    """Embeddings (a row a dimension), the softmax's weights and its biases."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.embedding = rng.normal(0, 0.1, (SIZE, CELLS)).astype(np.float32)
        self.weight = rng.normal(0, 1, (SIZE, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def folded(self) -> tuple[np.ndarray, float]:
        """What each cell, and no cell, adds to the log-odds of label 1: the softmax is linear over the mean."""
        return ((self.weight[:, 1] - self.weight[:, 0]) @ self.embedding).astype(np.float64), float(self.bias[1] - self.bias[0])

    def fit(self, rows: list[tuple[int, str]]) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        cells, count, number = [], [], []
        for i in range(0, len(rows), 128):
            bags = Bags(*utf8(pa.array([text for _, text in rows[i : i + 128]], pa.large_string())))
            number.append(bags.number)
            if bags.number.any():
                part, n = bags.features()
                cells.append(part)
                count.append(n)
        number = np.concatenate(number)
        label = np.array([x for x, _ in rows])[number > 0]  # a text without words teaches nothing
        if not len(label):
            return
        at = np.concatenate(([0], np.cumsum(number[number > 0])))
        count, parts = np.concatenate(count), cells[::-1]
        cells, filled = np.empty(int(count.sum()), np.int32), 0
        while parts:  # each part goes as it is copied, so the driver never holds them all twice
            cells[filled : filled + len(parts[-1])] = parts[-1]
            filled += len(parts.pop())
        begin = np.cumsum(count) - count
        sums = [np.zeros_like(x) for x in (self.embedding, self.weight, self.bias)]
        for turn in range(ROUNDS):
            if turn:
                odds = self._odds(cells, begin, count)
            picked, marks = [], []
            for i, mark in enumerate(label.tolist()):
                own = np.arange(at[i], at[i + 1])
                if not turn:
                    some = rng.choice(own, min(len(own), 8 if mark else 4), replace=False)
                else:
                    order = own[np.argsort(-odds[own], kind="stable")]
                    some = order[:1] if mark else np.concatenate((order[:1], rng.choice(own, 1)))
                picked.append(some)
                marks.append(np.full(len(some), mark))
            picked, marks = np.concatenate(picked), np.concatenate(marks)
            order = rng.permutation(len(picked))
            for i in range(0, len(order), BATCH):
                one = order[i : i + BATCH]
                self._step(cells, begin[picked[one]], count[picked[one]], marks[one], sums)

    def _odds(self, cells: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The log-odds of each window; a few thousand at once."""
        weights, bias = self.folded()
        weights, out = weights.astype(np.float32), np.empty(len(count))
        for i in range(0, len(count), 4096):
            first = begin[i : i + 4096]
            last = begin[i + 4096] if i + 4096 < len(count) else len(cells)
            out[i : i + 4096] = np.add.reduceat(weights[cells[first[0] : last]], first - first[0])
        return out / count + bias

    def _step(self, cells: np.ndarray, begin: np.ndarray, n: np.ndarray, label: np.ndarray, sums: list[np.ndarray]) -> None:
        bag = np.repeat(np.arange(len(n)), n)
        cell = cells[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
        mean = np.stack([np.bincount(bag, row[cell], len(n)) / n for row in self.embedding], 1).astype(np.float32)
        z = mean @ self.weight + self.bias
        chance = np.exp(z - z.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(n)), label] -= 1
        each = np.bincount(label, minlength=2)
        chance *= (0.5 / np.maximum(1, each))[label][:, None].astype(np.float32)
        back = (chance @ self.weight.T) / n[:, None].astype(np.float32)
        used, where = np.unique(cell, return_inverse=True)
        for row, total, slope in zip(self.embedding, sums[0], back.T, strict=True):
            g = np.bincount(where, slope[bag], len(used)).astype(np.float32)
            total[used] += g * g
            row[used] -= RATE * g / (np.sqrt(total[used]) + 1e-8)
        for value, total, g in ((self.weight, sums[1], mean.T @ chance), (self.bias, sums[2], chance.sum(axis=0))):
            total += g * g
            value -= RATE * g / (np.sqrt(total) + 1e-8)


def learn(rows: list[tuple[int, str]]) -> tuple[np.ndarray, float] | None:
    """The folded model; None unless there are rows of both labels."""
    if len({label for label, _ in rows}) < 2:
        return None
    model = Model()
    model.fit(rows)
    return model.folded()


def score(df: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each text; a column of that name is replaced. The folded model is CELLS numbers, whatever it learnt from."""
    df, schema = plus(df, f"`{out}` double", out)
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            bags = Bags(*utf8(batch[text]))
            odds = bags.means(weights) + bias
            worst = np.full(batch.num_rows, bias)
            some = np.flatnonzero(bags.number)
            if len(some):
                worst[some] = np.maximum.reduceat(odds, bags.first[some])
            yield batch.append_column(out, pa.array(1 / (1 + np.exp(-np.clip(worst, -500, 500)))))

    return over_arrow(df, run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted (1 from THRESHOLD); learnt from labelled documents that aren't held out."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = learn(sample(docs, labels.filter(~held_out())))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
