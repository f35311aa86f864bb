"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

A text is lower-cased; letters stay, and each run of other characters becomes one space, which also stands at both
ends. Its n-grams of 1 to 4 characters, but for the space alone, are counted over the whole text; the TOP most
frequent, ties by code point, make its profile. The distance to a language's profile sums, over the text's n-grams,
how far each is out of its place there, or TOP if it isn't there. The least distance wins; ties go to the first name.
score is one less the distance's share of the greatest possible.

Profiles are learnt from about SAMPLE texts of each language, taken by a hash of the id (all if there are fewer): the
n-grams are counted by Spark and the TOP of each language kept. Null text, or a text without a letter, is `und` with
score 0; so is every text if nothing was learnt. Rows of null language or null text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, held_out, over_arrow, plus

LONGEST, TOP, SAMPLE = 4, 400, 3000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which of the first 65,536 code points are letters."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their counts; code points are packed into 16 bits each, so the lower of two wide ones stands for both."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    low = code & 0xFFFF
    letter = _letters()[low]
    if (wide := code > 0xFFFF).any():
        letter[wide] = [chr(c).isalpha() for c in code[wide].tolist()]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.where(letter, low, 32)
    x = np.concatenate(([32], x, [32])).astype(np.uint64)
    space = x == 32
    x = x[~(space & np.concatenate(([False], space[:-1])))]
    found, key = [x[x != 32]], x
    for n in range(2, LONGEST + 1):
        key = (key[:-1] << np.uint64(16)) | x[n - 1 :]
        found.append(key)
        if len(key) < 2:
            break
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(gram: np.ndarray, count: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, in order."""
    if len(gram) > 4 * top:
        least = np.partition(count, len(count) - top)[len(count) - top]
        gram, count = gram[count >= least], count[count >= least]
    return gram[np.argsort(-count, kind="stable")[:top]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        parts = [*parts, total[lang]] if lang in total else parts
        gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        total[lang] = gram, np.bincount(at, np.concatenate([c for _, c in parts]), len(gram)).astype(np.int64)

    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text))
        for lang, parts in by.items():
            add(lang, parts)
    for lang, (gram, count) in total.items():
        for at in range(0, len(gram), 100_000):
            part = gram[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(count[at : at + 100_000])], ["lang", "gram", "n"])


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, top: int = TOP) -> dict[str, np.ndarray]:
    """The profile of each language: `top` n-grams at most, so the result is small however much is read."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in total.items() for x in (name, min(1.0, sample / n))])
    taken = rows.filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = over_arrow(taken.select("lang", "text"), _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).orderBy("lang", "place").collect()
    profiles: dict[str, list[int]] = {}
    for r in best:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {name: np.array(x, np.int64).view(np.uint64) for name, x in profiles.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.place = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for column, name in enumerate(self.names):
            self.place[np.searchsorted(self.grams, profiles[name]), column] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        order = ranked(*grams(text), self.top) if text and self.names else ()
        if not len(order):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, order), len(self.grams) - 1)
        place = np.where((self.grams[at] == order)[:, None], self.place[at], -1)
        out = np.where(place >= 0, np.abs(place - np.arange(len(order))[:, None]), self.top).sum(axis=0)
        best = int(out.argmin())
        return self.names[best], 1.0 - float(out[best]) / (self.top * len(order))


def predict(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language of each text and its score; columns of these names are replaced."""
    df, schema = plus(df, f"`{out}` string, `{score}` double", out, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for batch in batches:
            names, scores = zip(*map(known.predict, batch[text].to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield batch.append_column(out, pa.array(names, pa.string())).append_column(score, pa.array(scores, pa.float64()))

    return over_arrow(df, run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Per document: held_out, lang_pred, score; learnt from the documents that aren't held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    profiles = learn(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
