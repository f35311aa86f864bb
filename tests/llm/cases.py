"""Documents of the awkward kinds: nulls, empty, very long, repeated, clashing columns; and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, node long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    parts = text.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = words(rng, 1)
    return " ".join(parts)


def texts(seed=5):
    rng = random.Random(seed)
    base, other = words(rng, 120), words(rng, 60)
    out = [None, "", " ", "\n\n", "one", "Ein Wort", base, base, base.upper(), edited(rng, base, 2), edited(rng, base, 5), edited(rng, base, 9), other + "\n" + base, other, other + " " + other, "é" * 300, "日本語のテキスト。" * 20]
    out += [words(rng, 40000), "a" * 5000, "In. " * 400, "  " + words(rng, 30) + "\t\r\n" + words(rng, 30) + "  ", "it's 'quoted' 12345 <|endoftext|> !!! ... x"]
    out += [edited(rng, base, k) for k in range(1, 13)] + [words(rng, rng.randint(1, 80)) for _ in range(25)]
    return out


def frame(spark, values=None, ids=None):
    values = texts() if values is None else values
    ids = list(range(len(values))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 2}", None if t is None else len(t), 0.5, "x", 7) for k, (i, t) in enumerate(zip(ids, values))]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def written(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
