"""Small tables with every awkward case, and brute-force versions."""

import random

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>"


def sentence(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


def awkward(seed=1, n=40):
    """Documents with nulls, empty, white and very long texts, copies, near copies, repeated rows and odd characters."""
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(1, 120))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, sentence(rng, 20_000)), (104, "Ünïcödé ΑΣ İI 中文 😀 don't it's"), (None, "no id here"),
             (None, None), (105, rows[3][1]), (106, rows[3][1]), (107, rows[3][1].upper()), rows[5], rows[5]]
    near = rows[7][1].split() * 3
    rows += [(110, " ".join(near)), (111, " ".join(near[:-1] + ["other"])), (112, "<|endoftext|> a <|startoftext|>b")]
    return rows


def clashing(df, *names):
    """The same rows with further columns that have the operators' own names."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def grouped(n, linked):
    """Least connected index of each of n items, by linked(i, j)."""
    up = list(range(n))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(k) for k in range(n)]
