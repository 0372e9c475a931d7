"""Small tables that hold what the operators must cope with, and what several tests need."""

import random
import re

from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\x0c\r"


def split(text):
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return [w for w in re.split(f"[{SEPARATORS}]+", text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def vocabulary(n=3000, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, n, words=tuple(vocabulary())):
    out = [rng.choice(words) for _ in range(n)]
    for i in range(0, n, 9):
        out[i] = out[i].capitalize()
    return " ".join(out)


def corpus(seed=1):
    """(doc_id, text) rows: exact and near copies, shared passages, repeats within a text, null, empty, blank and long texts, letters of several bytes."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(20, 160))) for i in range(1, 25)]
    rows += [(30 + i, rows[3][1]) for i in range(6)]
    near = rows[7][1].split(" ")
    for i in range(5):
        own = list(near)
        own[rng.randrange(len(own))] = f"changed{i}"
        rows.append((40 + i, " ".join(own)))
    passage = prose(rng, 60)
    rows += [(50 + i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}") for i in range(8)]
    rows += [(60, "a " * 300), (61, "ab" * 400), (62, f"{passage}\n{passage}"), (63, "a " * 90 + "b")]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one two"), (74, "One  TWO"), (75, "x")]
    rows += [(80, "naïve café 東京都 " * 12), (81, "naïve café 東京都 " * 12), (82, " é" * 70), (83, "pipe | and\ttab\x0bvt")]
    rows += [(90, prose(rng, 20_000)), (5, prose(rng, 40)), (-3, rows[2][1])]
    rng.shuffle(rows)
    return [r for r in rows if r != (5, rows[0][1])]


def unique_ids(rows):
    seen = set()
    return [r for r in rows if not (r[0] in seen or seen.add(r[0]))]


CLASHING = ("digest", "marks", "bucket", "packed", "doc", "label", "key", "n", "part", "spans", "score", "a", "b", "text_", "kept", "item_id", "n_bytes", "__spans", "__id", "__kinds", "__gone", "__part", "held_out", "ids", "normal", "symbols", "row")


def frame(spark, rows, extra=False, slices=3):
    """documents-like rows in several partitions; extra: columns whose names clash with the operators' own, full of nulls."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(slices)
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in CLASHING)) if extra else df


def by_id(df, *columns):
    return sorted(tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect())
