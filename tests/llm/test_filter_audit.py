"""The audit against running every order of the filters."""

import itertools
import random
import re

import duckdb
import pytest
from cadenza.llm import filter_audit as fa
from samples import split

SCHEMA = "doc_id long, text string, lang string"


def fails(text):
    words = split(text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = [(d, lang or "", fails(t or "") | {"E": (t or "") in least and least[t or ""] != d}) for d, t, lang in rows]
    out = []
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        removed_by, found = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for step, c in enumerate(order, 1):
                here = [x for x in left if x[1][c]]
                redundant = sum(f[c] for _, f in gone)
                left, gone = [x for x in left if not x[1][c]], gone + here
                removed_by[c] += len(here)
                unique = sum(f[c] and sum(f.values()) == 1 for _, f in own)
                found.append([part, "".join(order), step, len(left), len(here), redundant, unique, sum(d in good for d, _ in here), sum(d in toxic for d, _ in here), c])
        out += [(*x[:9], removed_by[x[9]]) for x in found]
    return sorted(out)


def mixed(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "de|ta", "naïve", "東京", "a#b", "zz"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[:rng.choice([5, 40, 308])]) for _ in range(rng.choice([3, 99, 100, 130, 400]))) for _ in range(40)] + [None, "", " \t\x0b", "ABCDEFGHIJ abcdefghij", "A" + "b" * 9, "AB" + "c" * 8]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    rows += [(7, rows[7][1], "en"), (7, rows[7][1], rows[7][2]), (None, texts[0], "en"), (None, "by itself", "xx"), (None, "by itself", "xx"), (-5, "by itself too", "yy")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1), (99999, 1, 1)]
    rng.shuffle(rows)
    return rows, labels


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("seed", [1, 2])
def test_the_audit_is_what_running_all_orders_gives(spark, tmp_path, seed):
    rows, labels = mixed(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit(docs.selectExpr("*", "1 as mask", "'x' as part", "null as digest", "3 as n", "0 as good"), marks.selectExpr("*", "'z' as part"))
    want = plain_audit(rows, labels)
    assert sorted(tuple(r[c] for c in NAMES) for r in got.collect()) == want
    docs.write.parquet(f"{tmp_path}/d")
    marks.write.parquet(f"{tmp_path}/l")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    con.execute(f"create view labels as select * from '{tmp_path}/l/*.parquet'")
    assert sorted(con.execute(f"select {', '.join(NAMES)} from ({fa.audit_sql()})").fetchall()) == want


def test_an_empty_table_has_no_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(spark.createDataFrame([], SCHEMA), marks).count() == 0
    one = fa.audit(spark.createDataFrame([(1, None, None)], SCHEMA), marks).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_joint_counts_invert(spark):
    """Counts of exact sets come back from the counts of joint failures."""
    rng = random.Random(9)
    exact = [rng.randrange(100) for _ in range(32)]
    df = spark.createDataFrame([("p", m, n, n // 2, n // 3) for m, n in enumerate(exact) if n], "part string, mask int, n long, good long, toxic long")
    row = fa.joint_counts(df).select(fa.inverted("n").alias("x"), fa.shapley("n").alias("v"), fa.kept_by("n").alias("k")).first()
    assert row.x == exact and row.k[0] == sum(exact) and row.k[31] == exact[0]
    assert sum(row.v) == 120 * (sum(exact) - exact[0])


def test_no_python_runs_in_the_plan(spark):
    plan = fa.audit(spark.createDataFrame([(1, "x", "en")], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
