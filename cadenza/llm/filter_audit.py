"""What filters in any order keep, lose and share, by inclusion-exclusion over their joint failures; DataFrame functions only."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words, as a Java pattern, and the characters that filter D looks for.
_GAP, _SIGNS = "[\\x20\\x09-\\x0D]+", "[#$%&*|]"
LETTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


def _flags(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at one text alone."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": F.regexp_like(text, F.lit(_SIGNS)),
    }


def failures(docs: DataFrame, labels: DataFrame, by: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of mask (bit i: LETTERS[i]).

    E needs all texts: of the documents with one text, those with its smallest id pass. Texts
    travel as digests; rows of one text are first counted by part, label and id, so that a text
    that a third of all rows share arrives as a few sums. A null text or part counts as empty. A
    null id has no label, is smaller than none and fails E next to any other id of its text.
    Repeated rows are documents of their own; E compares ids, so rows that share the smallest id
    all pass. Of several label rows of an id, one that says 1 decides.
    """
    text = F.col("__text")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # the flags stay apart, as an expression over them would count the words once for each
    own = own.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), F.struct(*[f.alias(k) for k, f in _flags(text).items()]).alias("fails"))
    own = own.withColumn("mask", sum((F.when(F.col(f"fails.{k}"), 1 << i).otherwise(0) for i, k in enumerate("ABCD")), F.lit(0))).drop("fails")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic")
    )
    own = own.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    alike = ("digest", "mask", "part", "good", "toxic")
    by_id = own.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("rows"))
    # the smallest id of each kind of row, with its rows; a null id comes after all
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    sums = by_id.groupBy(*alike).agg(F.sum("rows").alias("rows"), F.min(order).alias("least"), F.min_by("rows", order).alias("first_rows"))
    kinds = F.collect_list(F.struct("mask", "part", "good", "toxic", "rows", "least", "first_rows"))  # as many as parts and labels differ
    texts = sums.groupBy("digest").agg(F.min("least").alias("smallest"), kinds.alias("kinds")).select("smallest", F.explode("kinds").alias("k")).select("smallest", "k.*")
    passes = F.when(F.col("least").eqNullSafe(F.col("smallest")), F.col("first_rows")).otherwise(0)
    split = texts.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", passes.alias("rows")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("rows") - passes).alias("rows")))).alias("x"))
    rows = F.col("x.rows")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(rows).alias("n"), F.sum(rows * F.col("good")).alias("good"), F.sum(rows * F.col("toxic")).alias("toxic"))


def joint_counts(fails: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """(part, n, good, toxic): an array for each measure whose entry S is the number of documents that fail all filters of the set S: sums of products of flags."""
    product = lambda s: (F.col("mask").bitwiseAND(F.lit(s)) == s).cast("long")  # noqa: E731  the product of the flags of s
    sums = {m: F.array(*[F.sum(F.col(m) * product(s)) for s in range(1 << filters)]) for m in MEASURES}
    return fails.groupBy("part").agg(*[v.alias(m) for m, v in sums.items()])


def _weighted(counts: Column, weights: list[list[int]]) -> Column:
    """The sums of counts under each row of weights, as an array. The weights are one constant, so that the plan stays small."""
    rows = F.from_json(F.lit(json.dumps(weights)), "array<array<bigint>>")
    return F.transform(rows, lambda w: F.aggregate(F.zip_with(w, counts, lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, x: acc + x))


def inverted(counts: Column, filters: int = len(LETTERS)) -> Column:
    """Möbius inversion: for each set of filters the documents that fail these and no other."""
    sets = range(1 << filters)
    return _weighted(counts, [[(-1) ** (s ^ at).bit_count() * (s & at == at) for s in sets] for at in sets])


def kept_by(counts: Column, filters: int = len(LETTERS)) -> Column:
    """For each set of filters the documents that pass them all: inclusion and exclusion."""
    sets = range(1 << filters)
    return _weighted(counts, [[(-1) ** s.bit_count() * (s & ~by == 0) for s in sets] for by in sets])


def shapley(counts: Column, filters: int = len(LETTERS)) -> Column:
    """For each filter filters! times its Shapley value in the game "documents that a set removes": a set's Harsanyi dividend is its joint count with a sign, and goes to its members in equal parts."""
    share = lambda s: (-1) ** (s.bit_count() + 1) * factorial(filters) // max(1, s.bit_count())
    return _weighted(counts, [[share(s) * (s >> i & 1) for s in range(1 << filters)] for i in range(filters)])


def audit(docs: DataFrame, labels: DataFrame, by: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each part, order of the five filters and step: what is kept and removed, and what of it other filters share.

    Columns as in the contract: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. All follow from 32 joint counts a part; no order is run. An
    empty table gives no rows. See failures() for nulls, repeated rows and labels.
    """
    table = joint_counts(failures(docs, labels, by, id_col, text_col))
    n = len(LETTERS)
    own = table.select(
        "part", F.col("n").alias("joint"), *[kept_by(F.col(m)).alias(f"kept_{m}") for m in MEASURES],
        inverted(F.col("n")).alias("exactly"), shapley(F.col("n")).alias("values"),
    )
    masks = {p: [sum(1 << LETTERS.index(c) for c in p[:k]) for k in range(n + 1)] for p in map("".join, permutations(LETTERS))}
    steps = [(p, k + 1, LETTERS.index(p[k]), 1 << LETTERS.index(p[k]), m[k], m[k + 1]) for p, m in masks.items() for k in range(n)]
    plan = F.from_json(F.lit(json.dumps([dict(zip("osfmaz", x, strict=True)) for x in steps])), "array<struct<o:string,s:int,f:int,m:int,a:int,z:int>>")
    x = own.select("*", F.explode(plan).alias("x"))
    at = lambda c, i: F.get(F.col(c), i)
    before, after, this = F.col("x.a"), F.col("x.z"), F.col("x.f")
    removed = at("kept_n", before) - at("kept_n", after)
    return x.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), at("kept_n", after).alias("kept"), removed.alias("removed"),
        (at("joint", F.col("x.m")) - removed).alias("redundant"), at("exactly", F.col("x.m")).alias("unique_fails"),
        (at("kept_good", before) - at("kept_good", after)).alias("good_lost"), (at("kept_toxic", before) - at("kept_toxic", after)).alias("toxic_lost"), at("values", this).alias("shapley"),
    )


def audit_sql() -> str:
    """The same by running all orders over the patterns of failures that occur, as DuckDB SQL."""
    return r"""
with d as (select row_number() over () as row, doc_id, coalesce(lang, '') as part, coalesce(text, '') as body from documents),
w as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by body) as least from d),
l as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels group by all),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body),
    'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(doc_id <> least, least is not null)} as fails from w left join l using (doc_id)),
p as (select part, fails, map {'A': fails.A, 'B': fails.B, 'C': fails.C, 'D': fails.D, 'E': fails.E} as m, fails.A::int + fails.B::int + fails.C::int + fails.D::int + fails.E::int as many, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || x.c || y.c || z.c as o from c a, c b, c x, c y, c z where len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s as (select o, unnest([1, 2, 3, 4, 5]) as step from o),
parts as (select distinct part from d),
hit as (select p.part, o, n, good, toxic, many, m, list_position([m[o[1]], m[o[2]], m[o[3]], m[o[4]], m[o[5]]], true) as hit_at from p, o),
r as (select part, o, step, coalesce(sum(n) filter (hit_at is null or hit_at > step), 0)::bigint as kept, coalesce(sum(n) filter (hit_at = step), 0)::bigint as removed,
    coalesce(sum(n) filter (m[o[step]] and hit_at < step), 0)::bigint as redundant, coalesce(sum(n) filter (m[o[step]] and many = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (hit_at = step), 0)::bigint as good_lost, coalesce(sum(toxic) filter (hit_at = step), 0)::bigint as toxic_lost from hit join s using (o) group by all),
v as (select part, o[step] as letter, sum(removed)::bigint as shapley from r group by all)
select r.part, r.o as filter_order, r.step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from r join v on r.part = v.part and r.o[r.step] = v.letter
"""
