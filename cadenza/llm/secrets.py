"""Secret scans through a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

#: Partitions that rows without an id, or of an id that very many rows have, are dealt over.
_PARTS = 64
#: Values that are folded at once, and code points of a text that are counted from one place.
_STEP, _CHUNK = 256, 4096

#: Strings that a part of a rule may expand to before the part counts as unknown.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share; at_least: code points that `group` must have, else the match is dropped (after it was consumed)."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_names = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{any_case('api')}_?{any_case('key')}"
#: Fixed rules of the contract, in the order that breaks ties.
BASE = (
    Rule("assign", f"({_names})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further public credential formats.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _strings(node) -> frozenset[str] | None:
    """All strings that a syntax node can match, lower case; None if there are too many."""
    kind, arg = node
    if kind is op.LITERAL:
        return frozenset({chr(arg).lower()})
    if kind is op.IN and arg[0][0] is not op.NEGATE:
        chars: set[str] = set()
        for what, value in arg:
            if what is op.LITERAL:
                chars.add(chr(value).lower())
            elif what is op.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return frozenset(chars) if len(chars) <= 8 else None
    if kind is op.SUBPATTERN:
        return _product(arg[3])
    if kind is op.BRANCH:
        parts = [_product(p) for p in arg[1]]
        return None if None in parts or sum(map(len, parts)) > MOST_STRINGS else frozenset().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 4:
        own = _product(arg[2])
        if own is not None:
            every = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.islice(itertools.product(own, repeat=n), MOST_STRINGS + 1)}
            return frozenset(every) if len(every) <= MOST_STRINGS else None
    if kind is op.AT:
        return frozenset({""})
    return None


def _product(nodes) -> frozenset[str] | None:
    out = frozenset({""})
    for node in nodes:
        own = _strings(node)
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """The Boolean query of a regex: of each list (and), one set (or) has all its trigrams (and) in any text that the regex matches.

    Trigrams are of the lower-cased text. An empty query means that the rule has no mandatory
    trigram. The finite parts of the pattern between its unbounded ones give the lists; sets
    that contain another set of their list are dropped.
    """
    lists: list[list[frozenset[str]]] = []

    def close(strings: frozenset[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            lists.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    def walk(nodes) -> None:
        run = frozenset({""})
        for node in nodes:
            own = _strings(node)
            if own is not None and len(run) * len(own) <= MOST_STRINGS:
                run = frozenset(a + b for a in run for b in own)
                continue
            close(run)
            run = own if own is not None else frozenset({""})
            if own is None and node[0] is op.SUBPATTERN:
                walk(node[1][3])
            elif own is None and node[0] in (op.MAX_REPEAT, op.MIN_REPEAT) and node[1][0] > 0:
                walk(node[1][2])
        close(run)

    walk(parser.parse(pattern))
    return lists


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (trigram, doc_id), of the trigrams that some rule asks for."""
    wanted = sorted({t for r in rules for sets in trigram_query(r.pattern) for s in sets for t in s})
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = F.filter(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"), lambda t: F.contains(F.col("__text"), t))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("__text")).select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose query a document's postings satisfy, by intersecting postings.

    Each trigram is looked up in the rules' terms (a literal table of the rules' own size), and
    what is counted is bounded for each document, so no trigram's postings meet in one place.
    """
    terms = [(t, r.kind, 1 << i, k, len(s)) for r in rules for i, sets in enumerate(trigram_query(r.pattern)) for k, s in enumerate(sets) for t in s]
    need = [(r.kind, (1 << len(q)) - 1) for r in rules if (q := trigram_query(r.pattern))]
    table = F.broadcast(_literal(index, ["trigram", "kind", "part", "choice", "size"], terms))
    needed = F.broadcast(_literal(index, ["kind", "all_parts"], need))
    own = index.join(table, "trigram").groupBy("doc_id", "kind", "part", "choice", "size").count().where("count >= size")
    own = own.groupBy("doc_id", "kind").agg(F.bit_or("part").alias("parts")).join(needed, "kind").where("parts = all_parts")
    return own.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _literal(like: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of literals."""
    return like.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def _let(value: Column, body) -> Column:
    """body(value), where value is worked out once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, add) -> Column:
    """For each of the values (0 or more) the fold of those before it, from 0: block by block, as an array that grows by one is copied each time."""
    none = F.array().cast("array<int>")
    grow = lambda b, start: F.aggregate(b, F.struct(start.alias("at"), none.alias("found")), lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")), lambda acc: acc["found"])
    count = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.greatest(count, F.lit(1)) - 1) / _STEP).cast("int")), lambda k: F.slice(values, k * _STEP + 1, _STEP))

    def whole(bs: Column) -> Column:
        starts = grow(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), add)), F.lit(0))
        return F.flatten(F.zip_with(bs, starts, grow))

    return _let(blocks, whole)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, kind, end), in code points: the pieces between matches and the matches, in turn, give the places. Work and memory follow the number of matches."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"))
    sized = F.transform(parts, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), F.coalesce(F.length(x["value"]), F.lit(-1)).alias("value")))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def placed(xs: Column) -> Column:
        def made(at: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(at, i) + x["gap"]
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["hit"]).alias("end"), x["value"].alias("value"))

            kept = F.filter(F.transform(xs, one), lambda x: x["value"] >= rule.at_least)
            return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "kind", "end")]))

        return _let(_before(F.transform(xs, lambda x: x["gap"] + x["hit"]), lambda a, x: a + x), made)

    return F.when(F.regexp_like(text, pattern), _let(sized, placed)).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", into: str = "spans") -> DataFrame:
    """docs with one more column, `into`: the array of (start, rank, kind, end) of all rules' matches, by start, then rule.

    Rules with mandatory trigrams are verified on the documents that the index gives for them;
    rules without scan every document. A null text has no match; repeated rows and ids are
    verified one by one; null ids count as one id; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found_id, kinds, part, found_part = (unused(docs, c) for c in ("__id", "__kinds", "__part", "__found_part"))
    found = candidates(postings(docs, rules, id_col, text_col), rules).select(F.col("doc_id").alias(found_id), F.col("kinds").alias(kinds))
    # rows without an id, or whose id very many have, are dealt over several partitions, to each of which their kinds go
    often = lambda c: F.col(c).isNull() | (F.col(c).isin(hot) if hot else F.lit(False))
    hot = _frequent(docs, id_col)
    every = F.when(often(found_id), F.sequence(F.lit(0), F.lit(_PARTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.withColumn(found_part, F.explode(every))
    own = docs.withColumn(part, F.when(often(id_col), F.pmod(F.xxhash64(text), F.lit(_PARTS)).cast("int")).otherwise(0))
    joined = own.join(found, F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(part) == F.col(found_part)), "left")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    hits = [F.when(F.array_contains(kinds, r.kind), spans(text, r, k)).otherwise(empty) if trigram_query(r.pattern) else spans(text, r, k) for k, r in enumerate(rules)]
    return joined.withColumn(into, F.array_sort(F.concat(*hits))).drop(found_id, kinds, part, found_part)


def _frequent(docs: DataFrame, id_col: str) -> list:
    """Ids that more than a thousand rows and a thousandth of all rows share: fewer than a thousand ids."""
    share = max(1_000, docs.count() // 1_000)
    return [r[0] for r in docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where(F.col("count") > share).select(id_col).collect()]


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the same columns, and mask in place of each run of overlapping matches. Null texts stay null."""
    text, hits = F.col(text_col), unused(docs, "__spans")

    def between(chunks: Column, a: Column, z: Column) -> Column:
        """Code points a .. z - 1 of the text, from chunks of _CHUNK code points, so that no place is counted from the text's start."""
        first, last = F.floor(a / _CHUNK).cast("int"), F.floor(z / _CHUNK).cast("int")
        chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
        rest, begin = chunk(first).substr(a % _CHUNK + 1, F.lit(_CHUNK)), chunk(last).substr(F.lit(1), z % _CHUNK)
        middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, chunk(first).substr(a % _CHUNK + 1, z - a)).otherwise(F.concat(rest, middle, begin))

    def masked(chunks: Column) -> Column:
        ends = F.transform(hits, lambda x: x["end"])

        def put(before: Column) -> Column:
            new = F.filter(F.transform(hits, lambda x, i: F.struct(F.get(before, i).alias("a"), x["start"].alias("z"))), lambda x: x["z"] >= x["a"])
            kept = F.transform(new, lambda x: between(chunks, x["a"], x["z"]))
            return F.concat(F.array_join(kept, mask), F.lit(mask), between(chunks, F.array_max(ends), F.length(text)))

        return _let(_before(ends, lambda a, x: F.greatest(a, x)), put)

    clean = F.when(F.size(hits) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), masked)).otherwise(text)
    return scan(docs, rules, id_col, text_col, hits).withColumn(text_col, clean).select(*docs.columns)


def _is_any(kinds: list[str]):
    return lambda x: x["kind"].isin(kinds)


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: matches of each base kind, a digest of the base spans, and all spans."""
    base = [r.kind for r in BASE]
    found = scan(docs.select(id_col, text_col), rules, id_col, text_col, "__spans")
    counts = [F.size(F.filter("__spans", _is_any([k]))).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(listed(F.filter("__spans", _is_any(base))), 256)
    return found.select(F.col(id_col).alias("doc_id"), *counts, digest.alias("base_sha256"), listed(F.col("__spans")).alias("spans"))


def report_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same report as DuckDB SQL: every rule over every text."""
    quoted = [r.pattern.replace("'", "''") for r in rules]
    parts = [
        f"select id, k as rank, '{r.kind}' as kind, list_transform(range(1, len(hits) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0), 'size': length(hits[i]), 'value': length(vals[i])}}) as found from (select id, {k} as k, string_split_regex(body, '{p}') as gaps, regexp_extract_all(body, '{p}', 0) as hits, regexp_extract_all(body, '{p}', {r.group}) as vals from d)"
        for k, (r, p) in enumerate(zip(rules, quoted, strict=True))
    ]
    at_least = " ".join(f"when '{r.kind}' then {r.at_least}" for r in rules)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}')::bigint as n_{r.kind}" for r in BASE)
    return f"""
with d as (select row_number() over () as id, doc_id, coalesce(text, '') as body from documents),
m as ({" union all ".join(parts)}),
s as (select id, rank, kind, x.start::bigint as a, (x.start + x.size)::bigint as z from (select id, rank, kind, unnest(found) as x from m) where x.value >= case kind {at_least} end)
select any_value(d.doc_id) as doc_id, {counts.replace("filter (", "filter (where ")},
  sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) filter (where kind in ({base})), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) filter (where kind is not null), '') as spans
from d left join s using (id) group by d.id
"""
