"""Which of two languages a segment is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import stripped
from .text import clock, english_final, latin_ratio, repetition


def louder(p_ja: Column, p_en: Column, default: str = "ja") -> Column:
    """The likelier of ja and en, ja of equal ones; the default where neither is known."""
    return F.when(p_ja.isNull() & p_en.isNull(), default).when(F.coalesce(p_en, F.lit(0.0)) > F.coalesce(p_ja, F.lit(0.0)), "en").otherwise("ja")


def by_identification(p_ja: Column, p_en: Column, ja_text: Column, margin: float = 0.0, mix: float = 0.15) -> Column:
    """ja, en, or mix where both have at least `mix` (en if the Japanese text is mostly Latin, since it leaked)."""
    plain = F.when(p_en > p_ja + margin, "en").otherwise("ja")
    if mix <= 0:
        return plain
    return F.when(F.least(p_ja, p_en) >= mix, F.when(latin_ratio(ja_text) > 0.6, "en").otherwise("mix")).otherwise(plain)


def by_logprob(ja: Column, en: Column, margin: float = 0.0) -> Column:
    """A missing score ranks as -9."""
    return F.when(F.coalesce(en, F.lit(-9.0)) > F.coalesce(ja, F.lit(-9.0)) + margin, "en").otherwise("ja")


def by_both(p_ja: Column, p_en: Column, en_text: Column, margin: float = 0.0) -> Column:
    """en where it is identified and its text doesn't repeat itself."""
    return F.when((p_en > p_ja + margin) & (repetition(en_text) >= 0.35), "en").otherwise("ja")


def body_lines(rows: DataFrame, lang: Column) -> DataFrame:
    """(n, part, start, lang, line): a line for each chosen text, two for a mix; texts that are empty give none."""
    ja, en = stripped(F.col("ja_text")), english_final(F.col("en_text"))
    one = F.when(lang == "en", F.array(F.struct(F.lit("en").alias("l"), en.alias("t")))).otherwise(F.array(F.struct(F.lit("ja").alias("l"), ja.alias("t"))))
    both = F.array(F.struct(F.lit("ja").alias("l"), ja.alias("t")), F.struct(F.lit("en").alias("l"), en.alias("t")))
    parts = F.when(lang == "mix", F.when((ja != "") | (en != ""), both).otherwise(F.slice(both, 1, 0))).otherwise(F.filter(one, lambda x: x["t"] != ""))
    tag = F.when(F.col("x.l") == "en", "**EN**").otherwise("JA")
    mark = F.when(F.col("lang") == "mix", "⚠MIX ").otherwise("")
    own = rows.withColumn("lang", lang).select("n", "start", "lang", F.posexplode(parts).alias("part", "x"))
    return own.select("n", "part", "start", "lang", F.concat(F.lit("- `"), clock(F.col("start")), F.lit("` "), mark, tag, F.lit(" "), F.col("x.t")).alias("line"))


def body_counts(rows: DataFrame, lang: Column) -> DataFrame:
    """(kind, n) for ja, en, mix and empty."""
    ja, en = stripped(F.col("ja_text")), english_final(F.col("en_text"))
    text = F.when(lang == "mix", F.concat(ja, en)).when(lang == "en", en).otherwise(ja)
    return rows.select(F.when(text == "", "empty").otherwise(lang).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def rule_report(rows: DataFrame, margin: float = 0.0, mix: float = 0.15) -> DataFrame:
    """One row that compares the rules: what each gives to en, in rows and minutes, where they differ, and how far each can be trusted."""
    c = F.col
    picks = {"lid": by_identification(c("p_ja"), c("p_en"), c("ja_text"), margin, 0), "logprob": by_logprob(c("ja_logprob"), c("en_logprob"), margin), "both": by_both(c("p_ja"), c("p_en"), c("en_text"), margin)}
    own = rows.withColumns({k: v for k, v in picks.items()} | {"ja_rep": repetition(c("ja_text")), "en_rep": repetition(c("en_text"))})
    leaked = (latin_ratio(c("ja_text")) > 0.6) & (F.length("ja_text") > 20)
    mixed = F.least("p_ja", "p_en") >= mix
    broken = (F.length("en_text") > 24) & (c("en_rep") < 0.35)
    seconds = F.round(F.sum("dur"), 3)
    cols = [F.count("*").alias("n"), seconds.alias("seconds")]
    for k in picks:
        cols += [F.count_if(c(k) == "en").alias(f"{k}_en"), F.round(F.sum(F.when(c(k) == "en", c("dur")).otherwise(0.0)), 3).alias(f"{k}_en_seconds")]
    cols += [
        F.count_if(c("lid") != c("logprob")).alias("differ"),
        F.count_if(mixed).alias("mixed"),
        F.count_if(leaked).alias("leaked"),
        F.count_if(leaked & (c("p_en") > c("p_ja") + margin)).alias("leaked_found"),
        F.count_if((F.length("ja_text") > 24) & (c("ja_rep") < 0.35)).alias("ja_broken"),
        F.count_if(broken).alias("en_broken"),
        F.count_if(broken & (c("en_logprob") > c("ja_logprob"))).alias("en_broken_but_sure"),
    ]
    return own.agg(*cols)
