"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets counts (words, symbols, repeated lines, words in repeated three-word windows) and four
rates in whole numbers. The rates of each language and source are gathered in quantile sketches that
merge by addition: counts of log-linear integer bins (a value below 256 is its own bin, larger ones keep
their eight leading bits, so a quantile is exact to 0.8 %). All thresholds are read from these sketches.

A rate is rejected beyond ``q75 + TIMES * spread``, where the spread is an upper quantile less the median. Both are shrunk: those of a
language and source are weighed, by its number of texts against ``WEIGHT``, with those of the language's merged sketch, and
these likewise with those of everything, so a small group takes after its language, and no group jumps from one rule to
another as it grows. A threshold is at most GUARD times that of everything, so a source that is mostly junk cannot switch a
rule off, and at least GRAIN: what a single symbol or repeat weighs in the shortest text that passes the base rule.

Defined results: a null or empty text has no words and fails the base rule; null languages and sources
are groups of their own; repeated rows and rows without an id are judged like any other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwise.llm.common import stored, table

SYMBOLS = "#*$%&|<>"
#: Rates with the upper quantile of their spread and how many spreads a text may be away: symbols, repeated lines and repeated words
#: per 1000, hundredths of a character a word.
UPPER = {"symbols": (90, 8), "lines": (95, 6), "repeats": (90, 8), "length": (90, 4)}
#: Texts that a merged sketch counts for, the bound by the threshold of everything, and one occurrence in 50 words.
WEIGHT, GUARD, GRAIN = 1000, 2, 1000 // 50


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: str) -> Column:
    """Words in three-word windows that occur twice or more; words is the name of an array column."""
    n = F.size(words)
    grams = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda x, y: x + y)

    def repeated(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, i: (x["h"] == F.coalesce(F.get(ordered, i - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get(ordered, i + 1)["h"], F.bitwise_not(x["h"]))))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(ordered, repeated))

    return let(grams, count)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    flat = rows.withColumn("flat", F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")))
    cut = flat.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " +")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    return cut.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("flat", " ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, F.size).cast("long").alias("n_lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words("words").cast("long").alias("n_repeat_words"),
    )


def rates() -> dict[str, Column]:
    """The four whole-number rates of measured rows; 0 where there is nothing to divide by."""
    per = lambda k, a, b: F.expr(f"case when {b} = 0 then 0L else ({k} * {a}) div {b} end")
    return {"symbols": per(1000, "n_symbols", "n_words"), "lines": per(1000, "n_dup_lines", "n_lines"), "repeats": per(1000, "n_repeat_words", "n_words"), "length": per(100, "word_chars", "n_words")}


def sketch_bin(value: str) -> Column:
    """A value below 256 itself, else its eight leading bits followed by zeros."""
    return F.expr(f"case when {value} < 256 then {value} else shiftleft(shiftright({value}, length(bin({value})) - 8), length(bin({value})) - 8) end")


def sketches(rows: DataFrame) -> DataFrame:
    """level, lang, source, rate, bin, n: the sketch of each language and source (2), of each language (1) and of all (0)."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("value")) for k, v in rates().items())))
    base = rows.where("n_words > 0").select("lang", "source", values.alias("x")).select("lang", "source", "x.rate", sketch_bin("x.value").alias("bin"))
    base = base.groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("n"))
    level = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    wide = base.withColumn("level", level).withColumn("lang", F.when(F.col("level") > 0, F.col("lang"))).withColumn("source", F.when(F.col("level") > 1, F.col("source")))
    return wide.groupBy("level", "lang", "source", "rate", "bin").agg(F.sum("n").alias("n"))


def quantiles(merged: DataFrame, upper: dict[str, tuple[int, int]] = UPPER) -> DataFrame:
    """level, lang, source, texts, and for each rate mid_<rate> (q75) and spread_<rate> of each sketch."""
    group = ["level", "lang", "source", "rate"]
    own = Window.partitionBy(*group)
    ranked = merged.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("texts", F.sum("n").over(own))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("texts") * p, F.col("bin")))
    high = F.coalesce(*(F.when(F.col("rate") == k, F.lit(p)) for k, (p, _) in upper.items()))
    found = ranked.groupBy(*group).agg(F.max("texts").alias("texts"), at(F.lit(50)).alias("q50"), at(F.lit(75)).alias("q75"), at(high).alias("high"))
    of = lambda k, x: F.max(F.when(F.col("rate") == k, x))
    wide = [of(k, F.col("q75")).alias(f"mid_{k}") for k in upper] + [of(k, F.col("high") - F.col("q50")).alias(f"spread_{k}") for k in upper]
    return found.groupBy("level", "lang", "source").agg(F.max("texts").alias("texts"), *wide)


def thresholds(merged: DataFrame, upper: dict[str, tuple[int, int]] = UPPER, weight: int = WEIGHT) -> DataFrame:
    """lang2, source2 and cut_<rate> of each language and source."""
    found = quantiles(merged, upper)
    names = ["texts", *(f"{x}_{k}" for x in ("mid", "spread") for k in upper)]
    pick = lambda level, keys: found.where(F.col("level") == level).select(*(F.col(k).alias(f"{k}{level}") for k in keys), *(F.col(x).alias(f"{x}{level}") for x in names))
    both, one, every = pick(2, ["lang", "source"]), pick(1, ["lang"]), pick(0, [])
    # the quantiles of a pair, its language and everything (one row) side by side
    chosen = both.join(one, both.lang2.eqNullSafe(one.lang1)).join(F.broadcast(every))

    def shrunk(x: str) -> Column:
        language = f"((texts1 * {x}1 + {weight} * {x}0) div (texts1 + {weight}))"
        return F.expr(f"(texts2 * {x}2 + {weight} * {language}) div (texts2 + {weight})")

    cuts = []
    for k, (_, times) in upper.items():
        general = F.greatest(F.lit(GRAIN), F.col(f"mid_{k}0") + times * F.col(f"spread_{k}0"))
        cuts.append(F.greatest(F.lit(GRAIN), F.least(shrunk(f"mid_{k}") + times * shrunk(f"spread_{k}"), GUARD * general)).alias(f"cut_{k}"))
    return chosen.select("lang2", "source2", *cuts)


def judged(rows: DataFrame, upper: dict[str, tuple[int, int]] = UPPER, weight: int = WEIGHT) -> DataFrame:
    """measured rows with base_failed and kept. rows is read twice."""
    chosen = thresholds(sketches(rows), upper, weight)
    found = rows.join(chosen, rows.lang.eqNullSafe(chosen.lang2) & rows.source.eqNullSafe(chosen.source2), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for k, value in rates().items():
        # a text without a group has no words and fails the base rule
        within = within & F.coalesce(value <= F.col(f"cut_{k}"), F.lit(True))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its counts, whether the base rule fails, and whether it is kept."""
    rows = stored(measured(table(spark, sf_dir, "documents")))
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = "[^\\x20\\x09-\\x0D]+"
_RATES = "(values ('symbols', 90, 8), ('lines', 95, 6), ('repeats', 90, 8), ('length', 90, 4)) as f(rate, high, times)"

ORACLE = rf"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) as ls
  from documents
), g as (
  select doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)
), r as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i+1, i+2]) as p from (select *, count(*) over (partition by doc_id, gram) as c from g) where c > 1)
  group by doc_id
), m as (
  select w.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
         cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join r on w.doc_id = r.doc_id
), v as (
  select *, case when n_words = 0 then 0 else 1000 * n_symbols // n_words end as symbols, case when n_lines = 0 then 0 else 1000 * n_dup_lines // n_lines end as lines,
         case when n_words = 0 then 0 else 1000 * n_repeat_words // n_words end as repeats, case when n_words = 0 then 0 else 100 * word_chars // n_words end as length
  from m
), u as (
  unpivot (select lang, source, symbols, lines, repeats, length from v where n_words > 0) on symbols, lines, repeats, length into name rate value x
), b as (
  select lang, source, rate, case when x < 256 then x else (x >> (length(bin(x)) - 8)) << (length(bin(x)) - 8) end as bin, count(*) as n from u group by all
), s as (
  select 2 as level, lang, source, rate, bin, n from b
  union all select 1, lang, null, rate, bin, sum(n) from b group by all
  union all select 0, null, null, rate, bin, sum(n) from b group by all
), k as (
  select level, lang, source, rate, max(texts) as texts, min(bin) filter (upto * 100 >= texts * 75) as mid, min(bin) filter (upto * 100 >= texts * high) - min(bin) filter (upto * 100 >= texts * 50) as spread, max(times) as times
  from (select *, sum(n) over (partition by level, lang, source, rate order by bin) as upto, sum(n) over (partition by level, lang, source, rate) as texts from s join {_RATES} using (rate))
  group by level, lang, source, rate
), p as (
  select a.lang, a.source, a.rate, greatest(20, least((a.texts * a.mid + 1000 * ((l.texts * l.mid + 1000 * e.mid) // (l.texts + 1000))) // (a.texts + 1000) + a.times * ((a.texts * a.spread + 1000 * ((l.texts * l.spread + 1000 * e.spread) // (l.texts + 1000))) // (a.texts + 1000)), 2 * greatest(20, e.mid + e.times * e.spread))) as cut
  from k a join k l on a.level = 2 and l.level = 1 and a.rate = l.rate and a.lang is not distinct from l.lang join k e on e.level = 0 and e.rate = a.rate
), o as (
  select lang, source, max(cut) filter (rate = 'symbols') as c1, max(cut) filter (rate = 'lines') as c2, max(cut) filter (rate = 'repeats') as c3, max(cut) filter (rate = 'length') as c4
  from p group by lang, source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(symbols <= c1 and lines <= c2 and repeats <= c3 and length <= c4, true) as kept
from v left join o on v.lang is not distinct from o.lang and v.source is not distinct from o.source
"""
