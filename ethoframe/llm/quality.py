"""Quality rules: a table of thresholds compiled into one Spark projection.

Each rule bounds one measured column from below, above or both; ``compile_rules``
turns the table into a single boolean expression and the names of the rules that
failed. Everything is built from Spark functions, so a scan with this projection
never leaves the JVM and needs no shuffle.

Defined results: a null text has no words; rows are judged on their own, so
repeated rows and ties get equal verdicts; other columns pass through untouched
unless they bear the name of a measure, which then replaces them; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns_of, row_of

#: Frequent function words of the four languages of the corpus (a parameter).
STOP_WORDS = (
    "the of and to in is that it was for on be with as by at this from have are "
    "de la le et les des en un une du que est pour dans qui par sur pas au avec "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch "
    "el los las y del se por con para una su al lo como"
)


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    #: Texts with fewer words than this are not judged by the rule.
    from_words: int = 0


#: The production table. The first two are the base rules.
RULES = (
    Rule("few_words", "n_words", least=10),
    Rule("repeats", "repeat_percent", most=20.0),
    Rule("word_length", "mean_word_chars", least=2.0, most=14.0),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("stop_words", "stop_percent", least=2.0, from_words=50),
    Rule("line_repeats", "dup_line_percent", most=50.0),
    Rule("stutter", "stutter_percent", most=30.0),
)
BASE_RULES = ("few_words", "repeats")


def _hit(rule: Rule) -> Column:
    value, fails = F.col(rule.measure), F.lit(False)
    if rule.least is not None:
        fails = fails | (value < F.lit(rule.least))
    if rule.most is not None:
        fails = fails | (value > F.lit(rule.most))
    return F.coalesce(fails & (F.col("n_words") >= rule.from_words), F.lit(False))


def _covered(starts: Column, width: int) -> Column:
    """Words covered by windows of ``width`` at these ascending starts."""
    n = F.size(starts)
    gaps = F.transform(
        F.slice(starts, 2, F.greatest(n - 1, F.lit(0))),
        lambda x, i: F.least(x - F.element_at(starts, i + 1), F.lit(width)),
    )
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(width), lambda a, x: a + x))


#: The columns that ``measures`` adds.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_stop_words",
    "repeat_percent", "mean_word_chars", "stutter_percent", "symbols_per_word", "stop_percent", "dup_line_percent",
)


def measures(docs: DataFrame, text: str = "text", width: int = 5, stop_words: str = STOP_WORDS) -> DataFrame:
    """Adds the measured columns; windows of ``width`` words that occur twice or
    more in the text are compared by a 64-bit hash."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(stop_words.split())])
    docs, whole = docs.select(row_of(docs), F.coalesce(F.col(text), F.lit("")).alias("_body")), docs
    body = F.col("_body")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_words": F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)), "_lines": lines})
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - width),
        lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(width)]),
    )
    df = df.withColumn("_windows", F.when(F.size("_words") > width, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_ordered", F.when(F.col("_twice"), ordered))
    n = F.size("_ordered")
    twice = F.filter(
        "_ordered",
        lambda x, k: ((k > 0) & (F.get(F.col("_ordered"), k - 1)["h"] == x["h"]))
        | ((k + 1 < n) & (F.get(F.col("_ordered"), k + 1)["h"] == x["h"])),
    )
    df = df.withColumn("_starts", F.when(F.col("_twice"), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_twice"), _covered(F.col("_starts"), width)).otherwise(0).cast("long"),
            "n_stutters": F.size(
                F.filter(F.transform("_words", lambda w, i: (i > 0) & (w == F.get(F.col("_words"), i - 1))), lambda x: x)
            ).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.array_contains(stop, F.lower(w)))).cast("long"),
        }
    )
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    df = df.withColumns(
        {
            "repeat_percent": F.lit(100.0) * F.col("n_repeat_words") / words,
            "mean_word_chars": F.col("word_chars") / words,
            "stutter_percent": F.lit(100.0) * F.col("n_stutters") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "stop_percent": F.lit(100.0) * F.col("n_stop_words") / words,
            "dup_line_percent": F.lit(100.0) * F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        }
    )
    return df.select(*columns_of(whole, without=MEASURES), *MEASURES)


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(true where any rule fails, array of the names of failed rules)."""
    fails = F.lit(False)
    for rule in rules:
        fails = fails | _hit(rule)
    names = F.array_compact(F.array(*[F.when(_hit(r), F.lit(r.name)) for r in rules]))
    return fails, names


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with its measures, ``kept`` and ``failed_rules``."""
    fails, names = compile_rules(rules)
    return measures(docs, text, width).withColumns({"kept": ~fails, "failed_rules": names})


def base_failed(rules: tuple[Rule, ...] = RULES) -> Column:
    return compile_rules(tuple(r for r in rules if r.name in BASE_RULES))[0]
