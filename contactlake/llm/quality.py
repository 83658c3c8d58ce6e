"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost. DataFrame functions only."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, blank_words, discard, let, stored

#: Fixed: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Bounds of the rules; a document is rejected beyond any of them.

    The cost and rejection of the rules are measured on about sample_rows rows, drawn at random, each evaluated `times`
    times over. They set the order of the rules only, which never shows in the verdict.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_symbols_per_100_words: int = 10
    min_word_chars_per_100_words: int = 200
    max_word_chars_per_100_words: int = 1500
    max_dup_line_percent: int = 50
    max_capital_percent: int = 60
    sample_rows: int = 1000
    times: int = 2


def repeat_words(words: Column, k: int) -> Column:
    """Words of an array that lie in a run of k words found at least twice in it.

    Runs are compared by a 64-bit hash; only a text whose runs aren't all distinct is sorted to find them.
    """

    def starts(h: Column) -> Column:
        """Ascending starts of runs found elsewhere too."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            near = lambda d: F.coalesce(F.get(s, d)["h"], F.lit(None))
            hit = F.transform(s, lambda x, i: F.when((near(i - 1) == x["h"]) | (near(i + 1) == x["h"]), x["i"]))
            return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))

        return let(pairs, flagged)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts(h), covered))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))

    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(let(let(words, hashed), of))


def dup_lines(text: Column) -> Column:
    """Lines (between newlines) with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _stripped(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def counts(text: Column, words: Column, r: QualityRules) -> dict[str, Column]:
    """What is counted, by name, in terms of the text and its words."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": _stripped(text, BLANKS).cast("long"),
        "n_symbols": (F.length(text) - _stripped(text, SYMBOLS)).cast("long"),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(words, r.window),
    }


def rules(c: dict[str, Column], text: Column, r: QualityRules) -> dict[str, Column]:
    """Rejecting conditions by name, each with all that it counts; the first two are the base."""
    n = c["n_words"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    capitals, small = (F.length(text) - _stripped(text, x) for x in (letters.upper(), letters))
    lines = F.length(text) - _stripped(text, "\n") + 1
    return {
        "few_words": n < r.min_words,
        "repeats": 100 * c["n_repeat_words"] > r.max_repeat_percent * n,
        "symbols": 100 * c["n_symbols"] > r.max_symbols_per_100_words * n,
        "short_words": 100 * c["word_chars"] < r.min_word_chars_per_100_words * n,
        "long_words": 100 * c["word_chars"] > r.max_word_chars_per_100_words * n,
        "lines": (c["n_dup_lines"] >= 3) & (100 * c["n_dup_lines"] > r.max_dup_line_percent * lines),
        "capitals": 100 * capitals > r.max_capital_percent * (capitals + small),
    }


#: The rules beyond the base.
MORE_RULES = ("symbols", "short_words", "long_words", "lines", "capitals")


def measure(sample: DataFrame, conditions: dict[str, Column], times: int) -> dict[str, tuple[float, int]]:
    """(seconds, rejected rows) of each rule alone over the stored sample (text, words).

    Every row is evaluated `times` times over, with what a pass over the rows costs anyway taken off; the lesser of two
    runs counts.
    """
    many = sample.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def run(bad: Column) -> tuple[float, int]:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            hits = many.agg(F.count_if(bad & F.col("_k").isNotNull())).first()[0]
            best.append((time.perf_counter() - began, hits // times))
        return min(best)

    idle = run(F.col("text").isNotNull())[0]
    return {name: (max(1e-6, took - idle), hits) for name, (took, hits) in ((n, run(b)) for n, b in sorted(conditions.items()))}


def order_rules(found: dict[str, tuple[float, int]], rows: int) -> list[str]:
    """Names by rejection per cost, most first; rules that reject nothing follow, cheapest first; ties go by name.

    Cost and rejection rate count in steps of powers of four and two, so runs that measure nearly alike agree.
    """
    step = lambda x, base: round(math.log(x, base))
    floor = max(took for took, _ in found.values()) / 64 if found else 1.0

    def rank(name: str) -> tuple:
        took, hits = found[name]
        cost = 2 * step(max(took, floor) / floor, 4)
        return (0, cost - step(hits / max(1, rows), 2), name) if hits else (1, cost, name)

    return sorted(found, key=rank)


def chosen_order(docs: DataFrame, r: QualityRules, text_col: str = "text", names: tuple[str, ...] | None = None) -> list[str]:
    """The order for a table, measured on a sample of it; names: the rules to order, all by default.

    Rows are drawn one by one whatever they hold, so null ids and repeated rows don't swell the sample.
    """
    rows = docs.count()
    picked = docs.sample(r.sample_rows / rows, 1) if rows > r.sample_rows else docs
    sample = stored(_with_words(picked, text_col).select("text", "words"), "sample")
    conditions = rules(counts(F.col("text"), F.col("words"), r), F.col("text"), r)
    found = measure(sample, {n: c for n, c in conditions.items() if names is None or n in names}, r.times)
    out = order_rules(found, sample.count())
    discard(sample)
    return out


def _with_words(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    rows = docs.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("words", blank_words(F.col("text")))


def quality_verdicts(docs: DataFrame, r: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    kept is false if base_failed (under min_words words, or over max_repeat_percent of the words in repeated runs),
    else if any rule rejects. Rules run as one CASE, in the order measured on a sample unless `order` names one. The
    counts of the base are part of the result here and cost the same in any order; passing() counts only what the
    cascade asks for. A null text counts as empty and fails the base. Repeated rows and rows with a null id are judged
    by their own text; other columns of docs are ignored. An empty table gives an empty result.
    """
    r = r or QualityRules()
    if order is None:
        order = chosen_order(docs, r, text_col, MORE_RULES)
    rows = _with_words(docs, text_col, F.col(id_col).alias("doc_id"))
    counted = counts(F.col("text"), F.col("words"), r)
    rows = rows.select("doc_id", "text", *[c.alias(n) for n, c in counted.items()])
    known = {n: F.col(n) for n in counted}
    conditions = rules(known, F.col("text"), r)
    base = conditions["few_words"] | conditions["repeats"]
    cascade = F.when(F.col("base_failed"), False)
    for name in order:
        cascade = cascade.when(conditions[name], False)
    return rows.withColumn("base_failed", base).select("doc_id", *known, "base_failed", cascade.otherwise(True).alias("kept"))


def passing(docs: DataFrame, r: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of docs that quality_verdicts() keeps, as they are; rows stay where they lie.

    The base's rules join the cascade: a rule counts only what it needs, and only where no rule before it rejects.
    """
    r = r or QualityRules()
    if order is None:
        order = chosen_order(docs, r, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def kept(words: Column) -> Column:
        conditions = rules(counts(text, words, r), text, r)
        cascade = F.when(conditions[order[0]], False)
        for name in order[1:]:
            cascade = cascade.when(conditions[name], False)
        return cascade.otherwise(True)

    return docs.where(let(blank_words(text), kept))
