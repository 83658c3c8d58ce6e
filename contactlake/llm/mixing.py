"""Mixing sources to target weights: soft domain membership and projected-gradient least-squares rates. DataFrame functions only."""

from __future__ import annotations

import math
import uuid
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_words, discard, let, stored

#: The domains that labels tell apart, and their share of the mixed tokens.
TARGETS = {"clean": 0.90, "poor": 0.07, "toxic": 0.03}


@dataclass(frozen=True)
class Mixing:
    """targets: weights by domain. keep: if given, a domain whose tokens aren't lowered: the whole grows instead, and a document
    that most likely belongs to it has a rate of 1 or more, which may put the targets out of reach.

    sample_rows: about so many labelled rows (by a hash of the id) train the classifier, the documented bound; buckets:
    hashed words, of which those seen in min_count sampled rows or more count; most: bounds what one word can say.
    caution and weight: how many standard errors evidence is drawn towards nothing, and what it is multiplied by; the
    pair that does best on held-out halves of the sample is taken. max_rate: how often a document may enter. Rates are found when no domain's share is further than `near` from the least-squares optimum; `steps` bounds
    the search, which fails if it takes more.
    """

    targets: dict[str, float] = field(default_factory=lambda: dict(TARGETS))
    keep: str | None = None
    sample_rows: int = 8000
    buckets: int = 1 << 15
    min_count: int = 3
    most: float = 4.0
    caution: tuple[float, ...] = (2.0, 3.0)
    weight: tuple[float, ...] = (1.0, 0.5, 0.25, 0.12)
    max_rate: float = math.inf
    steps: int = 100_000
    near: float = 1e-4


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when((quality == 1) & (toxic == 0), "clean")


def features(text: Column, buckets: int) -> Column:
    """The distinct buckets of a text's lower-cased words; runs of ASCII punctuation are words of their own."""
    apart = F.regexp_replace(F.lower(text), r"([!-/:-@\[-`{-~]+)", " $1 ")
    return F.array_distinct(F.transform(blank_words(apart), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def numbers(spark: SparkSession, values) -> Column:
    """A constant array of doubles. It is a scalar subquery: as a literal every plan's text would spell it out, and the driver keeps the texts of all jobs."""
    told = pa.array([[float(f"{x:.4g}") for x in values]], pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"v": told})).scalar()


def evidence(counts: np.ndarray, sizes: np.ndarray, m: Mixing, caution: float) -> np.ndarray:
    """[domain, bucket]: ln of how much likelier a document with the word is in the domain than elsewhere.

    Pseudo-counts follow the domains' shares, so a small domain gains nothing from a word that nobody uses, and the
    result is drawn towards 0 by `caution` standard errors, so what chance explains says nothing.
    """
    out = np.zeros(counts.shape)
    total, seen = sizes.sum(), counts.sum(axis=0)
    for d, own in enumerate(sizes):
        if 0 < own < total:
            s = own / total
            a, b = counts[d] + s, seen - counts[d] + 1 - s
            odds = np.log(a / (own + 2 * s)) - np.log(b / (total - own + 2 * (1 - s)))
            out[d] = np.sign(odds) * np.maximum(0, np.abs(odds) - caution * np.sqrt(1 / a + 1 / b))
    out[:, seen < m.min_count] = 0
    return np.clip(out, -m.most, m.most)


def with_evidence(rows: DataFrame, e: np.ndarray) -> tuple[DataFrame, list[Column]]:
    """rows and, for logits(), a column of them for each of the arrays.

    Use each once: the optimizer then puts the subquery in its place, and no row carries the array. In a lambda a subquery may not be written.
    """
    known = {f"_e{i}_{uuid.uuid4().hex[:6]}": numbers(rows.sparkSession, x) for i, x in enumerate(e)}
    return rows.withColumns(known), [F.col(c) for c in known]


def logits(b: Column, prior: np.ndarray, known: list[Column]) -> list[Column]:
    """ln prior and summed evidence of each domain, for a column of buckets."""
    adder = lambda known: lambda a, x: a + F.get(known, x)
    return [F.lit(float(p)) + F.aggregate(b, F.lit(0.0), adder(x)) for p, x in zip(prior, known, strict=True)]


def posteriors(raw: list[Column]) -> list[Column]:
    """Softmax."""
    top = F.greatest(*raw) if len(raw) > 1 else raw[0]
    odds = [F.exp(x - top) for x in raw]
    return [x / sum(odds[1:], odds[0]) for x in odds]


@dataclass(frozen=True)
class Model:
    """names: the domains with labels; prior and evidence by domain."""

    names: tuple[str, ...]
    prior: np.ndarray
    evidence: np.ndarray


def train(docs: DataFrame, labels: DataFrame, m: Mixing, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Priors and evidence from words' document counts in the labelled sample.

    What comes to the driver is a count per bucket, domain and half: a fixed number. Each half is scored by what the
    other taught, to choose caution and weight by log loss. An id with several labels takes the first by (domain);
    labels that name no domain are left out. A target domain without a label in the sample has no evidence: no document
    is held to belong to it, and its target is dropped with a warning. Without any labels nothing can be told apart and
    all domains are equally likely.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), domain(F.col("quality"), F.col("toxic")).alias("domain")).where("id is not null").where(F.col("domain").isin(*m.targets)).groupBy("id").agg(F.min("domain").alias("domain"))
    mod = max(1, known.count() // m.sample_rows)
    hashed = F.xxhash64(F.lit("mixing"), F.col("id"))
    picked = F.pmod(hashed, F.lit(mod)) == 0
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(picked)
    half = F.pmod(F.shiftright(hashed, 20), F.lit(2)).cast("int")
    sample = stored(texts.join(known.where(picked), "id").select("domain", half.alias("half"), features(F.col("text"), m.buckets).alias("b")), "labelled")
    rows = {(r[0], r[1]): r[2] for r in sample.groupBy("domain", "half").count().collect()}
    names = tuple(d for d in m.targets if rows.get((d, 0), 0) + rows.get((d, 1), 0))
    if not names:
        discard(sample)
        return Model(tuple(m.targets), np.zeros(len(m.targets)), np.zeros((len(m.targets), m.buckets)))
    if len(names) < len(m.targets):
        warnings.warn("mixing: no labels, so no target, for " + ", ".join(d for d in m.targets if d not in names), stacklevel=3)
    sizes = np.array([[rows.get((d, h), 0) for d in names] for h in (0, 1)])
    counts = np.zeros((2, len(names), m.buckets))
    cells = [F.count_if((F.col("half") == h) & (F.col("domain") == d)) for h in (0, 1) for d in names]
    for b, *n in sample.select("domain", "half", F.explode("b").alias("b")).groupBy("b").agg(*cells).collect():
        counts[:, :, b] = np.array(n).reshape(2, len(names))
    prior = lambda s: np.log((s + 0.5) / (s + 0.5).sum())
    best = (m.caution[0], m.weight[0])
    if (sizes.sum(axis=1) > 0).all() and len(names) > 1:
        first = F.col("half") == 0

        def by_half(values: list[list[Column]]) -> list[Column]:
            """What the second half told where a row lies in the first, and the other way round."""
            return [F.when(first, x).otherwise(y) for x, y in zip(values[1], values[0], strict=True)]

        ways = [(c, h) for c in m.caution for h in (0, 1)]
        scored, known = with_evidence(sample, np.concatenate([evidence(counts[h], sizes[h], m, c) for c, h in ways]))
        raw = {w: logits(F.col("b"), np.zeros(len(names)), known[i * len(names) : (i + 1) * len(names)]) for i, w in enumerate(ways)}
        told = [by_half([raw[c, h] for h in (0, 1)]) for c in m.caution]
        scored = scored.select("domain", "half", *[F.array(*x).alias(f"s{i}") for i, x in enumerate(told)])
        priors = by_half([[F.lit(float(x)) for x in prior(sizes[h])] for h in (0, 1)])
        own = F.array_position(F.array(*map(F.lit, names)), F.col("domain")).cast("int") - 1
        pairs = [(c, w) for c in m.caution for w in m.weight]
        loss = [F.sum(-F.log(F.greatest(F.get(F.array(*posteriors([x + F.col(f"s{m.caution.index(c)}")[d] * w for d, x in enumerate(priors)])), own), F.lit(1e-12)))) for c, w in pairs]
        best = min(zip(scored.agg(*loss).first(), pairs, strict=True))[1]
    discard(sample)
    whole = sizes.sum(axis=0)
    return Model(names, prior(whole), evidence(counts.sum(axis=0), whole, m, best[0]) * best[1])


def memberships(docs: DataFrame, model: Model, m: Mixing, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and p_<domain>, posteriors that add up to one (0 for a domain without labels)."""
    text = F.col(text_col).cast("string")
    rows, known = with_evidence(docs.withColumn("n_tokens", F.size(blank_words(text)).cast("long")), model.evidence)
    scores = let(features(text, m.buckets), lambda b: F.struct(*[x.alias(d) for d, x in zip(model.names, logits(b, model.prior, known), strict=True)]))
    rows = rows.select(*docs.columns, "n_tokens", scores.alias("_s"))
    told = dict(zip(model.names, posteriors([F.col(f"_s.{d}") for d in model.names]), strict=True))
    return rows.withColumns({f"p_{d}": told.get(d, F.lit(0.0)) for d in m.targets}).drop("_s")


def projected_gradient(tokens: np.ndarray, p: np.ndarray, share: np.ndarray, low: np.ndarray, m: Mixing) -> tuple[np.ndarray, np.ndarray]:
    """(rates, shares reached): least squares of the shares' weighted distance, over rates from low to max_rate.

    tokens: each cell's part of the whole. Steps of the gradient, scaled by a cell's tokens, start at 1 with the
    longest safe stride, carry momentum that is dropped when it points uphill, and are cut to the bounds. The search
    ends when a step moves no domain's share by 0.01 of near, or fails.
    """
    w = 1 / np.maximum(share, 0.01)
    stride = 1 / max(1e-300, np.linalg.eigvalsh(np.sqrt(w)[:, None] * ((p * tokens[:, None]).T @ p) * np.sqrt(w)).max())
    reached = lambda r: (tokens * r) @ p
    rate = ahead = np.clip(np.ones(len(tokens)), low, m.max_rate)
    pace = 1.0
    for _ in range(m.steps):
        after = np.clip(ahead - stride * p @ (w * (reached(ahead) - share)), low, m.max_rate)
        plain = np.clip(rate - stride * p @ (w * (reached(rate) - share)), low, m.max_rate)
        if np.abs(reached(plain) - reached(rate)).max() <= 1e-4 * m.near and np.abs(reached(after) - reached(rate)).max() <= 1e-2 * m.near:
            return rate, reached(rate)
        if (tokens * (ahead - after) * (after - rate)).sum() > 0:
            pace, after = 1.0, plain
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, rate, pace = after + (pace - 1) / faster * (after - rate), after, faster
    raise RuntimeError(f"mixing rates: not at the optimum after {m.steps} steps")


def fitted_rates(rows: DataFrame, m: Mixing) -> DataFrame:
    """rows (with n_tokens, p_<domain>) with rate, so that expected domain tokens meet their targets.

    Minimises the sum over domains of w (expected - target)^2, w the inverse of its target weight (0.01 at least),
    by projected gradient from rates of 1. A rate's gradient depends on its document's posteriors alone, so documents of
    nearly equal ones (a cell of at most 20,000) take every step together: one distributed pass sums tokens and expected
    domain tokens by cell, which is all a step needs, and the steps run on these sums. Cells' posteriors are means by
    tokens, so the totals are those of the documents. Targets that no rates can meet are met as nearly as
    least squares can, with a warning that gives the shares. Domains no document belongs to have no target.
    """
    names = list(m.targets)
    k = len(names)
    bins = max(2, min(100, int(10_000 ** (1 / max(1, k - 1)))) - 1)
    p = [F.col(f"p_{d}") for d in names]
    likely = F.lit(False)
    if m.keep in names:
        likely = p[names.index(m.keep)] >= F.greatest(*p) if k > 1 else F.lit(True)
    cell = likely.cast("int")
    for x in p[:-1]:
        cell = cell * (bins + 1) + F.round(x * bins).cast("int")
    n = F.col("n_tokens")
    sums = rows.groupBy(cell.alias("cell")).agg(F.sum(n), *[F.sum(n * x) for x in p]).collect()  # a row per cell
    tokens = np.array([float(r[1] or 0) for r in sums])
    if not tokens.sum():
        return rows.withColumn("rate", F.lit(1.0))
    held = np.array([[float(x or 0) for x in r[2:]] for r in sums])
    mean = held / np.maximum(tokens, 1)[:, None]
    now = held.sum(axis=0)
    share = np.array([m.targets[d] if y > 0 else 0.0 for d, y in zip(names, now, strict=True)])
    share = share / share.sum() if share.sum() else share
    whole = now.sum()
    codes = np.array([r[0] for r in sums])
    low = np.zeros(len(codes))
    if m.keep in names and share[names.index(m.keep)] > 0:
        whole = max(whole, now[names.index(m.keep)] / share[names.index(m.keep)])
        low[codes // (bins + 1) ** (k - 1) == 1] = 1.0
    rate, reached = projected_gradient(tokens / whole, mean, share, low, m)
    if np.abs(reached - share).max() > m.near:
        warnings.warn("mixing: no rates meet the targets; shares are " + ", ".join(f"{d} {y:.4f} for {z:.4f}" for d, y, z in zip(names, reached, share, strict=True)), stacklevel=2)
    of_cell = np.ones(2 * (bins + 1) ** (k - 1))
    of_cell[codes] = rate
    return rows.withColumn("rate", F.round(F.coalesce(F.get(numbers(rows.sparkSession, of_cell), cell), F.lit(1.0)), 4))


def _drawn(rows: DataFrame, id_col: str, text_col: str) -> Column:
    """A number from 0 to 1 by a hash of id and text."""
    return F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))), F.lit(1 << 30)) / float(1 << 30)


def _copies() -> Column:
    return F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")


def mix_sources(docs: DataFrame, labels: DataFrame, m: Mixing | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, p_<domain>…, rate, copies) for every row of docs.

    copies: how often the row enters the mix, the whole part of the rate and one more with the odds of the rest, by a
    hash of id and text, so equal rows are treated alike and any rerun agrees. A null text has no tokens, the
    prior's posteriors and the rate they give. A null source stays null; a null id is hashed like any other. Repeated
    rows each count. Equal posteriors tie: the domain that is kept wins. Other columns are ignored. An empty table
    gives an empty result; see train() on domains without labels and fitted_rates() on targets out of reach.
    """
    m = m or Mixing()
    model = train(docs, labels, m, id_col, text_col)
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = memberships(rows.withColumn("draw", _drawn(rows, "doc_id", "text")), model, m)
    out = fitted_rates(stored(rows.drop("text"), "memberships"), m)
    return out.select("doc_id", "source", "n_tokens", *[f"p_{d}" for d in m.targets], "rate", _copies().cast("long").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, m: Mixing | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as its copies say; columns as they are. Rows stay where they lie."""
    m = m or Mixing()
    model = train(docs, labels, m, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = memberships(rows.withColumn("draw", _drawn(rows, "doc_id", "text")), model, m)
    out = fitted_rates(stored(rows.drop("doc_id", "text"), "mixed"), m)
    return out.withColumn("n", _copies().cast("int")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
