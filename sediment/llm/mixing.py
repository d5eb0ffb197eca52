"""Mixing by soft membership: domain posteriors from labelled rows, then document rates that meet token targets. Native.

The classifier is naive Bayes with normal densities of a few features: lengths, densities of signs, and how many
of a text's words belong to each domain's vocabulary, the words that most surely tell it from the others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialize, table

#: Shares of all tokens that each domain should have in the mix of the registered query and the pipeline.
TARGETS = {"good": 0.92, "poor": 0.06, "toxic": 0.02}
#: Signs whose densities are features, beside lengths; each is counted by a plain replacement.
SIGNS = {"stop": ".", "comma": ",", "bang": "!", "mark": "%*#$&", "bar": "|"}
FEATURES = ("length", "word", "line", *SIGNS)
#: Words of a domain's vocabulary at most, labelled rows it is chosen from at most (by a hash of doc_id), and what separates words.
VOCABULARY, SAMPLE = 128, 20_000
BREAKS = "".join(chr(c) for c in (*range(9, 14), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))
FLOOR = 1e-3
LEAST_VARIANCE = 1e-2
KEPT = 1.05
#: The solver sees documents by cells of posteriors of this width.
CELL = 1e-3


def occurrences(text: Column, signs: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in signs), F.lit(0))


def columns_of(vocabulary: dict[str, list[str]]) -> list[str]:
    return [f"f{i}" for i in range(len(FEATURES) + len(vocabulary))]


def words_of(text: Column) -> Column:
    """The different words of a text in lower case, and an empty one where blanks meet."""
    return F.array_distinct(F.split(F.translate(lower_ascii(text), BREAKS, " " * len(BREAKS)), " "))


def with_features(docs: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """docs with tokens (pieces between spaces and line feeds; 0 for an empty text) and columns f0, f1, ... for FEATURES and each vocabulary.

    Plain columns that are used more than once stay columns: Spark computes each of them once for a row.
    """
    text = F.coalesce("text", F.lit(""))
    tokens = F.when(F.length(text) == 0, F.lit(0)).otherwise(occurrences(text, " ") + occurrences(text, "\n") + 1).cast("long")
    per = lambda n: F.log(F.lit(FLOOR) + n / F.greatest(F.col("tokens"), F.lit(1)))
    f = [F.log(F.lit(1.0) + F.col("tokens")), per(F.length(text)), per(occurrences(text, "\n")), *(per(occurrences(text, s)) for s in SIGNS.values())]
    every = sorted({w for ws in vocabulary.values() for w in ws})
    literal = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    docs = docs.withColumn("_w", F.array_intersect(words_of(F.col("text")), literal(every)) if every else literal(every))
    f += [F.log(F.lit(0.1) + F.size(F.array_intersect("_w", literal(ws)))) for ws in vocabulary.values()]
    return docs.withColumn("tokens", tokens).withColumns({f"f{i}": x for i, x in enumerate(f)}).drop("_w")


def vocabularies(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = VOCABULARY, sample: int = SAMPLE) -> dict[str, list[str]]:
    """For each domain its words: those that more of its labelled rows have than of the others', by a likelihood-ratio test.

    At most about sample labelled rows are read. A word must stand in four rows of the domain and pass the test
    corrected for the number of words; of these the most surely told come first, equal ones by name.
    """
    rows = labelled.filter(F.col("domain").isin(domains))
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("domain", F.explode(words_of(F.col("text"))).alias("w")).groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]), "words")
    each = docs.select("doc_id").join(F.broadcast(rows), "doc_id").groupBy("domain").count().collect()
    n = {r["domain"]: r["count"] for r in each}
    total, tried = sum(n.values()), texts.count()
    out: dict[str, list[str]] = {}
    for i, d in enumerate(domains):
        here, rest = float(n.get(d, 0)), float(total - n.get(d, 0))
        if not here or not rest:
            out[d] = []
            continue
        a, b = F.col(f"n{i}").cast("double"), (sum((F.col(f"n{j}") for j in range(len(domains))), F.lit(0)) - F.col(f"n{i}")).cast("double")
        p = (a + b) / total
        x = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
        g = 2 * (x(a, here * p) + x(here - a, here * (1 - p)) + x(b, rest * p) + x(rest - b, rest * (1 - p)))
        sure = texts.filter(F.length("w") > 1).filter((a >= 4) & (a * rest > b * here)).withColumn("g", g).filter(F.col("g") > 2 * math.log(max(tried, 2)) + 8)
        out[d] = [r["w"] for r in sure.orderBy(F.desc("g"), "w").limit(most).collect()]
    discard(texts)
    return out


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain from labels (quality, toxic): toxic, else good or poor by quality; rows with neither label say nothing."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).filter("doc_id is not null and domain is not null")


def learn(measured: DataFrame, labelled: DataFrame, domains: list[str], columns: list[str]) -> dict[str, tuple[float, list[float], list[float]]]:
    """Share, means and variances of the features in each domain, over all labelled rows; variances are smoothed to the pooled ones."""
    rows = measured.select("doc_id", *columns).join(labelled, "doc_id").filter(F.col("domain").isin(domains))
    k = len(columns)
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(k)] + [F.sum(F.col(f"f{i}") ** 2).alias(f"q{i}") for i in range(k)]
    got = {r["domain"]: r for r in rows.groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()}
    total = sum(r["n"] for r in got.values())
    if not total:
        return {}
    whole = [(sum(r[f"s{i}"] for r in got.values()) / total, sum(r[f"q{i}"] for r in got.values()) / total) for i in range(k)]
    pooled = [max(q - m * m, LEAST_VARIANCE) for m, q in whole]
    out = {}
    for d, r in got.items():
        n, w = r["n"], 5.0
        mean = [(r[f"s{i}"] + w * whole[i][0]) / (n + w) for i in range(k)]
        var = [max((n * (r[f"q{i}"] / n - (r[f"s{i}"] / n) ** 2) + w * pooled[i]) / (n + w), LEAST_VARIANCE) for i in range(k)]
        out[d] = (n / total, mean, var)
    return out


def with_posteriors(rows: DataFrame, model: dict[str, tuple[float, list[float], list[float]]], domains: list[str], columns: list[str]) -> DataFrame:
    """rows with p0, p1, ...: the probabilities of domains, in place of the features; equal ones when nothing was learned, 0 for a domain without rows."""
    k = len(domains)
    if not model:
        return rows.withColumns({f"p{i}": F.lit(1.0 / k) for i in range(k)}).drop(*columns)
    scores = {}
    for i, d in enumerate(domains):
        if d not in model:
            scores[f"_s{i}"] = F.lit(-1e300)
            continue
        share, mean, var = model[d]
        terms = [(F.col(c) - mean[j]) ** 2 * F.lit(-0.5 / var[j]) for j, c in enumerate(columns)]
        scores[f"_s{i}"] = sum(terms, F.lit(math.log(share) - 0.5 * sum(math.log(2 * math.pi * v) for v in var)))
    top = F.greatest(*scores, F.lit(-1e300))
    out = rows.withColumns(scores).drop(*columns).withColumn("_m", top)
    out = out.withColumns({f"_e{i}": F.exp(F.greatest(F.col(f"_s{i}") - F.col("_m"), F.lit(-700.0))) for i in range(k)}).drop("_m", *scores)
    out = out.withColumn("_z", sum((F.col(f"_e{i}") for i in range(k)), F.lit(0.0)))
    return out.withColumns({f"p{i}": F.col(f"_e{i}") / F.col("_z") for i in range(k)}).drop("_z", *[f"_e{i}" for i in range(k)])


def rate_of(steps: list[list[float]]) -> Column:
    """The rate after projected steps: from 1, each takes p . step off, and not below 0."""
    if not steps:
        return F.lit(1.0)
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: sum((F.col(f"p{i}") * s[i] for i in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(literal, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def solve(members: DataFrame, targets: dict[str, float], budget: float | None = None, most_steps: int = 40, tolerance: float = 1e-7) -> list[list[float]]:
    """Projected-gradient steps for rates of members (tokens, p0, p1, ...) whose expected domain tokens meet the targets.

    Minimises (A r - b)' W (A r - b) over rates r >= 0, where A r has the tokens of each domain, b the
    targets' shares of the budget (all tokens unless given) and W the inverse of H = sum of tokens * p p'.
    In the metric of tokens the gradient of a document is p' W (A r - b) and 1 is a safe step length.
    A step is the few numbers W (A r - b): one pass over the members gives it, and the rates follow from
    the steps taken so far, so no rates are stored.
    """
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    h = members.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"), *[F.coalesce(F.sum(F.col("tokens") * p[i] * p[j]), F.lit(0.0)) for i in range(k) for j in range(k)]).first()
    if not h[0]:
        return []
    m = np.array(h[1:], float).reshape(k, k)
    w = np.linalg.pinv(m + np.eye(k) * 1e-9 * np.trace(m))
    b = np.array(list(targets.values())) / sum(targets.values()) * (budget or float(h[0]))
    steps: list[list[float]] = []
    for _ in range(most_steps):
        r = rate_of(steps)
        got = np.array(members.withColumn("r", r).agg(*[F.sum(F.col("tokens") * p[i] * F.col("r")) for i in range(k)]).first(), float)
        if np.abs(got - b).max() <= tolerance * b.sum() or (len(steps) > 1 and np.abs(steps[-1]).max() < 1e-9):
            break
        steps.append((w @ (got - b)).tolist())
    return steps


def cells(members: DataFrame, k: int) -> DataFrame:
    """The tokens of members (tokens, p0, p1, ...) and their token-weighted mean posteriors, by cells CELL wide.

    For three domains there are half a million cells at most, however many members. A step is linear in the
    posteriors but where it stops at 0, so the totals of a cell are exact unless its own members differ in that.
    """
    at = [F.round(F.col(f"p{i}") / CELL).cast("long").alias(f"_c{i}") for i in range(k)]
    n = F.sum("tokens")
    means = [(F.sum(F.col("tokens") * F.col(f"p{i}")) / n).alias(f"p{i}") for i in range(k)]
    out = members.filter("tokens > 0").groupBy(*at).agg(n.alias("tokens"), *means)
    return out.select("tokens", *[f"p{i}" for i in range(k)]).coalesce(members.sparkSession.sparkContext.defaultParallelism)


def plan(measured: DataFrame, labelled: DataFrame, targets: dict[str, float], columns: list[str], budget: float | None = None, keep: str | None = None):
    """The materialized members of measured (doc_id, tokens, features), the model and the steps."""
    measured = measured.select("doc_id", "tokens", *columns)
    model = learn(measured, labelled, list(targets), columns)
    members = materialize(with_posteriors(measured, model, list(targets), columns), "members")
    if keep is not None:
        own = members.agg(F.sum(F.col("tokens") * F.col(f"p{list(targets).index(keep)}"))).first()[0] or 0.0
        budget = KEPT * own * sum(targets.values()) / targets[keep] or None
    if not model:
        return members, model, []
    met = materialize(cells(members, len(targets)), "cells")
    steps = solve(met, targets, budget)
    discard(met)
    return members, model, steps


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """doc_id, tokens, a posterior p_<domain> for each target, and rate for each row of docs (doc_id, text).

    labelled (doc_id, domain) gives the rows to learn from; domains without a target are not learned. A null
    text is empty, has no tokens, and gets the rate of its posteriors. Repeated rows weigh each by itself.
    Without labelled rows all posteriors are equal and say nothing, so all rates are 1; without tokens too. Other columns are ignored,
    whatever their names; an empty table gives no rows. A text of any length is read whole, by expressions of its row.
    Targets that no nonnegative rates meet are met as nearly as the weighted least squares allow.
    """
    vocabulary = vocabularies(docs, labelled, list(targets))
    measured = materialize(with_features(docs.select("doc_id", "text"), vocabulary).drop("text"), "features")
    members, _, steps = plan(measured, labelled, targets, columns_of(vocabulary), budget)
    return members.select("doc_id", "tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(targets)], rate_of(steps).alias("rate"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, keep: str | None = None) -> DataFrame:
    """docs repeated by their rates: a rate's whole part for sure, and once more with its fraction's chance, by a hash of id and text.

    A document of a rate of 1 or more is never lost. With keep, the budget is such that documents of that domain
    have rates of about KEPT, a little over 1. The columns are those of docs, whatever others they are; nulls,
    repeated rows and empty tables are as for rates, and a null id or text only takes part in the hash as such.
    """
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_own")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(97)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    vocabulary = vocabularies(docs, labelled, list(targets))
    columns = columns_of(vocabulary)
    measured = materialize(with_features(docs.select("doc_id", "text"), vocabulary).drop("text"), "features")
    members, model, steps = plan(measured, labelled, targets, columns, budget, keep)
    discard(members, measured)
    rows = with_features(docs.select(own, "doc_id", "text"), vocabulary).withColumn("_chance", chance).drop("text")  # once more: a copy of the corpus would cost more
    rows = with_posteriors(rows, model, list(targets), columns)
    rows = rows.withColumn("_n", F.floor(rate_of(steps) + F.col("_chance")).cast("int"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select("_own.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")))
