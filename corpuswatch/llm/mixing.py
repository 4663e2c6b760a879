"""Soft-membership mixing: domain posteriors from labelled rows, and document rates that bring expected domain tokens to target weights.

DataFrame functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import column_or_empty, written

#: Most labelled rows that the classifier learns from, and the words in its table.
SAMPLE, LEXICON = 20_000, 1024
#: Least nats by which a word in the table tells domains apart (likelihood ratio), lest chance words crowd it.
LEAST = 10.0
#: Texts of usual words that each domain is given beside its own.
PRIOR = 2.0
#: How many times as usual in a domain as overall a word is whose lack counts against the domain.
MARKER = 2.0
#: Marks counted as noise rather than punctuation.
MARKS = "!#$%&*|@^~"


def words_of(text: Column) -> Column:
    """Lower-case words of a text: runs of anything but 0x20, 0x09 to 0x0D, full stops and commas."""
    return F.array_remove(F.split(F.lower(text), "[\t-\r .,]+"), "")


def tokens(text: Column, words: Column) -> Column:
    """The distinct words of a text, and its shape: shares of capitals, noise marks and distinct words, cut in steps, as words of their own that no text holds."""
    size = F.greatest(F.length(text), F.lit(1))
    step = lambda name, x, k: F.concat(F.lit(f" {name} "), F.round(x * k).cast("int").cast("string"))
    loud = F.regexp_replace(text, f"[^A-Z{re.escape(MARKS)}]+", "")  # one pass over the text, short from here on
    capitals = F.length(F.regexp_replace(loud, "[^A-Z]+", ""))
    distinct = F.array_distinct(words)
    shape = F.array(
        step("marks", F.sqrt((F.length(loud) - capitals) / size), 20), step("capitals", F.sqrt(capitals / size), 10), step("distinct", F.size(distinct) / F.greatest(F.size(words), F.lit(1)), 10)
    )
    return F.concat(distinct, shape)


@dataclass
class DomainTable:
    """``words``: word and, per domain, by how much its log probability rises where a text holds that word; ``base``: per domain the log probability of a text that holds none of them.

    Where a word is ``MARKER`` times as usual in a domain as overall, a text without it counts against that domain. Other
    words say nothing by their lack: short texts and rarer languages lack most words of the table.
    """

    domains: list[str]
    words: DataFrame
    base: list[float]


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = SAMPLE, lexicon: int | None = LEXICON) -> DomainTable:
    """A naive Bayes table over the presence of the ``lexicon`` words (at most; None: all) that tell most about the domain, by ``LEAST`` nats or more.

    ``labelled`` has id_col and ``domain``; the ``max_rows`` rows with the
    lowest hashes of their ids are learned from, and are broadcast as ids and domains only. Rows
    with a null id or a domain not in ``domains`` are left out, and rows of one domain with the same set of words count once.
    Without any row the table is empty.
    """
    rows = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isin(domains)).groupBy(id_col).agg(F.min("domain").alias("domain"))
    rows = rows.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    some = docs.select(F.col(id_col).alias("_id"), column_or_empty(text_col).alias("_text")).join(F.broadcast(rows.withColumnRenamed(id_col, "_id")), "_id")
    some = written(some.select("_id", "domain", tokens(F.col("_text"), words_of(F.col("_text"))).alias("w")), "mix-examples")  # max_rows texts: read once
    # copies say no more than one of them does
    each = some.groupBy("domain", F.xxhash64(F.array_sort("w")).alias("_h")).agg(F.min(F.struct("_id", "w")).alias("e")).select("domain", "e.w")
    each = written(each, "mix-distinct")
    sizes = {r["domain"]: r["n"] for r in each.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per domain
    n = {d: sizes.get(d, 0) for d in domains}
    total = sum(n.values())
    counts = each.select("domain", F.explode("w").alias("word")).groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)))
    there = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))

    def nats(part: Column, whole: Column | float, given: int) -> Column:
        """part * log(part * total / (whole * given)), 0 where part is 0."""
        return F.when(part > 0, part * F.log(part * total / (whole * given))).otherwise(0.0)

    tells = sum((nats(F.col(f"n{k}"), there, max(1, n[d])) + nats(n[d] - F.col(f"n{k}"), total - there, max(1, n[d])) for k, d in enumerate(domains)), F.lit(0.0))
    best = counts.withColumn("tells", F.round(tells, 6)).where(F.col("tells") >= LEAST).orderBy(F.desc("tells"), "word")
    best = best if lexicon is None else best.limit(lexicon)
    usual = (there + 0.5) / (total + 1.0)
    share = [(F.col(f"n{k}") + PRIOR * usual) / (n[d] + PRIOR) for k, d in enumerate(domains)]
    lack = [F.when(p >= MARKER * usual, F.log((1 - F.least(p, F.lit(0.999))) / (1 - F.least(usual, F.lit(0.999))))).otherwise(0.0) for p in share]
    lifts = [F.log(p / usual).alias(f"l{k}") for k, p in enumerate(share)]
    found = written(best.select("word", *lifts, *(c.alias(f"a{k}") for k, c in enumerate(lack))), "mix-lexicon")
    none = found.agg(*(F.coalesce(F.sum(f"a{k}"), F.lit(0.0)) for k in range(len(domains)))).first()  # one row
    table = found.select("word", *((F.col(f"l{k}") - F.col(f"a{k}")).alias(f"l{k}") for k in range(len(domains))))
    return DomainTable(domains, table, [math.log((n[d] + 1) / (total + len(domains))) + none[k] for k, d in enumerate(domains)])


def posteriors(docs: DataFrame, table: DomainTable, carry: list[str], text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``carry`` (a struct of those columns), n_tokens (words), q0, q1, ... (the probability of each domain).

    Every text is matched whole against the table's words; the few hits are
    summed per row before anything is shuffled. Null and empty texts have 0
    tokens and their posteriors too.
    """
    known = [r[0] for r in table.words.select("word").toLocalIterator()]  # as many as the lexicon has
    base = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("carry"), column_or_empty(text_col).alias("_text"))
    words = words_of(F.col("_text"))
    hits = F.array_intersect(F.array(*map(F.lit, known)), tokens(F.col("_text"), words)) if known else F.array().cast("array<string>")
    base = base.select("carry", F.size(words).cast("long").alias("n_tokens"), hits.alias("w"), F.monotonically_increasing_id().alias("_row"))
    domains = range(len(table.domains))
    odds = base.select("_row", "carry", "n_tokens", F.explode_outer("w").alias("word")).join(F.broadcast(table.words), "word", "left")
    odds = odds.groupBy("_row").agg(F.first("carry").alias("carry"), F.first("n_tokens").alias("n_tokens"), *((F.coalesce(F.sum(f"l{k}"), F.lit(0.0)) + table.base[k]).alias(f"z{k}") for k in domains))
    top = F.greatest(*(F.col(f"z{k}") for k in domains), F.lit(-1e300))
    odds = odds.select("carry", "n_tokens", *(F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in domains))
    return odds.select("carry", "n_tokens", *((F.col(f"e{k}") / sum((F.col(f"e{j}") for j in domains), F.lit(0.0))).alias(f"q{k}") for k in domains))


def fit_rates(soft: DataFrame, weights: list[float], anchor: int | None = None, most: float | None = None, rounds: int = 60, tolerance: float = 1e-4, keep: int | None = None) -> DataFrame:
    """``soft`` (n_tokens, q0, q1, ...) with ``rate``, nonnegative (and at most ``most``), by projected gradient descent on least squares, and ``unmet``.

    The objective is the sum over domains of ((expected tokens at these rates - target) / scale)^2.
    The gradient is scaled by the inverse Gram matrix (a number per pair of domains) of the rows that are off their bounds, so that few
    rounds are needed though domains overlap; where such a step doesn't descend, plain steps of a safe length are taken.
    Targets are ``weights`` times a total, which is the tokens that are there or, with ``anchor``, what leaves that domain's expected tokens
    as they are. Rates start at 1; rows that are likelier than not of the domain ``keep`` stay at 1. A step needs expected totals and that matrix
    only, one row in all, added up over the executors; the rates follow from them by an expression over
    the row. It ends after ``rounds`` rounds or when no total moves by over ``tolerance`` of all tokens. Either way ``unmet`` says on every
    row by what share of all tokens the domain that is furthest off misses its target; weights that no such rates can reach leave it above 0.
    Rows without tokens have a rate too; an empty table, or one without tokens, has rates of 1.
    """
    domains = range(len(weights))
    share = sum(weights) or 1.0
    mass = [F.col("n_tokens") * F.col(f"q{k}") for k in domains]
    gram = [F.sum(mass[k] * F.col(f"q{j}")).alias(f"g{k}_{j}") for k in domains for j in domains]
    got = soft.agg(F.sum("n_tokens").alias("all"), *(F.sum(mass[k]).alias(f"t{k}") for k in domains), *gram).first()
    everything = float(got["all"] or 0)
    if not everything:
        return soft.withColumns({"rate": F.lit(1.0), "unmet": F.lit(0.0)})
    now = [float(got[f"t{k}"]) for k in domains]
    total = everything if anchor is None or not weights[anchor] else now[anchor] * share / weights[anchor]
    target = [total * w / share for w in weights]
    matrix = lambda row: np.array([[float(row[f"g{k}_{j}"] or 0) for j in domains] for k in domains])
    scale = np.sqrt(np.maximum(now, 1e-6 * everything))
    largest = (matrix(got) / np.outer(scale, scale)).sum(axis=1).max()  # at least the largest eigenvalue
    badness = lambda totals: float((((np.array(totals) - target) / scale) ** 2).sum())
    within = (lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most)))) if most is not None else (lambda x: F.greatest(x, F.lit(0.0)))
    loose = F.lit(True) if keep is None else F.col(f"q{keep}") < 0.5
    limit = lambda x: F.when(loose, within(x)).otherwise(1.0)
    free = loose & ((F.col("rate") > 0) if most is None else (F.col("rate") > 0) & (F.col("rate") < most))

    def stepped(rate: Column, pull: list[float]) -> tuple[Column, Row, list[float]]:
        rate = limit(rate - sum((F.lit(pull[k]) * F.col(f"q{k}") for k in domains), F.lit(0.0)))
        sums = [F.sum(mass[k] * F.col("rate")).alias(f"t{k}") for k in domains]
        row = soft.withColumn("rate", rate).agg(*sums, *(F.sum(F.when(free, mass[k] * F.col(f"q{j}"))).alias(f"g{k}_{j}") for k in domains for j in domains)).first()
        return rate, row, [float(row[f"t{k}"]) for k in domains]

    rate = limit(F.lit(1.0))
    for _ in range(rounds):
        gram = matrix(got)
        gram += np.eye(len(weights)) * (1e-6 * gram.trace() + 1e-9 * everything)
        whole = np.linalg.solve(gram, np.array(now) - target)
        for length in (1.0, 0.25):
            step = stepped(rate, (length * whole).tolist())
            if badness(step[2]) < badness(now):
                break
        else:  # a plain gradient step always descends
            step = stepped(rate, ((np.array(now) - target) / (scale**2 * largest)).tolist())
        before, (rate, got, now) = now, step
        if max(abs(a - b) for a, b in zip(before, now, strict=True)) <= tolerance * everything:
            break
    unmet = max(abs(a - b) for a, b in zip(now, target, strict=True)) / everything
    return soft.withColumn("rate", rate).withColumn("unmet", F.lit(unmet))


def mix(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], carry: list[str], id_col: str = "doc_id", text_col: str = "text",
    anchor: str | None = None, most: float | None = None, max_rows: int = SAMPLE, lexicon: int | None = LEXICON, seed: int = 42, keep: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the columns in ``carry``, n_tokens, ``p_<domain>`` for each domain of ``weights``, rate, unmet, and copies.

    ``labelled`` (id_col, domain) gives examples of the domains. ``copies``
    is the rate rounded to one of its two neighbouring whole numbers, by a
    hash of id and text as the chance, so that expected domain totals are
    those of the rates; 0 means that the row isn't part of the mix. Rows are not repeated here. See ``fit_rates`` for ``anchor``, ``most``, ``keep`` and ``unmet``.

    Null and empty texts have no tokens and posteriors all the same; rows with null or repeated ids each have a rate (rows
    alike in id and text have the same copies); without any labelled row posteriors are equal for all; empty tables give
    empty results; extra columns are ignored unless named in ``carry`` (one whose name is also a result column's comes twice). Everything runs as DataFrame functions over all rows; only
    sums per domain and the table's words, both of fixed size, come to the driver.
    """
    domains = list(weights)
    table = fit_domains(docs, labelled, domains, id_col, text_col, max_rows, lexicon)
    marked = docs.select(*carry, F.col(text_col).alias("_mix_text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_mix_draw"))
    soft = posteriors(marked, table, [*carry, "_mix_draw"], "_mix_text")
    soft = written(soft.select("carry", "n_tokens", *(F.col(f"q{k}") for k in range(len(domains)))), "mix-posteriors")
    rated = fit_rates(soft, [float(weights[d]) for d in domains], None if anchor is None else domains.index(anchor), most, keep=None if keep is None else domains.index(keep))
    draw = F.pmod(F.col("carry._mix_draw"), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(
        *(F.col(f"carry.{c}").alias(c) for c in carry), "n_tokens", *(F.col(f"q{k}").alias(f"p_{d}") for k, d in enumerate(domains)), "rate", "unmet", F.floor(F.col("rate") + draw).alias("copies")
    )


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels table as domains: toxic rows, then junk (quality 0), then clean ones; rows with both labels null are left out."""
    toxic, good = F.max(F.coalesce("toxic", F.lit(0))), F.max(F.coalesce("quality", F.lit(1)))
    known = labels.where("toxic is not null or quality is not null")
    return known.groupBy(id_col).agg(F.when(toxic == 1, "toxic").when(good == 0, "junk").otherwise("clean").alias("domain"))
