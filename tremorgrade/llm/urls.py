"""URL filters: rules first, else logistic regression on hashed character n-grams.

Only DataFrame functions. A URL's features are hashed n-grams of its host and of its
path. Training is full-batch gradient descent: each round is one aggregation over the
labelled table that yields a gradient of at most ``dims`` numbers, in whole millionths
so that its sum does not depend on the order of rows. Scoring is an expression with
the weights as a literal: nothing is joined or shuffled, so no host can be hot.

Nulls and URLs without ``://`` have an empty host and path; they fit no rule and are
judged by the bias alone. Without labelled rows every weight is 0 and the verdict is
allow. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrade.llm.store import stored

#: Verdict and rule, a rule being a host and the start of a path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
LABELLED_URLS = 4_000
"""The model is fitted on so many labelled URLs at most."""

_UNIT = 1e6


@dataclass(frozen=True)
class Fit:
    dims: int = 1024
    rounds: int = 20
    step: float = 0.5
    decay: float = 1e-3
    sizes: tuple[int, ...] = (3, 4)


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(
        F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), upper, lower), F.lit("")
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; a short list, so a chain of tests."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found).otherwise(chain)
    return chain


def features(host: Column, path: Column, fit: Fit) -> Column:
    """Positions of all n-grams in the weights, repeated ones as often as they occur."""
    grams = []
    for kind, text in (("h", host), ("p", path)):
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        for size in fit.sizes:
            starts = F.when(
                F.size(chars) >= size, F.sequence(F.lit(0), F.size(chars) - size)
            ).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(starts, _hashed(kind, chars, size, fit.dims)))
    return F.concat(*grams)


def _hashed(kind: str, chars: Column, size: int, dims: int):
    return lambda i: F.pmod(
        F.xxhash64(F.lit(kind), *[F.get(chars, i + k) for k in range(size)]), F.lit(dims)
    ).cast("int")


def block_score(found: Column, weights: list[float], bias: float) -> Column:
    """Probability of block."""
    values = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded once
    total = F.aggregate(found, F.lit(0.0), lambda s, i: s + F.get(values, i))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(found) + 1.0))))


def train(labelled: DataFrame, fit: Fit | None = None) -> tuple[list[float], float]:
    """Weights and bias from (url, block 0 or 1); at most LABELLED_URLS distinct URLs, those
    of the least hashes, one row each (block if any row says so)."""
    fit = fit or Fit()
    sample = (
        labelled.where("url IS NOT NULL AND block IS NOT NULL")
        .groupBy("url")
        .agg(F.max("block").alias("block"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(LABELLED_URLS)
    )
    examples = stored(
        sample.select("block", features(host_of(F.col("url")), path_of(F.col("url")), fit).alias("f")),
        "urls",
    )
    weights, bias = [0.0] * fit.dims, 0.0
    squares, bias_square = [1e-6] * fit.dims, 1e-6
    for _ in range(fit.rounds):
        error = (block_score(F.col("f"), weights, bias) - F.col("block")).alias("error")
        share = F.col("error") / F.sqrt(F.size("f") + 1.0)
        gradient = (
            examples.select("f", error)
            .select(
                F.explode(
                    F.concat(
                        F.transform("f", lambda i: F.struct(i.alias("i"), share.alias("g"))),
                        F.array(F.struct(F.lit(-1).alias("i"), F.col("error").alias("g"))),
                    )
                ).alias("x")
            )
            .groupBy("x.i")
            .agg(F.sum(F.round(F.col("x.g") * _UNIT).cast("long")).alias("g"))
            .collect()
        )
        for i, g in gradient:
            g = g / _UNIT
            if i < 0:
                bias_square += g * g
                bias -= fit.step * g / math.sqrt(bias_square)
            else:
                g += fit.decay * weights[i]
                squares[i] += g * g
                weights[i] -= fit.step * g / math.sqrt(squares[i])
    return weights, bias


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    weights: list[float],
    bias: float,
    fit: Fit | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every (page_id, url)."""
    host, path = F.col("host"), F.col("path")
    score = block_score(features(host, path, fit or Fit()), weights, bias)
    return (
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select("page_id", host, path, longest_rule(host, path, rules).alias("by"), score.alias("score"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("by.rule").alias("rule"),
            F.coalesce(
                F.col("by.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow")
            ).alias("verdict"),
            "score",
        )
    )


def ruled_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """URLs that a rule decides, as a labelled table."""
    url = F.col("url")
    by = longest_rule(host_of(url), path_of(url), rules)
    return pages.select("url", (by["verdict"] == "block").cast("int").alias("block")).where(
        "block IS NOT NULL"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    weights, bias = train(ruled_urls(pages, RULES))
    return filter_urls(pages, RULES, weights, bias)
