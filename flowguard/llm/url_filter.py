"""URL filter: explicit rules first, gradient-boosted trees on lexical features for the rest.

Everything is column functions and MLlib's trees over DataFrames. The trees learn from labelled
URLs: a bounded sample (``per_class`` of each class, by the hash of the URL). Suffix statistics,
how often a host's ending is blocked among the labelled URLs, cover all of them and are joined.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is
judged by its features (all zero for null); a null id is kept as null; repeated rows give
repeated results; if labels of only one class exist, that class's verdict holds for all others,
and without any labels all are allowed; an empty table gives an empty result. Other columns are
neither read nor returned.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import cut


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


FEATURES = ("length", "host_length", "path_length", "host_labels", "depth", "digit_ratio",
            "entropy", "n_params", "n_hyphens", "has_fragment", "suffix_rate", "suffix_weight",
            "site_rate", "site_weight")
PRIOR = 20.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(
        "substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(rules: Sequence[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.

    The rules are a list of the program, a few to some hundred; each is one condition.
    """
    name = verdict = None
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = (((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path))
        name = F.when(fits, r.text) if name is None else F.when(fits, r.text).otherwise(name)
        verdict = (F.when(fits, r.verdict) if verdict is None
                   else F.when(fits, r.verdict).otherwise(verdict))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def parsed(pages: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """(page_id, url, host, path, rule, rule_verdict)"""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def _bits(chars: Column, length: Column) -> Column:
    """Shannon entropy of an array of characters."""
    share = F.transform(F.array_distinct(chars), lambda c: (
        F.size(F.filter(chars, lambda x: x == c)) / length))
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that come from the URL alone, and its suffix and site."""
    url = F.coalesce("url", F.lit(""))
    length = F.length(url)
    host, path = F.col("host"), F.col("path")
    digits = length - F.length(F.translate(url, string.digits, ""))
    labels = F.split(host, r"\.")

    def count(text, ch):
        return (F.length(text) - F.length(F.translate(text, ch, ""))).cast("double")
    return rows.withColumns({
        "length": length.cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_labels": count(host, "."), "depth": count(path, "/"),
        "digit_ratio": F.coalesce(digits / F.nullif(length, F.lit(0)), F.lit(0.0)),
        "entropy": F.when(length > 0, _bits(F.split(url, ""), length)).otherwise(0.0),
        "n_params": F.when(F.instr(url, "?") > 0, count(url, "&") + 1).otherwise(0.0),
        "n_hyphens": count(url, "-"), "has_fragment": (F.instr(url, "#") > 0).cast("double"),
        "suffix": F.element_at(labels, -1),
        "site": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
    })


def suffix_statistics(labelled: DataFrame, key: str) -> DataFrame:
    """Per ending: share of blocked among the labelled, drawn to one half, and how many."""
    return labelled.groupBy(key).agg(
        ((F.sum("y") + PRIOR / 2) / (F.count("*") + PRIOR)).alias(f"{key}_rate"),
        F.log1p(F.count("*").cast("double")).alias(f"{key}_weight"))


def with_statistics(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    for key in ("suffix", "site"):
        rows = (rows.join(suffix_statistics(labelled, key), key, "left")
                .fillna({f"{key}_rate": 0.5, f"{key}_weight": 0.0}))
    return rows


def fit(labelled: DataFrame, trees: int = 20, depth: int = 4,
        per_class: int = 4000) -> PipelineModel | float:
    """Trees on a sample of rows with features and y; a constant where only one class exists."""
    names = list(FEATURES)
    key = F.xxhash64("url", "page_id")
    sample = cut(labelled.filter("y = 0").orderBy(key, "url", "page_id").limit(per_class)
                 .unionAll(labelled.filter("y = 1").orderBy(key, "url", "page_id")
                           .limit(per_class)).select(*names, "y"))
    seen = {r["y"] for r in sample.select("y").distinct().collect()}
    if len(seen) < 2:
        return float(max(seen, default=0))
    assemble = VectorAssembler(inputCols=names, outputCol="_features")
    model = GBTClassifier(featuresCol="_features", labelCol="y", maxIter=trees, maxDepth=depth,
                          seed=5).fit(assemble.transform(sample))
    return PipelineModel([assemble, model])


def judge(pages: DataFrame, rules: Sequence[UrlRule], labels: DataFrame | None = None,
          block_from: float = 0.8, **fitting) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    ``labels`` has (url, y) with y 1 for blocked; without it, the pages that a rule decides are
    the labelled URLs. ``score`` is the trees' probability of a block.
    """
    rows = lexical(parsed(pages, rules))
    if labels is None:
        labelled = rows.filter("rule IS NOT NULL").withColumn(
            "y", (F.col("rule_verdict") == "block").cast("double"))
    else:
        given = labels.select(F.lit(None).cast("long").alias("page_id"), "url",
                              F.col("y").cast("double").alias("y"))
        labelled = lexical(parsed(given, ()).join(
            given.select("url", "y").distinct(), "url"))
    model = fit(with_statistics(labelled, labelled), **fitting)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(with_statistics(rows, labelled)).withColumn(
            "score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "rule_verdict", F.when(F.col("score") >= block_from, "block").otherwise("allow"))
        .alias("verdict"), "score")
