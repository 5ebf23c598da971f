"""URL filters: rules, and logistic regression on hashed character n-grams (DataFrame operations only).

The classifier is trained on a small labelled table (url, label 0 allow / 1 block); the
registered query takes for it a bounded, seeded share of the urls that a rule decides.
Every url then gets the verdict of its longest fitting rule, else the classifier's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import hash_share

#: (rule as host then path, verdict)
RULES: tuple[tuple[str, str], ...] = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)
BUCKETS = 1 << 13
GRAM = 3
SAMPLE = 4000  # labelled urls, in expectation


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, capitals, capitals.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule (equal lengths: the longer host, then the smaller text), else null."""
    def key(rule: str):
        return -len(rule), -rule.index("/"), rule

    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: key(r[0]), reverse=True):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(host: Column, path: Column, n: int = GRAM) -> Column:
    """Character n-grams of host and path, marked with the part they are from."""
    def part(text: Column, mark: str) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        count = F.length(padded) - (n - 1)
        return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(
            F.lit(mark), F.substr(padded, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(part(host, "h:"), part(path, "p:")))


def _features(urls: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    named = urls.withColumn("host", host).withColumn("path", path).withColumn("_grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=BUCKETS, inputCol="_grams", outputCol="_x", binary=True).transform(named)


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """Model from (url, label); None if the table lacks one of the labels. Null labels and
    urls are left out. The table must be small: it is trained on whole."""
    rows = _features(labelled.select("url", F.col("label").cast("double").alias("label")).where(
        "url is not null and label is not null"), "url").select("label", "_x")
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_x", labelCol="label", predictionCol="_pred", probabilityCol="_prob",
                              rawPredictionCol="_raw", regParam=0.01, maxIter=25, aggregationDepth=2).fit(rows)


def label_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = SAMPLE) -> DataFrame:
    """A small labelled table (url, label): of the different urls that a rule decides, a seeded
    share of each label, about ``most`` / 2 of it or all. Repeated urls count once."""
    host, path = host_and_path(F.col("url"))
    verdicts = dict(rules)
    ruled = pages.select("url", rule_of(host, path, rules).alias("rule")).where("rule is not null")
    label = F.when(F.col("rule").isin([r for r, v in verdicts.items() if v == "block"]), 1).otherwise(0)
    ruled = ruled.select("url", label.alias("label"))
    share = F.lit(0.0)
    for value, n in ruled.groupBy("label").agg(F.approx_count_distinct("url")).collect():  # two rows
        share = F.when(F.col("label") == value, F.lit(most / 2 / max(1, n))).otherwise(share)
    return ruled.where(hash_share(F.col("url"), 11, share)).distinct()


def judge(pages: DataFrame, model: LogisticRegressionModel | None,
          rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score), one for each row of ``pages``.

    ``score``: the classifier's probability of block. Null urls have empty host and path,
    fit no rule and are judged by the classifier like others; without a model (no labels
    of both kinds) unruled urls are allowed with score 0. Repeated rows stay repeated.
    """
    x = _features(pages.select("page_id", "url"), "url")
    if model is None:
        x = x.withColumn("score", F.lit(0.0))
    else:
        x = model.transform(x).withColumn("score", vector_to_array("_prob")[1])
    x = x.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = [r for r, v in rules if v == "block"]
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocked), "block").otherwise("allow")).otherwise(
        F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return x.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
