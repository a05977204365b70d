"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence is the log-odds of a logistic model on counts of characters and words, fitted to at most
max_labels labelled rows (those of least hash of doc_id). The probabilities are summed by host and by path; a host's
posterior mean is shrunk toward the global mean, and a path's toward its host's, by prior strengths that the data give
(method of moments: hosts spread about the global mean, paths about their host's). A document's prior leaves its own probability
out of both sums, so that no row counts its evidence twice and a lone row has the prior of its host, or of all. The final
log-odds are the document's, moved by as much as that prior differs from the global mean: sparse sites hardly move them.

Defined results. Null and empty texts have zero counts and are scored like any other. Null host or path is a group of its
own. Without labels of both kinds every row scores the labelled share of good rows (1.0 without any label). Repeated rows
are scored one by one and count each in their groups. An empty table gives an empty result. Extra columns pass untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import SPACE, Work, cut, join_groups, one_of_each, unused
from tracelens.llm.rules import CLASSES, words_of

#: Most labelled rows that the model is fitted to.
MAX_LABELS = 20_000


def features(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    words = words_of(t)
    n, distinct = F.size(words).cast("double"), F.size(F.array_distinct(words)).cast("double")
    chars = F.length(F.translate(t, SPACE, "")).cast("double")
    shares = [F.length(F.regexp_replace(t, rest, "")) / F.greatest(chars, F.lit(1.0)) for rest in CLASSES.values()]
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    dup = 1.0 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    return [*shares, chars / F.greatest(n, F.lit(1.0)), F.log1p(n), F.log1p(distinct) / F.greatest(F.log1p(n), F.lit(0.1)), distinct / F.greatest(n, F.lit(1.0)), dup]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and bias of a logistic model on features and their squares, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack([z, z * z, np.ones((len(z), 1))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS):
    """The model, or the share of good rows where it can't be fitted. At most max_labels rows come to the driver: a label's is the
    document of that doc_id whose text is the least in order of hash."""
    found = one_of_each(docs, labels, "quality", max_labels, id_col, text_col)
    rows = np.array(found.select(F.array(*features(F.col("text"))).alias("x"), "y").rdd.map(lambda r: [*r[0], float(r[1])]).collect())
    if not len(rows) or len(set(rows[:, -1])) < 2:
        return float(rows[:, -1].mean()) if len(rows) else 1.0
    return fit(rows[:, :-1], rows[:, -1])


def probability(model, text: Column) -> Column:
    if isinstance(model, float):
        return F.lit(model)
    mean, scale, w, bias = model
    z, k, total = features(text), len(mean), F.lit(float(bias))
    for i, x in enumerate(z):
        s = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (x - float(mean[i])) / float(scale[i])))
        total = total + s * float(w[i]) + s * s * float(w[k + i])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))))


def strength(groups: DataFrame) -> float:
    """The prior's weight in rows, of groups (n, s, v, about): large where their means differ from about no more than their sizes explain."""
    s = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("about"), 2)).alias("b"), F.sum("v").alias("v"), F.count("*").alias("k")).first()
    if not s["n"] or s["k"] < 2:
        return 1e4
    within = s["v"] / s["n"]
    between = max(0.0, s["b"] / s["n"] - within * s["k"] / s["n"])
    return float(min(1e4, max(1.0, within / between))) if between > 0 else 1e4


def posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, s, host_n, host_s) of every path, the global mean, and the strengths of the hosts' and the paths' priors."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    spread = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("v")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(total["s"] / total["n"]) if total["n"] else 1.0
    k_host = strength(hosts.select("n", "s", spread, F.lit(mean).alias("about")))
    of = hosts.select(F.col("host").alias("its_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    rows = paths.join(of, F.col("host").eqNullSafe(F.col("its_host"))).drop("its_host")
    k_path = strength(rows.select("n", "s", spread, (F.col("host_s") / F.col("host_n")).alias("about")))
    return rows.select("host", "path", "n", "s", "host_n", "host_s"), mean, k_host, k_path


def priors(p: Column, n: Column, s: Column, host_n: Column, host_s: Column, mean: float, k_host: float, k_path: float) -> tuple[Column, Column]:
    """A row's host and path posterior means without its own probability p."""
    host = (k_host * mean + host_s - p) / (k_host + host_n - 1)
    return host, (k_path * host + s - p) / (k_path + n - 1)


def _score(p: Column, prior: Column, mean: float) -> Column:
    """The log-odds of p and of its prior, less those of the mean."""
    odds = lambda c: F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6))
    return 1 / (1 + (1 - p) / F.greatest(p, F.lit(1e-9)) * odds(F.lit(mean)) / odds(prior))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, host, path, p (the document's own), host_posterior, path_posterior, score, kept: one row per row of docs."""
    model = train(docs, labels, id_col, text_col, max_labels)
    with Work(docs.sparkSession) as work:
        scored = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), probability(model, F.col(text_col)).alias("p")))
        groups, *prior = posteriors(scored)
        rows = join_groups(scored, cut(groups), ["host", "path"], "n", scored.count())
        c = F.col
        host, path = priors(c("p"), c("n"), c("s"), c("host_n"), c("host_s"), *prior)
        rows = rows.select("doc_id", "host", "path", "p", host.alias("host_posterior"), path.alias("path_posterior"))
        score = _score(F.col("p"), F.col("path_posterior"), prior[0])
        return work.keep(rows.withColumns({"score": score, "kept": score >= threshold}))


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of docs whose score reaches the threshold. Texts of large groups are not moved."""
    model = train(docs, labels, id_col, text_col, max_labels)
    p, n, s, host_n, host_s = unused(docs, "p", "n", "s", "host_n", "host_s")
    with Work(docs.sparkSession) as work:
        own = cut(docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), probability(model, F.col(text_col)).alias("p")))
        groups, *prior = posteriors(own)
        groups = work.keep(groups.select(F.col("host").alias(host_col), F.col("path").alias(path_col), F.col("n").alias(n), F.col("s").alias(s), F.col("host_n").alias(host_n), F.col("host_s").alias(host_s)))
        total = own.count()
    rows = join_groups(docs, groups, [host_col, path_col], n, total).withColumn(p, probability(model, F.col(text_col)))
    c = F.col
    _, path = priors(c(p), c(n), c(s), c(host_n), c(host_s), *prior)
    return rows.filter(_score(c(p), path, prior[0]) >= threshold).select(*docs.columns)
