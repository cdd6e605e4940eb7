"""Quality classifier: hierarchical empirical Bayes over hosts and paths.

A logistic classifier reads the shape of a text (native measures) and gives each document's evidence as log odds
against the labels' base rate. Every document then gives its host and its path a share of good and of all: labelled
documents by their label, others by their evidence at a discount. Shares are summed by grouped aggregation, and each
level shrinks toward the one above: paths toward their host, hosts toward the global rate, the less the more
documents they have. The prior strengths come from the spread between hosts and between paths of one host. A
document's posterior odds are its path's odds, as all other documents give them, times its own evidence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, stash
from tidemark.llm.quality_rules import measures, words

FEATURES = ("bias", "log_words", "word_chars", "upper", "digits", "symbols", "marks", "stops", "dup_lines", "distinct", "line_words")


def features(text: Column, w: Column) -> dict[str, Column]:
    """Shape of a text as numbers of about unit size; null and empty texts are all zero but for the bias."""
    t = F.coalesce(text, F.lit(""))
    m = measures(text, w)
    n = F.greatest(F.size(w), F.lit(1))
    chars = F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / chars
    return {
        "bias": F.lit(1.0),
        "log_words": F.log1p(F.size(w).cast("double")) / 5,
        "word_chars": F.least(m["word_chars"] / n, F.lit(20.0)) / 5,
        "upper": share(r"\p{Lu}+") * 5,
        "digits": share(r"[0-9]+") * 5,
        "symbols": share(r"[#*$%&|<>]+") * 10,
        "marks": share(r"[!?]+") * 10,
        "stops": m["n_stop_words"] / n * 3,
        "dup_lines": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)) * 3,
        "distinct": F.size(F.array_distinct(w)) / n,
        "line_words": F.least(n / F.greatest(m["n_lines"], F.lit(1)), F.lit(100.0)) / 50,
    }


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _strength(groups: DataFrame, n: str, good: str, centre: Column) -> float:
    """Pseudo-documents of a beta prior, from the spread of the groups' shares beyond what their sizes explain."""
    p = F.col(good) / F.col(n)
    r = groups.where(F.col(n) > 0).agg(F.sum(F.col(n) * (p - centre) ** 2).alias("s"), F.sum(centre * (1 - centre)).alias("v"), F.sum(F.col(n) * centre * (1 - centre)).alias("t"), F.count(F.lit(1)).alias("k")).first()
    if not r["k"] or not r["t"]:
        return 50.0
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) / (strength + 1))
    beyond, room = r["s"] - r["v"], r["t"] - r["v"]
    rho = min(max(beyond / room if room > 0 else 0.0, 1e-4), 0.9)
    return 1 / rho - 1


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", folds: int = 3, held_fold: int = 1, sample: int = 20_000, discount: float = 0.25, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (doc_id, held_out, host, path, evidence, host_rate, path_rate, score, kept).

    Labels are read where the crc32 of the id modulo ``folds`` is not ``held_fold``; the weights are fitted on at most
    ``sample`` of those rows (by a hash of the id), the rates on all. ``evidence``: log odds against the base rate;
    ``host_rate`` and ``path_rate``: those of all documents but this one;
    ``score``: posterior probability of a good text; kept from ``least`` on. Null hosts and paths are groups of their
    own; null ids are never labelled; of several labels of one id the largest counts; texts are taken whole; without labels the evidence is zero and the rate one half.
    """
    key = F.col(id_col).cast("long")
    text = F.col(text_col).cast("string")
    base = docs.select(key.alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), text.alias("text"), words(text).alias("w"))
    f = features(F.col("text"), F.col("w"))
    shapes = stash(base.select("doc_id", "host", "path", F.array(*[f[k].cast("double") for k in FEATURES]).alias("x")), "shapes")
    held = lambda c: F.coalesce(fold(F.col(c), folds) == held_fold, F.lit(False))
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    # One row an id, so that repeated rows leave the sample as small as it was set.
    some = shapes.join(F.broadcast(taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    some.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["y"] for r in some])
    weights = fit(np.array([r["x"] for r in some]), y) if len(set(y.tolist())) == 2 else np.zeros(len(FEATURES))
    mean = float(y.mean()) if len(y) else 0.5
    mean = min(max(mean, 0.01), 0.99)
    logit = F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, weights))), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    odds = lambda p: F.log(p / (1 - p))
    prob = lambda z: 1 / (1 + F.exp(-z))
    prior = float(np.log(mean / (1 - mean)))
    seen = shapes.select("doc_id", "host", "path", (logit - F.lit(prior if weights.any() else 0.0)).alias("evidence"))
    seen = seen.join(taught, "doc_id", "left")
    weight = F.when(F.col("y").isNotNull(), 1.0).otherwise(discount)
    seen = stash(seen.select("doc_id", "host", "path", "evidence", weight.alias("w"), (weight * F.coalesce("y", prob(F.col("evidence") + prior))).alias("gain")), "evidence")
    paths = stash(seen.groupBy("host", "path").agg(F.sum("w").alias("n"), F.sum("gain").alias("good")), "paths")
    hosts = stash(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood")), "hosts")
    t = hosts.agg(F.sum("hgood").alias("g"), F.sum("hn").alias("n")).first()
    centre = min(max(t["g"] / t["n"], 0.01), 0.99) if t["n"] else 0.5
    k_host = _strength(hosts, "hn", "hgood", F.lit(centre))
    rate = lambda good, n, k, above: F.least(F.greatest((good + k * above) / (n + k), F.lit(1e-6)), F.lit(1 - 1e-6))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "p.n", "p.good", "h.hn", "h.hgood")
    both = stash(both.withColumn("host_rate", rate(F.col("hgood"), F.col("hn"), k_host, F.lit(centre))), "rates")
    k_path = _strength(both, "n", "good", F.col("host_rate"))
    rates = both.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", "hn", "hgood")
    on = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    # A document's own share is taken out of its path and host, so that it doesn't speak twice.
    j = seen.join(rates, on).withColumn("host_rate", rate(F.col("hgood") - F.col("gain"), F.col("hn") - F.col("w"), k_host, F.lit(centre)))
    j = j.withColumn("path_rate", rate(F.col("good") - F.col("gain"), F.col("n") - F.col("w"), k_path, F.col("host_rate")))
    score = prob(odds(F.col("path_rate")) + F.col("evidence"))
    return j.select("doc_id", held("doc_id").alias("held_out"), "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= least).alias("kept"))
