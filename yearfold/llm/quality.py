"""Quality by hierarchical empirical Bayes.

A document's own evidence is the probability of a linear classifier on whole-text statistics,
fitted on a bounded sample of labelled rows. Grouped sums of that evidence give each host a
posterior mean, shrunk toward the global mean, and each path one shrunk toward its host's; how
strongly is estimated from how much the groups differ. Each document's own share is taken out
of its groups before they speak for it. The classifier's statistics count up to CLIP deviations.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import looked_up, prepare, table
from .linear import fit, labelled_sample, predict

SAMPLE, SAMPLE_BYTES = 2000, 64 << 20
SYMBOLS = "#$%&*|!<>{}[]~^=+\\/@_"
FEATURES, CLIP = 12, 8


def statistics(texts: list[str | None]) -> np.ndarray:
    """FEATURES numbers of each whole text; all zero for null, empty and blank ones."""
    out = np.zeros((len(texts), FEATURES))
    for i, t in enumerate(texts):
        words = (t or "").split()
        if not words:
            continue
        n, size = len(words), len(t)
        lines = [x for x in t.split("\n") if x]
        count = Counter(words)
        symbols = sum(t.count(c) for c in SYMBOLS)
        upper = sum(w.isupper() for w in words)
        shortest = sum(len(w) < 3 for w in words)
        out[i] = [
            symbols / size, t.count("|") / n, t.count("!") / n, upper / n, sum(map(t.count, "0123456789")) / size,
            (size - t.count(" ")) / n / 10, len(count) / n, max(count.values()) / n, len(set(lines)) / len(lines),
            np.log(n), shortest / n, (t.count(".") + t.count(",")) / n,
        ]
    return out


class Model:
    def __init__(self, mean, scale, beta):
        self.mean, self.scale, self.beta = mean, scale, beta

    def predict(self, texts) -> np.ndarray:
        x = np.clip((statistics(texts) - self.mean) / self.scale, -CLIP, CLIP)
        return predict(self.beta, expanded(x))


def expanded(x: np.ndarray) -> np.ndarray:
    """With squares, as a share may be bad both when low and when high."""
    return np.concatenate([x, x**2 / 4], axis=1)


def train(texts: list[str], quality: np.ndarray, weight: np.ndarray | None = None) -> Model:
    x = statistics(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(mean, scale, fit(expanded(np.clip((x - mean) / scale, -CLIP, CLIP)), np.asarray(quality, dtype=float), weight, l2=0.1, steps=400))


def sample_and_train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None without labelled texts. Of repeated labels of one id the lower counts; null labels don't, others than 0 and 1 raise."""
    bad = labels.where("quality NOT IN (0, 1)").first()
    if bad:
        raise ValueError(f"labels are 0 or 1, not {bad}")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    total = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    rows = labelled_sample(docs.select("doc_id", "text"), known, "quality", sample, SAMPLE_BYTES)
    if not rows.num_rows:
        return None
    y = rows.column("quality").to_numpy()
    weight = np.where(y > 0, total.get(1, 0) / max(1, (y > 0).sum()), total.get(0, 0) / max(1, (y == 0).sum()))
    return train(rows.column("text").to_pylist(), y, weight / weight.mean())


def strength(groups: DataFrame, mean: str) -> float:
    """How many documents' evidence the prior is worth; infinite where groups differ no more than chance would have it."""
    r = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), F.lit(2))).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))).alias("within")).first()
    if not r.k or r.n <= r.k:
        return float("inf")
    within = r.within / (r.n - r.k)
    between = r.between / r.n - within * r.k / r.n
    return within / between if between > 0 else float("inf")


def shrunk(total, n, own, prior, m: float):
    """The mean of a group without its own member, drawn to the prior, which is worth m others; the prior alone where there are no others."""
    others = n - 1
    return F.when((others > 0) & F.lit(m < float("inf")), prior + (total - own - others * prior) / (others + F.lit(m))).otherwise(prior)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host=None, path=None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_doc, host_posterior, path_posterior, p_quality, keep) of every row.

    host and path are columns (source, and source with lang, by default); rows with a null one
    form a group of their own. Null and empty texts have the evidence of a text without words. At
    most `sample` labelled rows of each class, and SAMPLE_BYTES of text, train the classifier; of
    those that share an id the least text does. Labels other than 0 and 1 raise. Without labelled texts the evidence is one half everywhere and everything is kept. Repeated
    rows stay; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(host if host is not None else F.col("source"), F.lit("")).alias("host"), (path if path is not None else F.concat_ws("/", "source", "lang")).alias("path"))
    model = sample_and_train(own, labels, sample)
    kept = ["doc_id", "host", "path"]
    schema = T.StructType([own.schema[c] for c in kept] + [T.StructField("p_doc", T.DoubleType())])

    def run(batches):
        for b in batches:
            p = model.predict(b.column(3).to_pylist()) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p)], names=[*kept, "p_doc"])

    d = own.select(*kept, "text").mapInArrow(run, schema).withColumn("path", F.coalesce("path", F.lit(""))).checkpoint()
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("ss")]
    paths = d.groupBy("host", "path").agg(*sums).checkpoint()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).checkpoint()
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    base = min(max((s or 0.0) / n, 1e-6), 1 - 1e-6) if n else 0.5
    m1 = strength(hosts.withColumn("m", F.lit(base)), "m")
    means = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), (F.col("s") / F.col("n")).alias("m"))
    groups = looked_up(paths, means, ["host"], "inner").checkpoint()
    m2 = strength(groups, "m")
    j = looked_up(d, groups.select("host", "path", "hn", "hs", "n", "s"), ["host", "path"])
    p = F.col("p_doc")
    j = j.withColumn("host_posterior", shrunk(F.col("hs"), F.col("hn"), p, F.lit(base), m1))
    j = j.withColumn("path_posterior", shrunk(F.col("s"), F.col("n"), p, F.col("host_posterior"), m2))
    within = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(within(c) / (1 - within(c)))
    z = logit(p) + logit(F.col("path_posterior")) - F.lit(float(np.log(base / (1 - base))))
    out = j.withColumn("p_quality", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "p_doc", "host_posterior", "path_posterior", "p_quality", (F.col("p_quality") >= 0.5 - 1e-9).alias("keep"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Evidence and posteriors of every whole text of documents; source is the host, source and language the path. See score."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
