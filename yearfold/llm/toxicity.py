"""Toxicity by a classifier chain.

The categories are 0/1 columns of a labels table, predicted one after the other, each by a linear
model that also sees the probabilities of the earlier ones. The corpus labels quality and toxicity;
from them come `low_quality`, `toxic` and `toxic_junk` (both). Features are statistics of the text,
and whether it holds a word or a beginning of one, by hash; each model chooses its own words.
Earlier probabilities used in training are out of fold, and so are the choice of words and the
scale of statistics for them. Models are fitted on the driver, on at most SAMPLE labelled rows of
each class of `toxic` and SAMPLE_BYTES of text. All documents are scored, on their whole texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, private, table
from .linear import fit, labelled_sample, predict
from .quality import CLIP, expanded, statistics

CATEGORIES = ("low_quality", "toxic", "toxic_junk")
SAMPLE, SAMPLE_BYTES, FEATURES, FOLDS = 2500, 64 << 20, 256, 4
BUCKETS, LEAST_TEXTS = 1 << 21, 5
WORD = re.compile(r"\w+")
STEMS = range(4, 8)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def buckets_of(word: str) -> list[int]:
    """Of the word, and of its beginnings as stems."""
    return [zlib.crc32(m.encode()) % BUCKETS for m in (word, *(word[:k] + "*" for k in STEMS if len(word) > k))]


def one_of_copies(texts: list[str], labels: np.ndarray) -> list[int]:
    """Positions of texts, one for each smallest hash of five words and labels, so that copies don't vote again and again."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = t.lower().split()
        low = min((zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))), default=0)
        if (key := (low, *labels[i])) not in seen:
            seen.add(key)
            out.append(i)
    return out


class Marks:
    """The distinct buckets of each text."""

    def __init__(self, texts: list[str]):
        own = [np.unique(np.fromiter((b for w in words_of(t) for b in buckets_of(w)), dtype=np.int32)) for t in texts]
        self.buckets = np.concatenate([np.zeros(0, dtype=np.int32), *own])
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in own])

    def choose(self, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The FEATURES buckets, in order, whose presence differs most between the classes among these rows (chi-square); all in LEAST_TEXTS texts."""
        n1, n0 = max(1.0, y[rows].sum()), max(1.0, (1 - y[rows]).sum())
        c1, c0 = (np.bincount(self.buckets[(rows & (y == k))[self.text]], minlength=BUCKETS).astype(np.int32) for k in (1, 0))
        at = np.flatnonzero(c1 + c0 >= LEAST_TEXTS)
        c1, c0 = c1[at], c0[at]
        p = (c1 + c0) / (n1 + n0)
        score = (c1 / n1 - c0 / n0) ** 2 / np.maximum(p * (1 - p), 1e-9)
        best = np.lexsort((at, -score))[:FEATURES]
        return np.sort(at[best[score[best] > 0]])

    def dense(self, chosen: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, len(chosen)), dtype=np.float32)
        if len(chosen):
            at = np.minimum(np.searchsorted(chosen, self.buckets), len(chosen) - 1)
            hit = chosen[at] == self.buckets
            x[self.text[hit], at[hit]] = 1
        return x


def scaled(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Statistics of about the size of a rare word's presence, as large ones would slow the descent for all."""
    return expanded(np.clip((stats - mean) / scale, -CLIP, CLIP)).astype(np.float32) / 4


class Chain:
    """links: (chosen buckets, mean and scale of the statistics, coefficients) of each category; coefficients are of buckets, statistics, earlier probabilities."""

    def __init__(self, links: list[tuple]):
        self.every = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[link[0] for link in links]]))
        self.links = [(np.searchsorted(self.every, chosen), *rest) for chosen, *rest in links]
        self.column = {b: i for i, b in enumerate(self.every.tolist())}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}  # the tasks fill their own

    def columns(self, words: set[str]) -> list[int]:
        out, known, column = set(), self.known, self.column
        for w in words:
            at = known.get(w)
            if at is None:
                at = tuple(column[b] for b in buckets_of(w) if b in column)
                if len(known) >= 1 << 17:
                    known.clear()
                known[w] = at
            if at:
                out.update(at)
        return list(out)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """A column of probabilities for each category."""
        x = np.zeros((len(texts), len(self.every)))
        for i, t in enumerate(texts):
            x[i, self.columns(words_of(t))] = 1
        out, stats = np.zeros((len(texts), 0)), statistics(texts)
        for chosen, mean, scale, beta in self.links:
            p = predict(beta, np.concatenate([x[:, chosen], scaled(stats, mean, scale), out], axis=1))
            out = np.concatenate([out, p[:, None]], axis=1)
        return out


def folds_of(texts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) % FOLDS for t in texts])


def train(texts: list[str], labels: np.ndarray, weight: np.ndarray | None = None) -> Chain:
    """The chain of these labelled texts, with a column of labels for each category in order; weight: of each text."""
    labels = np.asarray(labels, dtype=float)
    keep = one_of_copies(texts, labels)
    texts, labels = [texts[i] for i in keep], labels[keep]
    weight = np.ones(len(keep)) if weight is None else np.asarray(weight, dtype=float)[keep]
    marks, stats, fold, n = Marks(texts), statistics(texts), folds_of(texts), len(texts)
    earlier, links = np.zeros((n, 0), dtype=np.float32), []
    for k in range(labels.shape[1]):
        y, out = labels[:, k], np.empty(n)

        def model(rows, y=y, earlier=earlier):
            chosen, mean, scale = marks.choose(y, rows), stats[rows].mean(axis=0), stats[rows].std(axis=0) + 1e-6
            x = np.concatenate([marks.dense(chosen, n), scaled(stats, mean, scale), earlier], axis=1)
            return chosen, mean, scale, fit(x[rows], y[rows], weight=weight[rows]), x

        links.append(model(np.ones(n, dtype=bool))[:4])
        if k < labels.shape[1] - 1:
            for f in np.unique(fold):
                *_, beta, x = model(fold != f)
                out[fold == f] = predict(beta, x[fold == f])
            earlier = np.concatenate([earlier, out[:, None].astype(np.float32)], axis=1)
    return Chain(links)


def categories(labels: DataFrame) -> DataFrame:
    """(doc_id and CATEGORIES) of a table with quality and toxic, each 0 or 1. Of repeated labels of one id the worse counts; null labels and ids don't."""
    bad = labels.where("NOT (quality IN (0, 1) AND toxic IN (0, 1))").first()
    if bad:
        raise ValueError(f"labels are 0 or 1, not {bad}")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((1 - F.min(F.coalesce("quality", F.lit(1)))).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    return known.withColumn("toxic_junk", F.col("low_quality") * F.col("toxic"))


def sample_and_train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """None where no labelled text exists. Texts weigh so that toxic ones have the share that they have of all labels."""
    known = categories(labels)
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    rows = labelled_sample(docs, known, "toxic", sample, SAMPLE_BYTES)
    if not rows.num_rows:
        return None
    y = np.stack([rows.column(c).to_numpy() for c in CATEGORIES], axis=1)
    toxic = y[:, CATEGORIES.index("toxic")]
    share = {k: total.get(k, 0) / sum(total.values()) / max(1, (toxic == k).sum()) for k in (0, 1)}
    weight = np.where(toxic > 0, share[1], share[0])
    return train(rows.column("text").to_pylist(), y, weight / weight.mean())


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds p_low_quality, p_toxic, p_toxic_junk (double) and toxic (whether p_toxic is 0.5 or more); keep names the columns carried along.

    prefix goes before the new names. Columns of the new names, in either case, are replaced. Null
    and empty texts score as texts without words; without labelled texts all probabilities are zero
    and nothing is rejected. Of labelled rows that share an id the least text trains. Labels other
    than 0 and 1 raise. Repeated rows stay; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    chain = sample_and_train(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), labels, sample)
    new = [prefix + c for c in [*(f"p_{c}" for c in CATEGORIES), "toxic"]]
    kept = [c for c in (keep or docs.columns) if c.lower() not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(private(docs) + "text"))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in new[:-1]] + [T.StructField(new[-1], T.BooleanType())])
    toxic = CATEGORIES.index("toxic")

    def run(batches):
        for b in batches:
            p = chain.predict(b.column(len(kept)).to_pylist()) if chain else np.zeros((b.num_rows, len(CATEGORIES)))
            cols = [pa.array(p[:, i]) for i in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + cols + [pa.array(p[:, toxic] >= 0.5)], names=[*kept, *new])

    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their own columns, those named like scores too."""
    p = private(docs)
    marked = score(docs, labels, prefix=p, **options)
    return marked.where(f"NOT `{p}toxic`").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Probabilities of all categories for every whole text of documents, learnt from labels. Null texts have no words; see score."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def brute_force(texts: list[str], labels: list[list[int]], held: list[str]) -> list[list[float]]:
    """Probabilities of the held texts, with sets and loops, for small tests: the same chain without arrays of marks."""
    keep = one_of_copies(texts, np.asarray(labels))
    texts, labels = [texts[i] for i in keep], [labels[i] for i in keep]
    has = lambda t: {b for w in words_of(t) for b in buckets_of(w)}
    own, fold = [has(t) for t in texts], [zlib.crc32(t.encode()) % FOLDS for t in texts]
    stats = statistics(texts).tolist()
    earlier, links = [[] for _ in texts], []

    def row(held, chosen, mean, scale, numbers, before):
        z = [max(-CLIP, min(CLIP, (v - m) / d)) for v, m, d in zip(numbers, mean, scale, strict=True)]
        return [float(b in held) for b in chosen] + [v / 4 for v in z] + [v * v / 16 for v in z] + before

    def model(rows, k):
        ones, noes = [own[i] for i in rows if labels[i][k]], [own[i] for i in rows if not labels[i][k]]
        n1, n0, scored = max(1, len(ones)), max(1, len(noes)), []
        for b in set().union(*own):
            c1, c0 = sum(b in s for s in ones), sum(b in s for s in noes)
            p = (c1 + c0) / (n1 + n0)
            if c1 + c0 >= LEAST_TEXTS and c1 / n1 != c0 / n0:
                scored.append((-((c1 / n1 - c0 / n0) ** 2) / max(p * (1 - p), 1e-9), b))
        chosen = sorted(b for _, b in sorted(scored)[:FEATURES])
        columns = list(zip(*[stats[i] for i in rows], strict=True))
        mean = [sum(c) / len(c) for c in columns]
        scale = [(sum((v - m) ** 2 for v in c) / len(c)) ** 0.5 + 1e-6 for c, m in zip(columns, mean, strict=True)]
        x = np.array([row(own[i], chosen, mean, scale, stats[i], earlier[i]) for i in rows], dtype=np.float32)
        return chosen, mean, scale, fit(x, np.array([float(labels[i][k]) for i in rows]))

    for k in range(len(labels[0])):
        links.append(model(range(len(texts)), k))
        new = [0.0] * len(texts)
        for f in set(fold):
            *how, beta = model([i for i in range(len(texts)) if fold[i] != f], k)
            for i in range(len(texts)):
                if fold[i] == f:
                    new[i] = float(predict(beta, np.array([row(own[i], *how, stats[i], earlier[i])], dtype=np.float32))[0])
        earlier = [e + [p] for e, p in zip(earlier, new, strict=True)]
    out = []
    for t in held:
        s, numbers, ps = has(t), statistics([t])[0].tolist(), []
        for *how, beta in links:
            ps.append(float(predict(beta, np.array([row(s, *how, numbers, ps)]))[0]))
        out.append(ps)
    return out
