"""Removal of word passages that repeat, found with difference-cover anchors.

A window is WINDOW consecutive words. Positions modulo PERIOD in COVER form a difference
cover: for any two positions i and j there is a shift below PERIOD that brings both into the
cover. So two equal windows share an aligned anchor, a run of WINDOW - PERIOD + 1 words that
starts at a cover position in both. Only anchors at cover positions (5 of 21) are hashed and
compared over the corpus. Those that repeat are extended to the windows around them, and these
are compared word by word: neighbouring windows travel as one text, to where all windows go
that have the same least anchor inside. Hashes only bring windows together; words decide.

Texts are dealt to bounded chunks by row position. A chunk sends a hash or a text once, marked
if it holds it several times, so frequent passages do not pile up; buckets are bounded, too.
Beyond GROUP chunks, what goes to a bucket is first merged over GROUP chunks each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, sha256_text, shuffle_partitions, table, text_bytes
from .wordhash import mix, windows

WINDOW, PERIOD = 35, 21
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_BYTES, SLICE_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20, 16 << 20
GROUP = 1 << 14
HASH_KEY = "difference-cover"
U = np.uint64


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: ASCII white space only


def slices(texts: pa.ChunkedArray):
    """The texts in order, in lists of SLICE_BYTES or of one text."""
    held, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if held and size + len(t) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class Words:
    """The words of some documents after each other, with a hash each, and where each document starts."""

    def __init__(self, texts: list[str]):
        self.docs = [split(t) for t in texts]
        self.n = np.array([len(d) for d in self.docs], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n)))
        flat = np.empty(self.start[-1], dtype=object)
        flat[:] = [w for d in self.docs for w in d]
        self.hashes = pd.util.hash_array(flat, hash_key=HASH_KEY, categorize=False).astype(U)  # SipHash
        self.end_of = np.repeat(self.start[1:], self.n)
        self.pos = np.arange(len(flat)) - np.repeat(self.start[:-1], self.n)
        self.runs = windows(self.hashes, ANCHOR)  # every run of anchor length, those across documents too

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of documents that have a window at all."""
        enough = np.repeat(self.n >= WINDOW, self.n)
        at = np.flatnonzero(np.isin(self.pos % PERIOD, COVER) & enough & (np.arange(len(self.pos)) + ANCHOR <= self.end_of))
        return at, self.runs[at]

    def extended(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(first window, windows, route, text) of each group of neighbouring windows with one least anchor, around anchors in known."""
        at, h = self.anchors()
        at = at[among(h, known)]
        starts = np.flatnonzero(np.arange(len(self.pos)) + WINDOW <= self.end_of)
        starts = starts[covered(len(self.pos), at, PERIOD - 1, 1)[starts]]
        if not len(starts):
            return starts, starts, np.zeros(0, dtype=U), []
        least = sliding_least(self.runs, PERIOD)[starts]
        first = np.flatnonzero(np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1]))))
        count = np.diff(np.concatenate((first, [len(starts)])))
        joined = b" ".join([b" ".join(d) for d in self.docs if d]) + b" "
        at = np.concatenate(([0], np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32) + 1))
        a, b = at[starts[first]], at[starts[first] + count - 1 + WINDOW] - 1
        return starts[first], count, least[first], [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each occurs more than once."""
    if not parts:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=bool)
    distinct, count = np.unique(np.concatenate(parts), return_counts=True)
    return distinct, count > 1


def dealt(chunk: int, bucket: np.ndarray, blobs, several: np.ndarray) -> pa.Table:
    """A row for each bucket; blobs(from, to) gives what goes there. Buckets come in order, each one's entries together."""
    named, at = np.unique(bucket, return_index=True)
    ends = np.append(at[1:], len(bucket))[: len(at)]
    data = [blobs(a, b) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    marks = [np.packbits(several[a:b]).tobytes() for a, b in zip(at, ends, strict=True)]
    return pa.table({"bucket": pa.array(named.astype(np.int32)), "chunk": pa.array(np.full(len(named), chunk, dtype=np.int32)), "data": pa.array(data, pa.binary()), "several": pa.array(marks, pa.binary())})


DEALT, ANSWER = "bucket int, chunk int, data binary, several binary", "chunk int, bucket int, data binary"


def marks_of(t: pa.Table, counts) -> np.ndarray:
    """The several marks of all rows after each other, as 0 and 1."""
    return np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), dtype=np.uint8), count=n) for m, n in zip(t.column("several"), counts, strict=True)])


def answer(t: pa.Table, data: list[bytes]) -> pa.Table:
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "data": pa.array(data, pa.binary())}).filter(pa.array([bool(x) for x in data]))


def anchors_in(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=U) for x in t.column("data")]


def repeated_anchors(t: pa.Table) -> pa.Table:
    """For each chunk, the hashes it sent that occur more than once in all."""
    parts = anchors_in(t)
    sizes = [len(p) for p in parts]
    _, place = np.unique(np.concatenate(parts), return_inverse=True)
    more = np.bincount(place, weights=1 + marks_of(t, sizes))[place] > 1
    ends = np.cumsum(sizes)
    return answer(t, [p[more[e - n : e]].tobytes() for p, n, e in zip(parts, sizes, ends, strict=True)])


def merged_anchors(key, t):
    """What chunks of one group sent to a bucket, as if the group were one chunk."""
    parts = anchors_in(t)
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    several = np.bincount(place, weights=1 + marks_of(t, [len(p) for p in parts])) > 1
    return dealt(key[1].as_py(), np.full(len(distinct), key[0].as_py()), lambda a, b: distinct[a:b].tobytes(), several)


def anchors_told(key, t, said):
    """The group's answer, for each of its chunks."""
    known = gathered(said)
    return answer(t, [p[among(p, known)].tobytes() for p in anchors_in(t)])


def same_words(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each window of ids that starts there: the same if and only if all its words are."""
    h = windows(ids.astype(U), WINDOW)[starts]
    order = np.argsort(h, kind="stable")
    p, q = starts[order[:-1]], starts[order[1:]]
    like = h[order[:-1]] == h[order[1:]]
    differ = np.zeros(len(p), dtype=bool)
    for k in range(WINDOW):
        differ |= ids[p + k] != ids[q + k]
    out = np.empty(len(starts), dtype=np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~like)))
    clash = like & differ
    if clash.any():  # two sequences under one hash: name those by their words
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(h, h[order[:-1]][clash])).tolist():
            out[i] = len(starts) + names.setdefault(ids[starts[i] : starts[i] + WINDOW].tobytes(), len(names))
    return out


def repeated_windows(t: pa.Table) -> pa.Table:
    """For each chunk, a bit for each window of the texts it sent, in order: whether it occurs more than once in all."""
    blobs = [x.as_py() for x in t.column("data")]
    data = b"\n".join(blobs)
    ids = pa.array(data.split(), pa.binary()).dictionary_encode().indices.to_numpy()
    gaps = np.frombuffer(data, dtype=np.uint8)
    gaps = gaps[(gaps == 32) | (gaps == 10)]
    ends = np.append(np.flatnonzero(gaps == 10) + 1, len(ids))  # of the texts, in words
    sizes = np.diff(ends, prepend=0)
    starts = np.flatnonzero(np.arange(len(ids)) + WINDOW <= np.repeat(ends, sizes))
    texts = [b.count(b"\n") + 1 for b in blobs]
    weight = np.repeat(1 + marks_of(t, texts), sizes - WINDOW + 1)
    name = np.unique(same_words(ids, starts), return_inverse=True)[1]
    more = np.bincount(name, weights=weight)[name] > 1
    upto = np.concatenate(([0], np.cumsum(sizes - WINDOW + 1)))[np.concatenate(([0], np.cumsum(texts)))]
    return answer(t, [np.packbits(more[a:b]).tobytes() if more[a:b].any() else b"" for a, b in zip(upto[:-1], upto[1:], strict=True)])


def merged_texts(key, t):
    """What chunks of one group sent to a bucket, as if the group were one chunk."""
    parts = [x.as_py().split(b"\n") for x in t.column("data")]
    count: dict[bytes, int] = {}
    for x, more in zip((x for p in parts for x in p), marks_of(t, [len(p) for p in parts]).tolist(), strict=True):
        count[x] = count.get(x, 0) + 1 + more
    texts = sorted(count)
    return dealt(key[1].as_py(), np.full(len(texts), key[0].as_py()), lambda a, b: b"\n".join(texts[a:b]), np.array([count[x] > 1 for x in texts]))


def texts_told(key, t, said):
    """The group's answer, for each of its chunks."""
    if not said.num_rows or not t.num_rows:
        return answer(t, [b""] * t.num_rows)
    parts = [x.as_py().split(b"\n") for x in t.column("data")]
    texts = sorted({x for p in parts for x in p})
    size = [x.count(b" ") + 2 - WINDOW for x in texts]
    flags = np.unpackbits(np.frombuffer(said.column("data")[0].as_py(), dtype=np.uint8), count=sum(size))
    own = dict(zip(texts, np.split(flags, np.cumsum(size)[:-1]), strict=True))
    every = [np.concatenate([own[x] for x in p]) for p in parts]
    return answer(t, [np.packbits(x).tobytes() if x.any() else b"" for x in every])


def repeated(sent: DataFrame, chunks: int, find, merge, told) -> DataFrame:
    """The answers to what chunks sent: by bucket, or first by groups of chunks, which then stand for theirs."""
    if chunks <= GROUP:
        return sent.groupBy("bucket").applyInArrow(find, ANSWER)
    grouped = sent.withColumn("part", F.col("chunk") % (-(-chunks // GROUP)))
    said = grouped.groupBy("bucket", "part").applyInArrow(merge, DEALT).groupBy("bucket").applyInArrow(find, ANSWER)
    return grouped.groupBy("bucket", "part").cogroup(said.withColumnRenamed("chunk", "part").groupBy("bucket", "part")).applyInArrow(told, ANSWER)


def gathered(t: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), dtype=U) for x in t.column("data")]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=U)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among some (sorted, distinct)."""
    if not len(some) or not len(values):
        return np.zeros(len(values), dtype=bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def covered(n: int, starts: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which of n positions lie within [start - before, start + after) of any start."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, np.maximum(starts - before, 0), 1)
    np.add.at(step, np.minimum(starts + after, n), -1)
    return np.cumsum(step[:n]) > 0


class Sent:
    """The texts a chunk sends, in the one order that its rows give whatever order they come in."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.number: dict[bytes, int] = {}
        self.route: list[int] = []
        self.count: list[int] = []

    def add(self, route: np.ndarray, texts: list[bytes]) -> list[int]:
        """Numbers of the texts."""
        out = []
        for r, x in zip(((mix(route, 7) >> U(33)) % U(self.buckets)).tolist(), texts, strict=True):
            i = self.number.setdefault(x, len(self.route))
            if i == len(self.route):
                self.route.append(r)
                self.count.append(1)
            else:
                self.count[i] = 2
            out.append(i)
        return out

    def order(self) -> tuple[list[bytes], list[int]]:
        """The texts by bucket, then by their bytes, and the number of each."""
        texts = sorted(self.number, key=lambda x: (self.route[self.number[x]], x))
        return texts, [self.number[x] for x in texts]

    def rows(self, chunk: int) -> pa.Table:
        texts, numbers = self.order()
        bucket = np.array([self.route[i] for i in numbers], dtype=np.int64)
        return dealt(chunk, bucket, lambda a, b: b"\n".join(texts[a:b]), np.array([self.count[i] > 1 for i in numbers], dtype=bool))

    def bits(self, answers: pa.Table) -> dict[int, np.ndarray]:
        """By number of a text, whether each of its windows repeats."""
        said = dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
        texts, numbers = self.order()
        size = [x.count(b" ") + 2 - WINDOW for x in texts]
        out, a = {}, 0
        while a < len(texts):
            b = a
            while b < len(texts) and self.route[numbers[b]] == self.route[numbers[a]]:
                b += 1
            found = said.get(self.route[numbers[a]])
            if found is not None:
                total = sum(size[a:b])
                if len(found) != (total + 7) // 8:
                    raise RuntimeError("the rows of a chunk changed between two reads: give a table that is read the same each time")
                flags = np.unpackbits(np.frombuffer(found, dtype=np.uint8), count=total).astype(bool)
                for k, part in zip(numbers[a:b], np.split(flags, np.cumsum(size[a:b])[:-1]), strict=True):
                    out[k] = part
            a = b
        return out


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row.

    Words are maximal runs of anything but ASCII white space. A word goes if a window of WINDOW
    words covers it whose word sequence also starts somewhere else, in the same text or another;
    windows are judged on the input. kept holds the other words, joined by one space. Null texts
    have no words; texts with fewer words than a window stay whole; repeated rows are repeats of
    each other, whatever their ids; an empty table gives an empty result. Rows are dealt by their
    position, so df must come in the same order whenever it is read, as files and checkpoints do.
    """
    spark = df.sparkSession
    prepare(spark)
    rows, size = text_bytes(df, text)
    width = shuffle_partitions(spark)
    chunks = max(width, -(-size // CHUNK_BYTES))
    buckets = max(width, -(-size // 6 * 2 // BUCKET_BYTES))  # 8 bytes for each fourth word
    text_buckets = max(width, -(-size * 4 // BUCKET_BYTES))  # a text of 45 words for each 11 windows, where all repeats
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = own.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))

    def send_anchors(key, t):
        distinct, several = merged([np.repeat(*both) for both in (part_counts(Words(s).anchors()[1]) for s in slices(t.column("text")))])
        bucket = ((mix(distinct, 7) >> U(33)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        values = distinct[order]
        return dealt(key[0].as_py(), bucket[order], lambda a, b: values[a:b].tobytes(), several[order])

    def send_texts(key, t, known):
        sent = Sent(text_buckets)
        if known.num_rows:
            anchors = gathered(known)
            for s in slices(t.column("text")):
                _, _, route, texts = Words(s).extended(anchors)
                sent.add(route, texts)
        return sent.rows(key[0].as_py() if t.num_rows else 0)

    def cut(key, t, known):
        """known: repeated anchors (bucket -1) and answers to the texts."""
        told = np.array(known.column("kind").to_pylist(), dtype=bool)
        anchors, answers = known.filter(pa.array(~told)), known.filter(pa.array(told))
        sent, held = Sent(text_buckets), []
        if answers.num_rows:
            near = gathered(anchors)
            for s in slices(t.column("text")):
                words = Words(s)
                first, _, route, texts = words.extended(near)
                held.append((words.docs, first, sent.add(route, texts)))
        bits = sent.bits(answers) if held else {}
        n_words, removed, kept = [], [], []
        for docs, first, numbers in held or (([split(x) for x in s], [], []) for s in slices(t.column("text"))):
            ends = np.cumsum([len(d) for d in docs])
            starts = [f + np.flatnonzero(bits[k]) for f, k in zip(first, numbers, strict=True) if k in bits]
            gone = covered(int(ends[-1]), np.concatenate(starts), 0, WINDOW) if starts else None
            for words, b in zip(docs, ends.tolist(), strict=True):
                out = gone[b - len(words) : b] if gone is not None else None
                n = int(out.sum()) if out is not None else 0
                n_words.append(len(words))
                removed.append(n)
                kept.append(b" ".join([words[j] for j in np.flatnonzero(~out).tolist()] if n else words).decode())
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    anchors = repeated(docs.groupBy("chunk").applyInArrow(send_anchors, DEALT), chunks, repeated_anchors, merged_anchors, anchors_told)
    texts = docs.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(send_texts, DEALT)
    answers = repeated(texts, chunks, repeated_windows, merged_texts, texts_told)
    known = anchors.withColumn("kind", F.lit(False)).union(answers.withColumn("kind", F.lit(True)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def part_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and 1 or 2 for each: whether it occurs again."""
    distinct, count = np.unique(values, return_counts=True)
    return distinct, np.minimum(count, 2)


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """Words of every whole text of documents without passages that repeat. Null texts have no words; see remove_repeats."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", sha256_text(F.col("kept")).alias("kept_sha256"))


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM starts),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM dup),
gone_of AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, ws, coalesce(n, 0) AS n_removed, coalesce(ps, []) AS ps FROM w LEFT JOIN gone_of USING (doc_id)),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p FROM w),
stay AS (
  SELECT pos.doc_id, string_agg(w.ws[pos.p], ' ' ORDER BY pos.p) AS t
  FROM pos JOIN w USING (doc_id) ANTI JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY pos.doc_id)
SELECT kept.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(stay.t, '')) AS kept_sha256
FROM kept LEFT JOIN stay ON stay.doc_id = kept.doc_id
"""


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """All windows in a dictionary, for small tests."""
    docs = [(t or "").encode().split() for t in texts]
    count: dict[tuple, int] = {}
    for d in docs:
        for i in range(len(d) - window + 1):
            k = tuple(d[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if count[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone).decode()))
    return out
