"""Near-duplicates by SimHash, found with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree, in one of two 32-bit segments,
but for at most one bit. So each segment is indexed exactly and 32 times with one bit blanked;
an equality join on these variants finds every pair, and the whole fingerprints verify it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import looked_up, prepare, private, shuffle_partitions, table
from .wordhash import xxh64

SHINGLE, SEED, MOST_BITS = 3, 42, 2
SMALL_RUN = 16
FLUSH, BUCKET_ROWS = 1 << 14, 1_000_000
U = np.uint64


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One SimHash per text over its 3-word shingles, as unsigned 64-bit integers."""
    docs = [(t or "").encode().lower().split() for t in texts]  # bytes: only A-Z and ASCII white space
    out = np.zeros(len(docs), dtype=U)
    held, size = [], 0
    for i, words in enumerate(docs):
        if words:
            held.append(i)
            size += len(words)
        if held and (size >= 1 << 17 or i == len(docs) - 1):
            out[held] = _fingerprints([docs[k] for k in held])
            held, size = [], 0
    return out


def _fingerprints(docs: list[list[bytes]]) -> np.ndarray:
    n = np.array([len(d) for d in docs])
    buf = b" ".join(w for d in docs for w in d) + b" "
    ends = np.flatnonzero(np.frombuffer(buf, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shingles = np.maximum(n - SHINGLE + 1, 1)
    doc = np.repeat(np.arange(len(docs)), shingles)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first = np.repeat(np.cumsum(n) - n, shingles) + within
    last = first + np.repeat(np.minimum(n, SHINGLE) - 1, shingles)
    h = xxh64(buf, starts[first], ends[last] - starts[first], SEED)
    ones = np.zeros((len(docs), 64), dtype=np.int64)
    for a in range(0, len(h), 1 << 16):
        part, of = h[a : a + (1 << 16)], doc[a : a + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        change = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1))
        ones[of[change]] += np.add.reduceat(bits, change, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(U)


def add_fingerprint(df: DataFrame, text: str = "text", to: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint as a long. A null or blank text has fingerprint zero."""
    kept = [c for c in (keep or df.columns) if c.lower() != to.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(private(df) + "text"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(to, T.LongType())])

    def run(batches):
        for b in batches:
            fp = fingerprints(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(fp.view(np.int64))], names=[*kept, to])

    return source.mapInArrow(run, schema)


def variants(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """66 keys per fingerprint (2 segments, each exact and with one of 32 bits blanked), and the fingerprint of each."""
    keys = []
    for seg in range(2):
        part = (fp >> U(32 * seg)) & U(0xFFFFFFFF)
        for j in range(33):
            keys.append((part & ~U(1 << j) if j < 32 else part) | U((33 * seg + j) << 32))
    return np.concatenate(keys), np.tile(fp, 66)


def run_links(key: int, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that is linked within a long run of one key, without forming its pairs.

    Fingerprints that are equal but for two given bits are all within distance two, and of these
    there are four at most. Blanking each pair of bits in which the run's members may differ
    therefore finds every link; those between what is connected already are left out, and once all
    is connected, so is the rest of the blanking.
    """
    seg, j = divmod(key >> 32, 33)
    free = [32 * (1 - seg) + b for b in range(32)]
    blank = [(a, b) for i, a in enumerate(free) for b in free[i + 1 :]] if j == 32 else [(32 * seg + j, b) for b in free]
    links, root = [], np.arange(len(fp))
    for a, b in blank:
        masked = fp & ~U((1 << a) | (1 << b))
        order = np.argsort(masked, kind="stable")
        same = masked[order][1:] == masked[order][:-1]
        u, v = order[:-1][same], order[1:][same]
        new = root[u] != root[v]
        for x, y in zip(u[new].tolist(), v[new].tolist(), strict=True):
            low, high = sorted((_root(root, x), _root(root, y)))
            if low != high:
                root[high] = low
                links.append((int(fp[x]), int(fp[y])))
        if new.any():
            while (root[root] != root).any():
                root = root[root]
            if len(links) == len(fp) - 1:
                break
    return links


def _root(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return int(i)


def verify(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints (lower, higher) among those that share a key."""
    order = np.lexsort((fp, keys))
    keys, fp = keys[order], fp[order]
    change = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    size = np.diff(change)
    links = []
    in_small = np.repeat(size <= SMALL_RUN, size)
    for d in range(1, min(SMALL_RUN, len(keys))):
        near = np.flatnonzero((keys[d:] == keys[:-d]) & in_small[d:])
        if not len(near):
            break
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= MOST_BITS]
        links.append((fp[near], fp[near + d]))
    for k in np.flatnonzero(size > SMALL_RUN).tolist():
        found = np.array(run_links(int(keys[change[k]]), fp[change[k] : change[k + 1]]), dtype=U).reshape(-1, 2)
        links.append((found[:, 0], found[:, 1]))
    if not links:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=U)
    a, b = (np.concatenate([x[i] for x in links]) for i in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints that are within two bits; not all inside large groups, but enough to connect them."""
    spark = fps.sparkSession
    n = fps.count()
    buckets = max(shuffle_partitions(spark), -(-n * 66 // BUCKET_ROWS))
    tasks = max(shuffle_partitions(spark), -(-n * 66 // (16 * BUCKET_ROWS)))  # each fingerprint grows by a factor of 66

    def deal(batches):
        def rows(held):
            keys, own = variants(np.concatenate(held))
            bucket = ((keys * U(0x9E3779B97F4A7C15)) >> U(33)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            named, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:])
            return pa.RecordBatch.from_arrays([pa.array(named.astype(np.int32)), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([own[p].tobytes() for p in parts], pa.binary())], names=["bucket", "keys", "fps"])

        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(U))
            size += len(held[-1])
            if size >= FLUSH:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    def join(t):
        keys, own = (np.concatenate([np.frombuffer(x.as_py(), dtype=U) for x in t.column(c)]) for c in ("keys", "fps"))
        a, b = verify(keys, own)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = fps.select(F.col(fp).alias("fp")).repartition(tasks, "fp").mapInArrow(deal, "bucket int, keys binary, fps binary")
    return dealt.groupBy("bucket").applyInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): all nodes of a connected component get one root.

    Each round leads every node to its smallest neighbour (twice) and contracts the edges by
    that; the number of nodes at least halves. Edges and roots are checkpointed in each round, and
    hubs, which many edges share, are no hot keys (looked_up).
    """
    edges = edges.where("a != b").distinct().checkpoint()
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")).checkpoint()
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).select(F.col("a").alias("at"), "up").checkpoint()
        up = looked_up(up, up.select(F.col("at").alias("up"), F.col("up").alias("upper")), ["up"]).select("at", F.coalesce("upper", "up").alias("up")).checkpoint()
        lead = lambda df, c: looked_up(df, up.select(F.col("at").alias(c), "up"), [c]).withColumn(c, F.coalesce("up", c)).drop("up").checkpoint()  # noqa: E731, B023
        edges = lead(lead(edges, "a"), "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
        roots = lead(roots, "root")
    return roots


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row.

    component_id is the smallest doc_id that can be reached over links, the row's own included.
    Rows with a null doc_id take part but never name a component unless it has no other ids
    (then component_id is null). Null, empty and blank texts have fingerprint zero, which links
    like any other. Repeated rows stay repeated; an empty table gives an empty result.
    """
    return _grouped(df, doc_id, text).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(fp, doc_id, component_id, root) of every row; root is a fingerprint that only the rows of one component share."""
    prepare(df.sparkSession)
    docs = add_fingerprint(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")), "t", keep=["doc_id"]).checkpoint()
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(links(fps))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")).checkpoint()
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).checkpoint()
    found = looked_up(named, least, ["root"]).select("fp", "component_id", "root").checkpoint()
    return looked_up(docs, found, ["fp"])


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay when each group of near-duplicates keeps its row with the smallest doc_id.

    Where doc_ids repeat or are null, one row of each group stays still: of those with the smallest
    id the one with the least text, in the order of its fingerprint and then of its letters; equal
    rows that differ elsewhere count as one. Groups are told apart by their root, as a smallest
    doc_id can be that of several.
    """
    found = _grouped(df, doc_id, text).checkpoint()
    p = private(df)
    n, ids, named = found.agg(F.count(F.lit(1)), F.countDistinct("doc_id"), F.count("doc_id")).first()
    if n == ids == named:
        stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(f"{p}id"))
        return df.join(stay, F.col(f"`{doc_id}`") == F.col(f"{p}id"), "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
    return _keep_one_of_repeated(df, found, doc_id, text, p)


def _keep_one_of_repeated(df: DataFrame, found: DataFrame, doc_id: str, text: str, p: str) -> DataFrame:
    """For ids that are null or repeat: rows are told apart by id and fingerprint, and the first of those that share both stays."""
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("s"))
    stay = least.select(F.col("s.doc_id").alias(f"{p}id"), F.col("s.fp").alias(f"{p}fp"))
    marked = add_fingerprint(df, text, f"{p}own")
    kept = marked.join(stay, F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}own") == F.col(f"{p}fp")), "left_semi")
    rest = [c for c in df.columns if c not in (doc_id, text)]
    whole = F.struct(F.col(f"`{text}`").alias("t"), *[F.xxhash64(F.col(f"`{c}`")).alias(f"h{i}") for i, c in enumerate(rest)], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    one = kept.groupBy(F.col(f"`{doc_id}`").alias(f"{p}id"), f"{p}own").agg(F.min_by(whole, F.struct(F.col(f"`{text}`").isNull().alias("n"), F.col(f"`{text}`").alias("t"), *[F.xxhash64(F.col(f"`{c}`")).alias(f"h{i}") for i, c in enumerate(rest)])).alias(f"{p}row"))
    at = {doc_id: f"{p}id", text: f"{p}row.t"} | {c: f"{p}row.c{i}" for i, c in enumerate(rest)}
    return one.select(*[F.col(at[c]).alias(c) for c in df.columns])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of documents. Null texts have fingerprint zero; see near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """All pairs, for small tests."""
    import xxhash

    def one(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s, SEED) for s in sh]
        return reduce(lambda a, k: a | ((2 * sum(h >> k & 1 for h in hs) > len(hs)) << k), range(64), 0)

    fp = [one(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= MOST_BITS:
                group[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]
