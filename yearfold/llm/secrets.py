"""Secret scans: fixed patterns, and the Shannon entropy of windows that slide over candidate strings.

All of it is built-in column expressions, and linear in the text. A candidate is a maximal run
of at least WIDTH characters of keys (letters, digits and + / = _ -) with a letter and a digit.
What the allow-list knows is cut out of it; of what is left, the entropy of any WIDTH consecutive
characters is kept up by counts: one character enters, one leaves. The threshold depends on the
candidate's character class. What patterns found stays in any case; entropy adds to it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, prepare, private, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WIDTH = 20
RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
# Bits per character at which a window counts as random, by class.
THRESHOLDS = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.6), ("", 3.8))
# The allow-list. Examples, counted-up characters, and one character six times or more:
ALLOWED = "(?i)example|sample|dummy|placeholder|changeme|01234567|12345678|abcdefgh"
REPEATED = r"(.)\1{5,}"
# At the start of a run: UUIDs if they are all of it; named digests, hex or base64, as long as such are, or the run if it is no longer.
DIGESTS = {"md5": (32, 22), "sha1": (40, 27), "sha256": (64, 43), "sha384": (96, 64), "sha512": (128, 86)}
NAMED = "(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|" + "|".join(f"{n}[-_=](?:[0-9a-f]{{{h}}}|[a-z0-9+/_-]{{{b}}}=|[a-z0-9+/=_-]{{0,{h}}}$|)" for n, (h, b) in DIGESTS.items()) + ")"
SPAN, NONE = "ARRAY<STRUCT<start: INT, kind: INT, end: INT>>", "CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT>>)"
FIRST, PACKED = 43, 12  # the code point of +; counts of five bits in a long
SCAN_BLOCK, ENTROPY_BLOCK, TEXT_BLOCK = 256, 256, 2048


def q(pattern: str) -> str:
    """As an SQL string literal."""
    return "r'" + pattern + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def before(values: str, zero: str, add: str, name: str) -> str:
    """For each int of an array, what `add` (of $a and $x) makes of all before it, from zero; as an array.

    By blocks: what an array grown one by one would copy is bounded by the block.
    """
    part, step = f"slice({name}, b * {SCAN_BLOCK} + 1, {SCAN_BLOCK})", add.replace("$x", "x")
    grow = f"(a, x) -> named_struct('at', {step.replace('$a', 'a.at')}, 'out', concat(a.out, array(a.at))), a -> a.out)"
    start = "named_struct('at', $0, 'out', CAST(array() AS ARRAY<INT>))"
    blocks = f"sequence(0, (size({name}) - 1) div {SCAN_BLOCK})"
    sums = f"transform({blocks}, b -> aggregate({part}, {zero}, (a, x) -> {step.replace('$a', 'a')}))"
    carried = f"aggregate({sums}, {start.replace('$0', zero)}, {grow}"
    inner = f"flatten(zip_with({carried}, {blocks}, (c, b) -> aggregate({part}, {start.replace('$0', 'c')}, {grow}))"
    return let(values, name, f"CASE WHEN size({name}) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE {inner} END")


def spans(matches: str, text: str, pattern: str, kind: int, keep: str) -> str:
    """Spans of the kept matches: texts between matches and matches give the places. keep sees m, the match, and i from 0."""
    steps = f"zip_with({matches}, slice(split({text}, {q(pattern)}, -1), 1, size({matches})), (m, p) -> named_struct('p', length(p), 'm', length(m)))"
    places = before("transform(s, x -> x.p + x.m)", "0", "$a + $x", "v")
    every = f"zip_with(zip_with(s, {places}, (x, at) -> named_struct('start', at + x.p, 'kind', {kind}, 'end', at + x.p + x.m)), transform({matches}, (m, i) -> {keep.replace('$m', 'm').replace('$i', 'i')}), (x, ok) -> named_struct('x', x, 'ok', ok))"
    return f"CASE WHEN size({matches}) = 0 THEN {NONE} ELSE {let(steps, 's', f'CAST(transform(filter({every}, y -> y.ok), y -> y.x) AS {SPAN})')} END"


def entropy_term() -> str:
    """c * log2(c) for c from 0 to WIDTH, as an SQL array."""
    return "array(" + ", ".join(f"{(c * math.log2(c) if c else 0.0)!r}D" for c in range(WIDTH + 1)) + ")"


def random_enough(x: str, run: str) -> str:
    """Whether some window of the string x, the run or a part of it, reaches the threshold of the run's class.

    s is the sum of c * log2(c) over the counts c of the window's characters; the entropy of a
    full window is log2(WIDTH) - s / WIDTH, so the lowest s decides. Counts are packed into longs;
    long strings are gone through block by block, each with the characters before it, until one is random.
    """
    f = entropy_term()
    count = lambda at: f"CAST(shiftright(element_at(a.n, x.{at}k + 1), x.{at}s) & 31L AS INT)"
    unit = lambda at: f"CASE WHEN x.{at}k = k THEN shiftleft(1L, x.{at}s) ELSE 0L END"
    gain = f"element_at({f}, {count('e')} + 2) - element_at({f}, {count('e')} + 1)"
    loss = f"CASE WHEN x.lk < 0 THEN 0D ELSE element_at({f}, {count('l')} + 1) - element_at({f}, {count('l')}) END"
    s = f"(a.s + CASE WHEN x.ek = x.lk AND x.es = x.ls THEN 0D ELSE {gain} - {loss} END)"
    place = f"c -> named_struct('k', CAST((ascii(c) - {FIRST}) div {PACKED} AS INT), 's', (ascii(c) - {FIRST}) % {PACKED} * 5)"
    none = f"array_repeat(named_struct('k', -1, 's', 0), {WIDTH})"
    pairs = let(f"transform(split(w, ''), {place})", "p", f"zip_with(p, slice(concat({none}, p), 1, size(p)), (e, l) -> named_struct('ek', e.k, 'es', e.s, 'lk', l.k, 'ls', l.s))")
    lowest = f"""aggregate({pairs}, named_struct('n', array_repeat(0L, {80 // PACKED + 1}), 's', 0D, 'i', 1, 'low', 1e9D),
        (a, x) -> named_struct('n', transform(a.n, (v, k) -> v + {unit('e')} - {unit('l')}), 's', {s}, 'i', a.i + 1,
          'low', CASE WHEN a.i >= {WIDTH} THEN least(a.low, {s}) ELSE a.low END), a -> a.low)"""
    least = "CASE " + " ".join(f"WHEN {run} RLIKE {q(p)} THEN {t}D" for p, t in THRESHOLDS[:-1]) + f" ELSE {THRESHOLDS[-1][1]}D END"
    blocks = f"regexp_extract_all({x}, '(?s)(?=(.{{{WIDTH},{ENTROPY_BLOCK + WIDTH - 1}}})).{{1,{ENTROPY_BLOCK}}}', 1)"
    return let(least, "t", f"exists({blocks}, w -> {math.log2(WIDTH)!r}D - ({lowest}) / {WIDTH} >= t)")


def merged(sorted_spans: str) -> str:
    """Spans (a, b) of what the sorted ones cover; those that touch are one."""
    most = before("transform(o, x -> x.end)", "-1", "greatest($a, $x)", "v")
    heads = f"filter(zip_with(o, {most}, (x, m) -> named_struct('a', x.start, 'm', m)), h -> h.a > h.m)"
    joined = let(heads, "h", "zip_with(h, slice(concat(h, array(named_struct('a', 0, 'm', array_max(transform(o, x -> x.end))))), 2, size(h)), (x, y) -> named_struct('a', x.a, 'b', y.m))")
    return let(sorted_spans, "o", f"CASE WHEN size(o) = 0 THEN CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>) ELSE {joined} END")


def uncovered(more: str, base: str) -> str:
    """The spans of more that those of base do not cover entirely: the last merged one that starts no later ends sooner."""
    both = f"array_sort(concat(transform({merged(base)}, x -> named_struct('at', x.a, 'own', 0, 'kind', 0, 'end', x.b)), transform({more}, x -> named_struct('at', x.start, 'own', 1, 'kind', x.kind, 'end', x.end))))"
    upto = before("transform(z, x -> CASE WHEN x.own = 0 THEN x.end ELSE 0 END)", "0", "greatest($a, $x)", "v")
    left = let(both, "z", f"filter(zip_with(z, {upto}, (x, r) -> named_struct('x', x, 'r', r)), y -> y.x.own = 1 AND y.r < y.x.end)")
    return f"CASE WHEN size({more}) = 0 OR size({base}) = 0 THEN {more} ELSE CAST(transform({left}, y -> named_struct('start', y.x.at, 'kind', y.x.kind, 'end', y.x.end)) AS {SPAN}) END"


def _scanned(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """df with its own columns and spans in <p>base and <p>added; and p, a prefix of no column of df."""
    prepare(df.sparkSession)
    p = private(df)
    c = lambda name: f"`{p}{name}`"
    d = df.withColumn(f"{p}t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    found = {"assign": (ASSIGN, 0), "value": (ASSIGN, 1), "access": (ACCESS, 0), "hex": (HEX, 0), "run": (RUN, 0)}
    d = d.withColumns({p + k: F.expr(f"regexp_extract_all({c('t')}, {q(x)}, {g})") for k, (x, g) in found.items()})
    base = [spans(c("assign"), c("t"), ASSIGN, 0, f"length(element_at({c('value')}, $i + 1)) >= {ASSIGN_LEAST}"), spans(c("access"), c("t"), ACCESS, 1, "true"), spans(c("hex"), c("t"), HEX, 2, "true")]
    likely = "$m RLIKE '[0-9]' AND $m RLIKE '[A-Za-z]'"
    parts = f"flatten(transform(split(regexp_replace($m, {q(NAMED)}, ''), {q(ALLOWED)}, -1), x -> split(x, {q('(?i)' + REPEATED)}, -1)))"
    windows = f"exists({parts}, y -> length(y) >= {WIDTH} AND {random_enough('y', '$m')})"
    d = d.withColumns({f"{p}base": F.expr(f"array_sort(concat({', '.join(base)}))"), f"{p}run": F.expr(f"CASE WHEN exists({c('run')}, m -> {likely.replace('$m', 'm')}) THEN {c('run')} ELSE CAST(array() AS ARRAY<STRING>) END")})
    d = d.withColumn(f"{p}more", F.expr(spans(c("run"), c("t"), RUN, 3, f"{likely} AND {windows}")))
    return d.withColumn(f"{p}added", F.expr(uncovered(c("more"), c("base")))), p


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and added: arrays of (start, kind, end), code points, end exclusive, in order.

    kind indexes KINDS; base holds what the patterns find, added what entropy adds: runs with a
    random window that no match of the allow-list overlaps, unless base covers them entirely.
    Columns of these names, in any case, are replaced. Null and empty texts have no spans; rows
    are handled one by one, so repeated rows stay and empty tables stay empty.
    """
    d, p = _scanned(df, text)
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("base", "added")], F.col(f"`{p}base`").alias("base"), F.col(f"`{p}added`").alias("added"))


def as_text(spans_col: str) -> F.Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans_col}, s -> concat_ws(':', element_at({kinds}, s.kind + 1), CAST(s.start AS STRING), CAST(s.end AS STRING))), ',')")


def redact(df: DataFrame, text: str = "text", by: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span, base and added, replaced in the text. Null texts stay null."""
    d, p = _scanned(df, text)
    c = lambda name: f"`{p}{name}`"
    d = d.withColumn(f"{p}cut", F.expr(merged(f"array_sort(concat({c('base')}, {c('added')}))")))
    # what stays, taken from blocks of the text, since the place of a character is counted from the start
    stays = f"zip_with(concat(array(0), transform({c('cut')}, x -> x.b)), concat(transform({c('cut')}, x -> x.a), array(length({c('t')}))), (a, b) -> named_struct('a', a, 'b', b))"
    piece = f"array_join(transform(CASE WHEN s.a < s.b THEN sequence(s.a div {TEXT_BLOCK}, (s.b - 1) div {TEXT_BLOCK}) ELSE CAST(array() AS ARRAY<BIGINT>) END, k -> CASE WHEN s.a <= k * {TEXT_BLOCK} AND s.b >= (k + 1) * {TEXT_BLOCK} THEN element_at(bs, CAST(k + 1 AS INT)) ELSE substring(element_at(bs, CAST(k + 1 AS INT)), CAST(greatest(s.a - k * {TEXT_BLOCK}, 0L) + 1 AS INT), CAST(s.b - greatest(s.a, k * {TEXT_BLOCK}) AS INT)) END), '')"
    put = "'" + by.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cut = f"""CASE WHEN size({c('cut')}) = 0 THEN `{text}` ELSE {let(f"regexp_extract_all({c('t')}, '(?s).{{1,{TEXT_BLOCK}}}', 0)", 'bs', f"array_join(transform({stays}, s -> {piece}), {put})")} END"""
    return d.withColumn(f"{p}new", F.expr(cut)).select(*[F.col(f"`{p}new`").alias(x) if x == text else F.col(f"`{x}`") for x in df.columns])


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents, as counts, a digest and spans. Null texts count as empty; see scan."""
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS LONG)")
    every = d.withColumn("every", F.expr("array_sort(concat(base, added))"))
    return every.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(F.encode(as_text("base"), "UTF-8"), 256).alias("base_sha256"), as_text("every").alias("spans"))


def brute_force(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added) of one text in plain Python, each window counted anew; for tests."""
    t = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    hit = {i for a, _, b in base for i in range(a, b)}
    added = []
    for m in re.finditer(r"[A-Za-z0-9+/=_-]+", t):
        x = m[0]
        if len(x) < WIDTH or not re.search("[0-9]", x) or not re.search("[A-Za-z]", x):
            continue
        least = next(v for p, v in THRESHOLDS if re.search(p, x))
        parts = [z for y in re.split(ALLOWED, re.sub(NAMED, "", x)) for z in re.split("(?i)" + "|".join(re.escape(k) + "{6,}" for k in "abcdefghijklmnopqrstuvwxyz0123456789+/=_-"), y)]
        windows = [w for y in parts for w in (y[i : i + WIDTH] for i in range(len(y) - WIDTH + 1))]
        entropy = lambda w: -sum(w.count(c) / WIDTH * math.log2(w.count(c) / WIDTH) for c in set(w))
        if any(entropy(w) >= least - 1e-12 for w in windows) and not hit.issuperset(range(m.start(), m.end())):
            added.append((m.start(), 3, m.end()))
    return sorted(base), added


def either_case(words: str) -> str:
    """The pattern with a class for each ASCII letter: DuckDB's own (?i) also folds letters such as the long s."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def oracle() -> str:
    """DuckDB SQL for op2_secrets: places from the texts between matches, each window's entropy counted anew."""
    lit = lambda p: "'" + p.replace("'", "''") + "'"
    assign = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    run = "[A-Za-z0-9+/=_-]{20,}"
    # No back reference in DuckDB: one alternative for each character.
    repeated = "(?i)" + "|".join((c if c.isalnum() or c in "/=_-" else "\\" + c) + "{6,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/=_-")
    kinds = [(0, assign, 2), (1, ACCESS, 0), (2, HEX, 0), (3, run, 0)]
    found = " UNION ALL ".join(f"SELECT rid, t, {k} AS kind, regexp_extract_all(t, {lit(p)}, 0) AS ms, regexp_extract_all(t, {lit(p)}, {g}) AS vs, regexp_split_to_array(t, {lit(p)}) AS ps FROM d" for k, p, g in kinds)
    least = "CASE " + " ".join(f"WHEN regexp_matches(m, {lit(p)}) THEN {t}" for p, t in THRESHOLDS[:-1]) + f" ELSE {THRESHOLDS[-1][1]} END"
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    one = f"{name} || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT rid, kind, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM found WHERE len(ms) > 0),
placed AS (SELECT rid, kind, m, v, sum(length(p) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS b FROM each),
spans AS (SELECT rid, kind, m, CAST(b - length(m) AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM placed WHERE kind <> 0 OR length(v) >= {ASSIGN_LEAST}),
base AS (SELECT rid, kind, a, b FROM spans WHERE kind < 3),
likely AS (SELECT DISTINCT m FROM spans WHERE kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
cut AS (SELECT m, unnest(regexp_split_to_array(regexp_replace(m, {lit(NAMED)}, ''), {lit(ALLOWED)})) AS y FROM likely),
parts AS (SELECT m, unnest(regexp_split_to_array(y, {lit(repeated)})) AS y FROM cut),
windows AS (SELECT m, unnest(list_transform(range(1, length(y) - {WIDTH} + 2), lambda i: substring(y, i, {WIDTH}))) AS w FROM parts WHERE length(y) >= {WIDTH}),
bits AS (SELECT m, max(list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: -(({WIDTH} - length(replace(w, c, ''))) / {WIDTH}.0) * log2(({WIDTH} - length(replace(w, c, ''))) / {WIDTH}.0)))) AS most FROM windows GROUP BY m),
random AS (SELECT m FROM bits WHERE most >= {least}),
heads AS (SELECT rid, a, b, a > coalesce(max(b) OVER (PARTITION BY rid ORDER BY a, b DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS head, kind FROM base),
cover AS (SELECT rid, min(a) AS a, max(b) AS b FROM (SELECT rid, a, b, count(*) FILTER (head) OVER (PARTITION BY rid ORDER BY a, b DESC, kind ROWS UNBOUNDED PRECEDING) AS g FROM heads) GROUP BY rid, g),
added AS (SELECT s.rid, s.kind, s.a, s.b FROM spans s JOIN random USING (m) WHERE s.kind = 3
  AND NOT EXISTS (SELECT 1 FROM cover x WHERE x.rid = s.rid AND x.a <= s.a AND x.b >= s.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added),
texts AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  string_agg({one}, ',' ORDER BY a, kind) FILTER (kind < 3) AS base_text, string_agg({one}, ',' ORDER BY a, kind) AS all_text FROM every GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(all_text, '') AS spans
FROM d LEFT JOIN texts USING (rid)"""


ORACLE = oracle()
