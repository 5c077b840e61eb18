"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens. It starts as one
state with a loop for every byte. Each merge (u, v) -> w adds a gadget: wherever u leads to a
state with an arc v, an arc w is added that goes where v went, and the arc u is led to a copy
of its target without v. All arcs with one label always lead to one state, so a state is named by
the label that leads to it, and a gadget is three edits: the state of u loses v, the state of w is
that of v as it is then, and w stands where u stands then. States and arcs thus hold what differs
from what they were copied from, and the copy's source and time (``MergeAutomaton.gadget``).

The result accepts exactly one token sequence for any bytes, the BPE one. For encoding, its arcs
are spelled in bytes along a trie of labels, and that is made deterministic by subsets: a state is
the last token of what was read, and the tokens begun but not ended, each with the token before it.
Words run through the table of these transitions, one look-up a byte; each state names the token
that ends there, so the tokens are read off from the end. A table entry is worked out when first
met, and the table starts afresh when full. Decoding emits the labels of the arcs taken.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, private, table

NEVER = 1 << 40
CACHE_ENTRIES, TABLE_STATES, WIDTH, NODE, LONG_WORD = 1 << 17, 1 << 18, 64, 24, 1 << 14

# The pre-tokenizer pattern of byte-level BPE.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same on texts of PLAIN characters only, where both libraries agree on letters, digits and spaces.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ–—‘’“”…]*")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Where a blank stands beside other white space, a text cannot be cut before each blank.
RUN = re.compile(r"\s (?:\s|$)|  ")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return letters


class MergeAutomaton:
    def __init__(self, spec: str):
        model = json.loads(spec)
        flags = model["model"]
        if flags["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["normalizer"]:
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        back = {v: k for k, v in byte_letters().items()}
        vocab = flags["vocab"]
        self.labels = [b""] * (max([*vocab.values(), *(a["id"] for a in model["added_tokens"])]) + 1)
        special = {a["content"]: a["id"] for a in model["added_tokens"]}
        for content, i in special.items():
            self.labels[i] = content.encode()
        named = {}
        for s, i in vocab.items():
            if s not in special:
                self.labels[i] = bytes(back[c] for c in s)
                named[s] = i
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # The automaton over tokens, by label: when made, what its state is a copy of, beside what its arcs stand.
        self.made = [0] * len(self.labels)
        self.copy_of: list[int] = [-1] * len(self.labels)
        self.beside: list[int] = [-1] * len(self.labels)
        self.lost: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.arcs: dict[int, bool] = {}
        arcs = {i for i in named.values() if len(self.labels[i]) == 1}
        for r, pair in enumerate(flags["merges"], 1):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self.gadget(r, named[u], named[v], named[u + v], arcs)
        # The same spelled in bytes: a trie of the labels, and the table of subsets.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        for t in sorted(arcs):
            node = 0
            for byte in self.labels[t]:
                self.inner[node] = True
                if (key := node << 8 | byte) not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.ends[node] = t
        self.sizes = [len(x) for x in self.labels]
        often = Counter(byte for t in arcs for byte in self.labels[t]).most_common(WIDTH - 1)
        self.column = bytes(next((i for i, (byte, _) in enumerate(sorted(often)) if byte == b), WIDTH - 1) for b in range(256))
        self.afresh()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def gadget(self, r: int, u: int, v: int, w: int, arcs: set[int]) -> None:
        """Merge number r, of u and v into w. Where no u leads to a state with an arc v, nothing is to be done."""
        if w in arcs:
            raise ValueError("two merges make one token")
        if u in arcs and v in arcs and self.arc(u, v, r):
            self.lost[u, v] = r
            self.made[w], self.copy_of[w], self.beside[w] = r, v, u
            arcs.add(w)

    def arc(self, t: int, x: int, at: int) -> bool:
        """Whether the state of t has the arc x at that time, before gadget number `at` takes any away."""
        return self.lost.get((t, x), NEVER) >= at and self.given(t, x)

    def given(self, t: int, x: int) -> bool:
        """Whether the state of t got the arc x, when the later of the two was made."""
        found = self.known.get((t, x))
        if found is None:
            a, b = self.made[t], self.made[x]
            if a == b == 0:
                found = True
            elif b > a:  # x came to states that had, and kept, the arc beside which it stands
                found = self.arc(t, self.beside[x], b + 1)
            elif a > b:  # the state of t is a copy
                found = self.arc(self.copy_of[t], x, a)
            else:
                found = self.arc(self.copy_of[t], self.beside[t], a)
            if len(self.known) > 4 * CACHE_ENTRIES:
                self.known.clear()
            self.known[t, x] = found
        return found

    def afresh(self) -> None:
        """A table with the first state alone: no token read, none begun. Rows have a column for each frequent byte; the last one stays empty."""
        self.subsets: list[tuple[int, ...]] = [(0,)]
        self.numbers: dict[tuple[int, ...], int] = {(0,): 0}
        self.last = array("i", [-1])
        self.table = array("i", [-1] * WIDTH)
        self.rare: dict[int, int] = {}

    def follow(self, subset: tuple[int, ...], byte: int) -> tuple[int, ...]:
        """The subset after a byte: each begun token takes it, and one of them, which may follow the token before it, ends.

        A member is a token's number plus one, and the place in the trie behind it, in the low NODE
        bits; the last member is the last token, with nothing begun behind it yet.
        """
        child, ends, inner, arcs, low = self.child, self.ends, self.inner, self.arcs, (1 << NODE) - 1
        ended, after = -1, []
        for member in subset:
            node = child.get((member & low) << 8 | byte)
            if node is not None:
                x = ends[node]
                if ended < 0 <= x:
                    key = member >> NODE << NODE | x
                    may = arcs.get(key)
                    if may is None:
                        if len(arcs) > 4 * CACHE_ENTRIES:
                            arcs.clear()
                        may = arcs[key] = member <= low or self.arc((member >> NODE) - 1, x, NEVER)
                    if may:
                        ended = x
                if inner[node]:
                    after.append(member >> NODE << NODE | node)
        if ended < 0:
            raise ValueError(f"the vocabulary cannot spell byte {byte}")
        after.append(ended + 1 << NODE)
        return tuple(after)

    def entry(self, row: int, byte: int) -> int:
        """The row that the byte leads to from a row whose column for it is empty; worked out when first met."""
        column = self.column[byte]
        to = self.rare.get(row << 8 | byte, -1) if column == WIDTH - 1 else -1
        if to < 0:
            subset = self.follow(self.subsets[row // WIDTH], byte)
            to = self.numbers.setdefault(subset, len(self.subsets) * WIDTH)
            if to == len(self.table):
                self.subsets.append(subset)
                self.last.append((subset[-1] >> NODE) - 1)
                self.table.extend([-1] * WIDTH)
            if column == WIDTH - 1:
                self.rare[row << 8 | byte] = to
            else:
                self.table[row + column] = to
        return to

    def path(self, data: bytes) -> list[int]:
        """The labels of the one path that spells the bytes: the token that ends at each byte, read off from the last."""
        if len(data) > LONG_WORD:  # its states are not kept
            subset, ends = self.subsets[0], []
            for byte in data:
                subset = self.follow(subset, byte)
                ends.append((subset[-1] >> NODE) - 1)
        else:
            if len(self.subsets) > TABLE_STATES:
                self.afresh()
            table, row, ends = self.table, 0, []
            for column in data.translate(self.column):
                to = table[row + column]
                if to < 0:
                    to = self.entry(row, data[len(ends)])
                ends.append(row := to)
        out, at, sizes, last = [], len(data), self.sizes, self.last
        while at:
            token = ends[at - 1] if len(data) > LONG_WORD else last[ends[at - 1] // WIDTH]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            path = self.path(word.encode())
            found = struct.pack(f"<{len(path)}I", *path)
            if len(word) <= 64:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                self.words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Of a blank and this piece, which reaches to the next blank."""
        found = b"".join(map(self._word, PLAIN_SPLIT.findall(" " + piece)))
        if len(piece) <= 64:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def _ordinary(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not RUN.search(text):
            known, find = self.pieces.get, self._piece
            head, *rest = text.split(" ")
            return b"".join([*map(self._word, PLAIN_SPLIT.findall(head)), *[known(p) or find(p) for p in rest]])
        return b"".join(map(self._word, SPLIT.findall(text)))

    def encode(self, text: str) -> bytes:
        """Token ids, as little-endian unsigned 32-bit integers; special tokens' strings in the text become those tokens."""
        if self.special_split and any(s in text for s in self.special):
            parts = self.special_split.split(text)
            return b"".join(struct.pack("<I", self.special[p]) if k % 2 else self._ordinary(p) for k, p in enumerate(parts))
        return self._ordinary(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(spec: str) -> MergeAutomaton:
    return MergeAutomaton(spec)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(df: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens (long), ids (binary: little-endian unsigned 32-bit integers) and decoded (string).

    keep: columns to carry along, all by default. Columns of the three new names, in any case, are replaced.
    A null text counts as empty: no tokens, empty ids, empty decoded. Rows are handled one by
    one, so repeated rows stay repeated and empty tables stay empty. The vocabulary file is read
    once, on the driver; its content (one file, 1.5 MB here) goes to the tasks.
    """
    prepare(df.sparkSession)
    with open(path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    new = ["n_tokens", "ids", "decoded"]
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(private(df) + "text"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        m = compiled(spec)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for t in batch.column(len(kept)):
                found = m.encode(t.as_py() or "")
                counts.append(len(found) // 4)
                ids.append(found)
                decoded.append(m.decode(found))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*kept, *new])

    return source.mapInArrow(run, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents, and digests of the ids and of the decoded text. Null texts count as empty; see encode_decode."""
    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def brute_force(text: str, path: str | None = None) -> tuple[int, str, str]:
    """The same row by the tokenizers library, for tests."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or default_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
