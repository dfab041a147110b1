"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece the exact encoding has one last token. A matching automaton gives the tokens that
are suffixes of the prefix; the last token is the one that may stand after the last token of what is before it.
Two tokens may stand side by side when no pair of parts along their touching edges would have merged while both
parts existed. Back-pointers from the end then give the ids. Pieces are split by the public pattern of the file's
pre-tokenizer, and each distinct piece is encoded once as long as it stays in a bounded table.

Defined results: a null text is empty: no ids, empty decoded text. An empty table gives an empty result; repeated
rows are encoded one by one; other columns are ignored; a null doc_id is kept; a text of any length takes linear
time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import in_slices, table

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces kept with their ids in a Python worker; two halves, the older one is dropped when full.
CACHE = 240_000
PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b]))
        # a token that the merges never reach from its own bytes is never a result
        whole = {i for i in sorted(vocab.values(), key=lambda i: len(self.bytes[i])) if self._reached(i)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.match = ahocorasick.Automaton()
        for i in whole:
            self.match.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.match.make_automaton()
        self.whole = {self.bytes[i].decode("latin-1"): i for i in whole}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def _edge(self, i: int, side: int) -> Iterator[tuple[int, int]]:
        """The parts that token i has had at its left (0) or right (1) edge: (part, rank of the merge that ended it)."""
        until = len(self.rank)
        while True:
            yield i, until
            pair = self.parts.get(i)
            if pair is None:
                return
            until, i = self.rank[pair], pair[side]

    def _reached(self, i: int) -> bool:
        if i not in self.parts:
            return len(self.bytes[i]) == 1
        a, b = self.parts[i]
        end = self.rank[a, b]
        return not self._joins(a, b, end)

    def _joins(self, a: int, b: int, end: int) -> bool:
        """Would some part at the right edge of a have merged with one at the left edge of b before rank `end`?

        Merges go by rank and, within a rank, from left to right: at a's side a part is gone once its own merge
        of the same rank is due, at b's side it is still there.
        """
        left = list(self._edge(b, 0))
        for x, x_end in self._edge(a, 1):
            for y, y_end in left:
                r = self.rank.get((x, y))
                if r is not None and r < end and r < x_end and r <= y_end:
                    return True
        return False

    def _may_follow(self, a: int, b: int) -> bool:
        key = a * len(self.bytes) + b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = not self._joins(a, b, len(self.rank))
        return known

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian 32-bit integers."""
        data = piece.encode().decode("latin-1")
        if (i := self.whole.get(data)) is not None:
            return i.to_bytes(4, "little")
        n = len(data)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        may = self._may_follow
        for end, (i, size) in self.match.iter(data):
            end += 1
            if last[end] < 0:
                start = end - size
                if not start or may(last[start], i):
                    last[end], back[end] = i, start
        out, at = [], n
        while at:
            out.append(last[at].to_bytes(4, "little"))
            at = back[at]
        return b"".join(reversed(out))

    def _plain(self, text: str, out: list[bytes]) -> None:
        new, old = self.new, self.old
        for piece in self.pattern.findall(text):
            ids = new.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = self._piece(piece)
                if len(piece) <= 64:
                    if len(new) >= CACHE // 2:
                        self.old = old = new
                        self.new = new = {}
                    new[piece] = ids
            out.append(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text become their ids."""
        out: list[bytes] = []
        at = 0
        if self.cut is not None:
            for m in self.cut.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.special[m[0]].to_bytes(4, "little"))
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        import numpy as np

        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids (array<int>) of each row's whole text."""
    path = path or vocabulary_path()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path)
        for b in in_slices(batches):
            ids = [np.frombuffer(enc.encode(t), "<i4") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: encode each whole text, decode its ids, digest both."""
    path = path or vocabulary_path()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in in_slices(batches):
            n, one, two = [], [], []
            for t in b.column("text"):
                ids = enc.encode(t.as_py())
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            cols = [b.column("k"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: doc_id, n_tokens and the digests of ids and decoded text of every document."""
    return digests(docs)
