"""Token ids in ORC files.

Documents are range-partitioned by doc_id, sorted inside partitions, encoded with a public tokenizer and written
as ORC: integer run-length encoding for the ids, stripes with row indexes, Bloom filters on doc_id. Each row also
carries its shard (file), its slot in it and the ids before it in the file, so that readers take stripes in
parallel and any document's global start is one small offset away; files follow one another in ascending doc_id.

Texts are cut at plain blanks before encoding, which this tokenizer drops and never encodes across, and each
distinct word is encoded by the library once for as long as it stays in a bounded table.

Defined results: a null text is empty (its one id is the end id); null doc_ids come first; rows of one doc_id are all
written, in the order of their texts, and equal rows one after another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.llm.bpe import byte_letters
from sessionlens.llm.common import in_slices, shared_dir, table

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Distinct words kept with their ids in a Python worker; the table is emptied when full.
CACHE = 300_000
#: Characters of a text that tell rows of one doc_id apart when they are dealt out.
HEAD = 32
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "compression": "lz4",
}


#: Words of Latin letters and closing marks. The tokenizer lower-cases them letter by letter, no two of these
#: characters compose, and its pattern cuts them into the letters and the marks.
_MARKS = ".,!?;:$%&*#|"
_SIMPLE = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{_MARKS}]*)")


class WordEncoder(dict):
    """The tokenizers library over distinct words; equal to it over whole texts, as blanks are cut points.

    Maps a word to its ids (little-endian 32-bit integers). A word of Latin letters goes to the file's model
    piece by piece, any other word through the library's whole chain.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token, from the model: its bytes in the byte-level alphabet."""
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = self.pieces[piece] = array("i", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        pieces = self.pieces
        if len(word) > 64:
            return self._whole(word)
        if word.isascii() and (body := word.rstrip(_MARKS)).isalpha():
            letters, marks = body.lower(), word[len(body) :]
        elif m := _SIMPLE.fullmatch(word):
            letters, marks = m[1].lower(), m[2]
        else:
            ids = self[word] = self._whole(word) if word else b""
            return ids
        ids = pieces.get(letters) or self._piece(letters)
        if marks:
            ids += pieces.get(marks) or self._piece(marks)
        self[word] = ids
        return ids

    def _whole(self, word: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if len(self) > CACHE:
            self.clear()
        if len(self.pieces) > CACHE:
            self.pieces = {}
        cut = (t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts)
        return [b"".join(map(self.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_ids(docs: DataFrame, out: str, path: str | None = None, end: int = END, options: dict[str, str] | None = None) -> None:
    """Encode doc_id and text of docs and write the ids (with `end` after each document) as ORC into `out`."""
    path = path or vocabulary_path()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows of one doc_id are ranged on by how their texts begin, which is the order of the texts too
    rows = rows.withColumn("head", F.substring("text", 1, HEAD))
    rows = rows.repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "head", "text").select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, shard int, slot bigint, before bigint, n_tokens bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, slot, before, enc = TaskContext.get().partitionId(), 0, 0, encoder(path)
        last = end.to_bytes(4, "little")
        for part in in_slices(batches):
            ids = [x + last for x in enc.encode(part.column("text").to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            )
            n = len(ids)
            cols = [
                part.column("doc_id"),
                pa.array(np.full(n, shard, dtype=np.int32)),
                pa.array(np.arange(slot, slot + n, dtype=np.int64)),
                pa.array(before + ends - sizes),
                pa.array(sizes),
                lists,
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "slot", "before", "n_tokens", "ids"])
            slot, before = slot + n, before + int(ends[-1])

    rows.mapInArrow(run, schema).write.options(**(options or ORC_OPTIONS)).orc(out)


def offsets(files: DataFrame) -> DataFrame:
    """(shard, offset): ids before each file. Reads two integer columns; one row for each file."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    over = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("offset"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every document in the files."""
    files = spark.read.orc(path)
    return files.join(offsets(files), "shard").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), from the files.

    Stripes are digested where they are read; only the digests meet the files' offsets.
    """
    files = spark.read.orc(path)
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, shard int, before bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cols = [b.column("doc_id"), b.column("shard"), b.column("before"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "before", "n_tokens", "ids_crc32"])

    read = files.select("doc_id", "shard", "before", "ids").mapInArrow(run, schema)
    out = read.join(offsets(files), "shard")
    return out.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = os.path.join(shared_dir(spark), f"token-ids-{uuid.uuid4().hex}")
    write_ids(table(spark, sf_dir, "documents"), out)
    return digests(spark, out)
