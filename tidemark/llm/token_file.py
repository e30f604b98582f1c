"""Token ids as Parquet lists: delta and dictionary encodings, controlled row
groups and pages, selective reads.

``write_tokens`` sorts documents by id over range partitions, encodes them and
writes one file per range. A file's columns:

* ``doc_id`` long, ``local_start`` long, ``n_tokens`` int, ``shard`` int -
  metadata, DELTA_BINARY_PACKED (version-2 pages, dictionary off);
* ``ids`` list<int> - dictionary encoded while the dictionary page fits, then
  DELTA_BINARY_PACKED by the writer's own fall-back.

Row groups and pages have fixed byte sizes, and the page index is written, so
a reader that filters on ``doc_id`` or selects only the metadata columns skips
the token pages. ``start`` (ids of all documents before one) is the running
sum inside a file plus the total of the files before it; only one total per
file reaches the driver, never a row per document.

Encoding speed: the vocabulary's own normaliser and splitter never join text
across ASCII white space, so a text is encoded word by word and repeated words
come from a bounded cache. A miss over plain Latin letters, digits and ASCII
signs is cut by the documented split rule and given to the library's BPE
model; any other word, and any that holds an added token's text, goes through
the library's whole pipeline with its defaults.

Defined cases: null text is empty and gives only the end id; ties of one id
are ordered by text; null ids come first; extra columns are ignored; an empty
table writes no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, new_path, raw_texts, slices, table

END_ID = 1
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10

#: The vocabulary file's split rule, for texts of plain characters only.
PLAIN = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ!-/:-@\\[-`{-~]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte -> printable letter, as byte-level vocabularies write them:
    printable Latin-1 stands for itself, the rest follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + k) for k, b in enumerate(other)}


class WordEncoder:
    """Bytes of a white-space-free word -> packed little-endian uint32 ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.letters = _byte_letters()
        self.pieces = Memo(self._piece, 300_000)
        self.words = Memo(self._word, 800_000)

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself
        coded = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(coded)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        out = b"".join(map(self.words.__getitem__, text.split()))
        self.words.trim()
        self.pieces.trim()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


FILE_SCHEMA = "shard int, doc_id long, local_start long, n_tokens int, ids array<int>"


def _encode(vocabulary: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(frames):
        from pyspark import TaskContext

        coder, shard, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in slices(frames):
            packed = [coder.encode(t) + end for t in raw_texts(b.column(1))]
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(packed), shard, np.int32)), b.column(0), pa.array(at + ends - sizes), pa.array(sizes.astype(np.int32)), ids],
                ["shard", "doc_id", "local_start", "n_tokens", "ids"],
            )
            at += int(sizes.sum())

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them in ascending id order under ``path``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(_encode(vocabulary or default_vocabulary(), end_id), FILE_SCHEMA)
    (
        coded.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.columnindex.truncate.length", "64")
        .parquet(path)
    )


def read_metadata(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, shard, local_start: token pages are not read."""
    meta = spark.read.schema(FILE_SCHEMA).parquet(path).select("shard", "doc_id", "local_start", "n_tokens")
    return meta.join(F.broadcast(_offsets(spark, path)), "shard").withColumn("start", F.col("offset") + F.col("local_start")).drop("offset")


def read_tokens(spark, path: str) -> DataFrame:
    """The whole rows, with ``start``."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return rows.join(F.broadcast(_offsets(spark, path)), "shard").withColumn("start", F.col("offset") + F.col("local_start")).drop("offset")


def _offsets(spark, path: str) -> DataFrame:
    """Ids before each shard: one row per file, so bounded by the number of
    range partitions of the writer."""
    meta = spark.read.schema(FILE_SCHEMA).parquet(path)
    ends = meta.groupBy("shard").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total")).collect()
    before, out = 0, []
    for r in sorted(ends, key=lambda r: r["shard"]):
        out.append((r["shard"], before))
        before += r["total"]
    return spark.createDataFrame(out, "shard int, offset long")


def _digest(frames):
    for b in slices(frames):
        ids = b.column(3)
        offsets = ids.offsets.to_numpy()
        data = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8)
        crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_file(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    rows = read_tokens(spark, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    return rows.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
