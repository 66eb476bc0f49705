"""Token-id store in ORC: run-length encoded ids, row indexes, Bloom filters on document ids.

A store is a folder of ORC files. Files hold consecutive ranges of ascending doc_id, and rows
within a file ascend too, so min/max statistics of stripes and row groups prune reads by
doc_id; a Bloom filter on doc_id prunes lookups of single ids. ``ids`` is an integer list,
which ORC stores by its integer run-length encoding; stripes are the unit that readers split
at. Each row also has its part number and its start within the part, so that a document's
place among all ids needs only the totals of the parts.

Scale. Texts are dealt into ranges of about RANGE_ROWS documents by doc_id, whatever the session's number of shuffle partitions, and equal or null ids by the MD5 of their texts, before they are encoded
(the sampling for the ranges runs no encoder), each task encodes and writes its range, and
nothing is sorted after. A file has a stripe for about every STRIPE_BYTES of ids, and a stripe a row group for
every ROW_GROUP documents, which the row index and the Bloom filters tell apart. Part totals, one row per file, are the only thing summed up globally.

Defined results. A null text counts as empty; every document has at least the end id. Null
doc_ids come first. Equal doc_ids are ordered by the MD5 of their texts. Repeated rows are stored as often as
they occur. An empty table gives a store without rows. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from termforge.config import ship_package
from termforge.llm.common import BROADCAST_ROWS, fresh_path, materialize, resident

END_ID = 2
#: ORC allows no row groups of fewer than 1,000 rows.
STRIPE_BYTES = 4 << 20
#: Documents of a range, and so of a file and of the task that sorts and encodes it.
RANGE_ROWS = 16_384
ROW_GROUP = 1_000
MEMO_WORDS, MEMO_CHARS, PARTED = 1_400_000, 64, 512
PART = "^"
#: Full stop or comma after a letter (Latin, but for the capital I with a dot, which lower-cases to two) and before a space.
_STOP = re.compile(r"[.,](?=[ \n]|\Z)(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f].)")
STORE = "doc_id long, part int, start long, ids array<int>"


def _is_latin(text: str) -> bool:
    """Whether the text is Latin-1, whose letters lower-case one by one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Ids of a text, as little-endian 32-bit integers, by a tokenizer that never joins across white space.

    Each distinct word is encoded once and kept as bytes, so a text is the concatenation of
    its words' bytes. New words are encoded together, parted by a character that is a word and
    a token of its own. Full stops and commas at the end of Latin words are set apart, and
    Latin-1 texts lower-cased, before words are told apart: this tokenizer does both itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        (self.part_id,) = self.tokenizer.encode(PART, add_special_tokens=False).ids
        self.memo: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word by itself."""
        out: list[bytes] = []
        for at in range(0, len(words), PARTED):
            some = words[at : at + PARTED]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {PART} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.part_id)
            if len(ends) != len(some) - 1:  # a word holds the parting character itself
                each = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
                out += [np.array(e.ids, "<u4").tobytes() for e in each]
                continue
            data, starts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
            stops = [*(4 * ends).tolist(), len(data)]
            out += [data[a:b] for a, b in zip(starts, stops)]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        memo = self.memo
        split = []
        for t in texts:
            t = _STOP.sub(r" \g<0>", t or "").replace("\n", " ")
            split.append((t.lower() if _is_latin(t) and "<|" not in t else t).split(" "))
        fresh = list(set(chain.from_iterable(split)).difference(memo))
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
            fresh = list(set(chain.from_iterable(split)))
        memo.update(zip(fresh, self.encode_words(fresh)))
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


def _encoder(path: str) -> WordEncoder:
    return resident(("orcstore", path), lambda: WordEncoder(path))


def _runs(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc_id)
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_store(docs: DataFrame, store: str, tokenizer: str, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, row_group: int = ROW_GROUP) -> None:
    """Encode docs (doc_id, text) and write the store folder. tokenizer: a file present on every executor."""
    ship_package(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_ids, texts in _runs(batch):
                coded = [ids + end for ids in coder.encode(texts)]
                sizes = np.array([len(x) // 4 for x in coded], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "start", "ids"],
                )
                start += int(offsets[-1])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.md5(F.coalesce("text", F.lit("")))
    n_ranges = max(1, -(-docs.count() // RANGE_ROWS))  # a Parquet table's count is read from its footers
    ranged = picked.withColumn("tie", tie).repartitionByRange(n_ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    (
        ranged.mapInArrow(encode, STORE)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_group)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.rows.between.memory.checks", row_group)
        .option("orc.encoding.strategy", "SPEED")
        .option("compression", "lz4")
        .orc(store)
    )


def read_store(spark: SparkSession, store: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of a store; doc_ids are looked up by pushed-down filters, which skip stripes and row groups."""
    rows = spark.read.schema(STORE).orc(store)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_table(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy(), dtype="<u4").view(np.uint8)
            view = memoryview(flat)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
            )

    rows = read_store(spark, store).mapInArrow(digest, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    rows = materialize(rows, "orc-digests")
    totals = materialize(rows.groupBy("part").agg(F.sum("n_tokens").alias("__total")), "orc-parts")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("part").alias("__part"), F.coalesce(F.sum("__total").over(order), F.lit(0)).alias("__before"))
    if totals.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    placed = rows.join(before, rows["part"] == before["__part"])
    return placed.select("doc_id", (F.col("__before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, store: str | None = None) -> DataFrame:
    """Write docs to a store (by default in the shared folder) and return token_table of it."""
    spark = docs.sparkSession
    store = store or fresh_path(spark, "token-ids.orc")
    write_store(docs, store, tokenizer)
    return token_table(spark, store)
