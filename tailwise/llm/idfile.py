"""Token-id files: documents in ascending id order, their ids coded in independent checksummed blocks.

A file set is a folder of Parquet parts that Spark's committer writes, so lost executors leave no half files and
any store that Spark knows will do. A row is a segment of whole documents: part (place of the partition in
doc_id order), part_start (ids before it in its part), doc_ids and counts (its directory), and blocks, the coded
segment of idcoder: its table and its blocks one after the other. Readers need only the totals of the parts to know every start.

Defined cases: a null or empty text has the end id alone; rows with equal doc_id are kept, ordered by text; a
null doc_id comes first and stays null; an empty table gives an empty file set and an empty result; further
columns are ignored; a damaged block raises ValueError.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwise.llm import idcoder
from tailwise.llm.common import id_text, shared_dir
from tailwise.llm.tokens import library_encoder

#: Ids of a segment, about; its blocks are coded side by side.
SEGMENT = 8_000_000
SCHEMA = "part int, part_start long, n_ids long, doc_ids array<bigint>, counts array<bigint>, blocks binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Encode the texts with the tokenizers library, append end_id to each, and write them in doc_id order."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(tokenizer), np.array([end_id], np.uint32)
        part, start, n = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int] = []

        def flush() -> pa.RecordBatch:
            blocks = idcoder.encode_segment(np.concatenate([x for own in ids for x in (own, end)]))
            row = (part, start, n, doc_ids, [len(x) + 1 for x in ids], blocks)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            texts, own = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for at in range(0, len(texts), 500):
                for doc_id, x in zip(own[at : at + 500], encoder.ids(texts[at : at + 500]), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(x)
                    n += len(x) + 1
                    if n >= segment:
                        yield flush()
                        start, n, ids, doc_ids = start + n, 0, [], []
        if doc_ids:
            yield flush()

    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files; with_ids adds ids (binary)."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    base, total = {}, 0
    for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row per part
        base[r["part"]] = total
        total += r["n"]
    sent = spark.sparkContext.broadcast(base)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, _, doc_ids, counts, blocks = (c[k].as_py() for c in batch.columns)
                ids = idcoder.decode_segment(blocks).tobytes()
                ends = np.cumsum(counts)
                begins = ends - counts
                own = [ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(begins + start + sent.value[part]), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(own, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(spark, path)
