"""Token ids as flat binary files with 64-bit document offsets.

A part is three files of little-endian numbers: ``.bin`` the ids of its documents one after the
other (unsigned, 16 bits where the vocabulary allows it, else 32), ``.off`` the offset of each
document's first id and behind it the number of all ids (int64), ``.ids`` the documents' ids
(int64). Parts are ranges of ``doc_id``; a manifest table has a row for each, and a part's base in
the whole corpus is the prefix sum of the ids of the parts before it. Readers memory-map the files
where the folder is local or mounted and read ranges of them otherwise.

A task writes under a name of its own and reports it in its manifest row, so that of several
attempts only the one that Spark kept is ever read.

Defined cases: a null text counts as empty and has the end id only; repeated rows and ids are
documents of their own, in the order of id and text hash; a null id comes first and stays null;
an empty table has no parts. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shared_path
from .subword import encoder

NO_ID = -(2 ** 63)
WRITE_IDS = 1 << 18   # ids gathered for one write
MANIFEST = pa.schema([("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                      ("first_id", pa.int64())])
MANIFEST_DDL = "path string, width int, n_docs long, n_ids long, first_id long"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_numbers(path: str, dtype) -> np.ndarray:
    """A file of numbers: memory-mapped on a local file system, else read."""
    system, at = store(path)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(at) as f:
            return np.frombuffer(f.read_buffer(), dtype=dtype)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def write_part(batches, folder: str, tokenizer: str, end_id: int, width: int, whole_specials: bool):
    """Encode a task's documents into one part; yields its manifest row."""
    system, at = store(folder)
    name, dtype = uuid.uuid4().hex, np.dtype(f"<u{width}")
    enc = encoder(tokenizer)
    enc.tokenizer.encode_special_tokens = whole_specials
    end = np.array([end_id], np.uint32)
    out, offsets, ids, n = None, [0], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            out = system.open_output_stream(f"{at}/{name}.bin")
        held, size = [], 0
        for tokens in enc.encode(batch.column("text")):
            held += [tokens, end]
            size += len(tokens) + 1
            n += len(tokens) + 1
            offsets.append(n)
            if size >= WRITE_IDS:
                out.write(np.concatenate(held).astype(dtype).tobytes())
                held, size = [], 0
        if held:
            out.write(np.concatenate(held).astype(dtype).tobytes())
        ids += batch.column("doc_id").fill_null(NO_ID).to_pylist()
    if out is None:
        return
    out.close()
    for ending, values in (("off", offsets), ("ids", ids)):
        with system.open_output_stream(f"{at}/{name}.{ending}") as f:
            f.write(np.array(values, dtype="<i8").tobytes())
    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "width": width, "n_docs": len(ids), "n_ids": n,
                                       "first_id": ids[0]}], schema=MANIFEST)


def new_folder(spark, kind: str) -> str:
    folder = shared_path(spark, kind)
    system, at = store(folder)
    system.create_dir(at, recursive=True)
    return folder


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, in_order: bool = True,
                 whole_specials: bool = False) -> DataFrame:
    """Write (doc_id, text) and return the stored manifest. ``in_order``: parts are ascending
    ranges of doc_id; else a part has the documents of a scan task as they come."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if in_order:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    folder, width = new_folder(docs.sparkSession, "tokens"), 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4

    def write(batches):
        yield from write_part(batches, folder, tokenizer, end_id, width, whole_specials)

    return saved(rows.mapInArrow(write, MANIFEST_DDL), "manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest, one row a part, with ``base``: ids in the parts before."""
    before = Window.orderBy("first_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def documents_of(path: str, width: int):
    """(doc ids, offsets, ids) of a part."""
    return (open_numbers(f"{path}.ids", "<i8"), open_numbers(f"{path}.off", "<i8"),
            open_numbers(f"{path}.bin", f"<u{width}"))


def _read(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for part in batch.to_pylist():
            docs, offsets, ids = documents_of(part["path"], part["width"])
            crc = np.fromiter((zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:])),
                              np.int64, len(docs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, mask=docs == NO_ID), pa.array(part["base"] + offsets[:-1]), pa.array(np.diff(offsets)),
                 pa.array(crc)], schema=schema)


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    parts = with_bases(manifest)
    return parts.repartition("path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _names(batches):
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            docs = open_numbers(f"{path}.ids", "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(docs), pa.string()), pa.array(np.arange(len(docs))),
                                              pa.array(docs, mask=docs == NO_ID)], schema=schema)


def document_names(manifest: DataFrame) -> DataFrame:
    """(path, ordinal, doc_id) of the documents in the parts."""
    return manifest.select("path").repartition("path").mapInArrow(_names, "path string, ordinal long, doc_id long")
