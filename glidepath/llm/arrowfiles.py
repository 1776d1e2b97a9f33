"""Token sequences in Arrow files: fixed-size lists of ids and masks that a reader can address without decoding."""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glidepath.llm.common import partitions, text_groups
from glidepath.llm.wordtokens import word_tokens
from glidepath.session import fresh_path

#: Rows of one record batch; all batches of a file but the last have as many, so row r is at batch r // BATCH, row r % BATCH.
BATCH = 512
MANIFEST = "part int, path string, tokens long, documents long, sequences long"


def file_schema(length: int, id_type: pa.DataType) -> pa.Schema:
    """ids: the sequence; valid: false on padding; last: true on the last token of a document; doc_ids: documents that end here."""
    return pa.schema([("ids", pa.list_(id_type, length)), ("valid", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length)),
                      ("doc_ids", pa.list_(pa.int64()))])


def filesystem(uri: str):
    """File system and path of a location; plain paths are local or a shared mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Writes documents one after the other into rows of `length` ids; holds one batch in memory."""

    def __init__(self, sink, length: int, id_type: pa.DataType):
        self.length, self.id_type, self.schema = length, id_type, file_schema(length, id_type)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.ends: list[tuple[int, int | None]] = []
        self.held = self.tokens = self.documents = self.sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.ends.append((self.held - 1, doc_id))
        self.tokens += len(ids)
        self.documents += 1
        if self.held >= BATCH * self.length:
            self._write(self.held // (BATCH * self.length) * BATCH)

    def _write(self, rows: int) -> None:
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        if len(flat) and flat.max() >> self.id_type.bit_width:
            raise ValueError("an id needs more bits: set wide")
        n = rows * self.length
        here, rest = flat[:n], flat[n:]
        ids = np.zeros(n, self.id_type.to_pandas_dtype())
        ids[: len(here)] = here
        valid, last = np.zeros(n, bool), np.zeros(n, bool)
        valid[: len(here)] = True
        done = [e for e in self.ends if e[0] < n]
        last[[at for at, _ in done]] = True
        begins = np.searchsorted(np.array([at for at, _ in done], dtype=np.int64), np.arange(rows + 1) * self.length)
        docs = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array([d for _, d in done], pa.int64()))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in (ids, valid, last)]
        for at in range(0, rows, BATCH):
            batch = pa.RecordBatch.from_arrays([c.slice(at, BATCH) for c in (*columns, docs)], schema=self.schema)
            self.file.write_batch(batch)
        self.sequences += rows
        self.ids, self.held = ([rest] if len(rest) else []), len(rest)
        self.ends = [(at - n, d) for at, d in self.ends[len(done):]]

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.length))
        self.file.close()


def read_documents(source, length: int):
    """(doc_id, ids) of each document of a file, batch by batch; the ids are views of the file's buffers where a batch holds them whole."""
    held: list[np.ndarray] = []
    reader = pa.ipc.open_file(source)
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        ends = np.flatnonzero(batch.column(2).flatten().to_numpy(zero_copy_only=False))
        docs = batch.column(3).flatten().to_pylist()
        at = 0
        for end, doc in zip(ends.tolist(), docs):
            held.append(ids[at : end + 1])
            yield doc, held[0] if len(held) == 1 else np.concatenate(held)
            held, at = [], end + 1
        valid = int(np.count_nonzero(batch.column(1).flatten().to_numpy(zero_copy_only=False)))
        if at < valid:
            held.append(ids[at:valid].copy())


def sequence(source, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence, straight from the mapped file: no other row is read."""
    batch = pa.ipc.open_file(source).get_batch(row // BATCH)
    ids, valid = (batch.column(i) for i in (0, 1))
    length, at = ids.type.list_size, row % BATCH
    mask = valid.flatten().slice(at * length, length).to_numpy(zero_copy_only=False)
    return ids.flatten().slice(at * length, length).to_numpy(zero_copy_only=True), mask


def write_sequences(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, length: int = 2048, wide: bool = False) -> DataFrame:
    """Writes the tokens of `docs` (doc_id, text) to Arrow files under `path`, in ascending doc_id order over all files.

    Documents are range-partitioned by doc_id and sorted inside each partition; every task writes one file as it goes, under a name of
    its own attempt, and renames it when whole, so a lost or doubled task leaves no half file in the manifest. No document spans files.
    Returns the manifest: part (order of files), path, tokens, documents, sequences. It is computed once and written beside the files.

    Ids are 16 bits wide unless `wide` is set. Null texts count as empty (the end id alone); null ids come first; rows with one id are
    ordered by text. An empty table gives no files.
    """
    spark = docs.sparkSession
    id_type = pa.uint32() if wide else pa.uint16()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        part, writer, sink = TaskContext.get().partitionId(), None, None
        fs, folder = filesystem(path)
        draft = posixpath.join(folder, f".draft-{uuid.uuid4().hex}")
        final = f"tokens-{part:06d}-{uuid.uuid4().hex[:8]}.arrow"
        for group, texts in text_groups(batches):
            if writer is None:
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(draft)
                writer = SequenceWriter(sink, length, id_type)
            for doc, ids in zip(group.column("doc_id").to_pylist(), word_tokens(tokenizer).encode(texts)):
                writer.add(doc, np.frombuffer(ids + tail, "<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(draft, posixpath.join(folder, final))
            done = {"part": [part], "path": [final], "tokens": [writer.tokens], "documents": [writer.documents], "sequences": [writer.sequences]}
            yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()),
                                                                     ("documents", pa.int64()), ("sequences", pa.int64())]))

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def documents_of(manifest: DataFrame, path: str, length: int = 2048) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start (tokens before it), n_tokens, ids_crc32 of each document."""
    # One row per file; their number is the number of partitions that wrote them.
    begin = (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("begin")
    files = manifest.select("part", "path", begin)
    files = files.repartition(partitions(manifest.sparkSession), "part")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for name, at in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist()):
                fs, folder = filesystem(path)
                full, rows = posixpath.join(folder, name), []
                local = os.path.exists(full)
                with pa.memory_map(full) if local else fs.open_input_file(full) as source:
                    for doc, ids in read_documents(source, length):
                        rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Writes `docs` to a new folder under the shared folder and reads the documents back from the files."""
    path = fresh_path(docs.sparkSession, "llm-tokens")
    return documents_of(write_sequences(docs, tokenizer, path, end_id, length), path, length)
