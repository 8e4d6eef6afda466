"""Token-id files: Arrow IPC files of fixed-size-list batches.

Documents are dealt by ranges of (doc_id, hash of the text, place read), so that rows with one id, or none, fall into
several files too; sorted, encoded and streamed into one file per partition, as sequences of ``LENGTH`` ids with a mask
(false where the last sequence is padded). All batches of a file but the last have ``BATCH`` sequences (both numbers stand in the
file's schema), so sequence i is row i % BATCH of batch i // BATCH: one look-up in the file's footer and a slice of one buffer, without copying.
Beside each file stands an index of its documents. A task writes under a name of its own and only
the files of tasks that ended well enter the manifest, so tasks may be lost and run again. The manifest, a row a file, passes through the driver.

Edge cases: null and empty texts are the end id alone; null ids sort first; rows with
the same id stay separate documents, in order of a hash of their texts; a very long text goes over as many batches
as it needs; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table, text_blocks, text_hash
from .tokens import encoder

LENGTH, BATCH, END = 2048, 256, 0
VOCABULARY = "byte_bpe_50k.json"


def file_schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "batch": str(BATCH)})


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches of ``BATCH``."""

    def __init__(self, where: fs.FileSystem, path: str, length: int):
        self.length, self.rest, self.size, self.total = length, [], 0, 0
        self.out = where.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, file_schema(length))

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.size += len(ids) // 2
        self.total += len(ids) // 2
        if self.size >= self.length * BATCH:
            self._flush()

    def _flush(self) -> None:
        """Write the whole batches."""
        stream = np.frombuffer(b"".join(self.rest), np.uint16)
        step = self.length * BATCH
        whole = len(stream) // step * step
        for i in range(0, whole, step):
            self._write(stream[i : i + step], np.ones(step, bool))
        self.rest, self.size = [stream[whole:].tobytes()], len(stream) - whole

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=file_schema(self.length)))

    def close(self) -> None:
        if self.size:
            stream = np.frombuffer(b"".join(self.rest), np.uint16)
            ids = np.zeros(-(-len(stream) // self.length) * self.length, np.uint16)
            ids[: len(stream)] = stream
            self._write(ids, np.arange(len(ids)) < len(stream))
        self.file.close()
        self.out.close()


class SequenceReader:
    """Random access to the sequences of one file, mapped into memory where the store allows it."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        said = self.file.schema.metadata
        self.length, self.batch = int(said[b"length"]), int(said[b"batch"])

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.batch + self.file.get_batch(n - 1).num_rows if n else 0

    def batches(self):
        """(ids, mask) of each batch, flat; ids without a copy."""
        for i in range(self.file.num_record_batches):
            b = self.file.get_batch(i)
            yield b.column(0).flatten().to_numpy(), b.column(1).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (without a copy) and the mask of sequence ``i``."""
        b = self.file.get_batch(i // self.batch)
        ids, mask = (c[i % self.batch].values for c in b.columns)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def write_files(docs: DataFrame, folder: str, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Write the files; returns the manifest (file, index, first, last, n_docs, n_tokens, base), one row a file, in order of doc_id."""
    d = docs.select("doc_id", "text", text_hash().alias("h"), F.monotonically_increasing_id().alias("place"))
    kind = d.schema["doc_id"].dataType

    def write(it):
        writer, ids, sizes, name = None, [], [], f"{folder}/{uuid.uuid4().hex}"
        for batch in it:
            where, path = fs.FileSystem.from_uri(name)
            if writer is None and batch.num_rows:
                where.create_dir(path.rpartition("/")[0], recursive=True)
                writer = SequenceWriter(where, path + ".arrow", length)
            for _, texts in text_blocks(batch):
                for x in encoder(vocabulary, True).encode(texts):
                    writer.add(x + END.to_bytes(2, "little"))
                    sizes.append(len(x) // 2 + 1)
            ids.append(batch.column(0))
        if writer:
            writer.close()
            ids = pa.chunked_array(ids).combine_chunks()
            index = pa.table({"doc_id": ids, "n_tokens": pa.array(sizes, pa.int64())})
            with where.open_output_stream(path + ".index") as out, pa.ipc.new_file(out, index.schema) as f:
                f.write_table(index)
            yield pa.RecordBatch.from_arrays([pa.array([name + ".arrow"]), pa.array([name + ".index"]), ids.slice(0, 1), ids.slice(len(ids) - 1, 1), pa.array([len(ids)]), pa.array([writer.total])],
                                             names=["file", "index", "first", "last", "n_docs", "n_tokens"])

    dealt = d.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    made = dealt.mapInArrow(write, f"file string, index string, first {kind.simpleString()}, last {kind.simpleString()}, n_docs long, n_tokens long").collect()
    order = lambda x: (x is not None, x)
    made.sort(key=lambda r: (order(r["first"]), order(r["last"])))  # files that one id fills stand between those it ends and begins
    schema = f"file string, index string, first {kind.simpleString()}, last {kind.simpleString()}, n_docs long, n_tokens long, base long"
    rows, base = [], 0
    for r in made:
        rows.append((*r, base))
        base += r["n_tokens"]
    return docs.sparkSession.createDataFrame(rows, schema)


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    kind = manifest.schema["first"].dataType.simpleString()

    def read(it):
        for m in it:
            for uri, at, base in zip(m.column(0).to_pylist(), m.column(1).to_pylist(), m.column(2).to_pylist(), strict=True):
                where, path = fs.FileSystem.from_uri(at)
                with where.open_input_file(path) as f:
                    index = pa.ipc.open_file(f).read_all()
                sizes = index.column("n_tokens").to_numpy()
                parts, have, crcs = [], 0, []
                stream = SequenceReader(uri).batches()
                for n in sizes:
                    crc, need = 0, int(n)
                    while need:
                        if not have:
                            parts, mask = next(stream)
                            have = len(parts)
                        take = min(need, have)
                        at0 = len(parts) - have
                        crc = zlib.crc32(parts[at0 : at0 + take].astype("<u4").tobytes(), crc)
                        need, have = need - take, have - take
                    crcs.append(crc)
                start = base + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(start), pa.array(sizes), pa.array(crcs, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("file", "index", "base").repartition(n).mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_files(write_files(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"), public_tokenizers.path(VOCABULARY)))


NAME, ORACLE = "op5_token_files", None
