"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A part file is a 16-byte header (magic, version, bytes per id) and one record per document:
``length`` (u64), masked CRC-32 of those eight bytes (u32), payload, masked CRC-32 of the payload
(u32). The payload is a flag for a null document id (u8), the id (i64) and the token ids. The index
file holds for each record its offset in the part file and its number of ids (u64 each), so a
record is read without the ones before it. All numbers are little-endian. Parts and the records
in them ascend by document id; a record's place in the whole is its part's start plus what
precedes it there.

A task writes under a name of its own attempt, and only parts of tasks that succeeded are listed:
a repeated task leaves an unlisted file at most. Files go through the file system of the folder's
URI, so the folder may be in any store that pyarrow opens.

A null text is empty: its record holds the end id alone. Null document ids come first. Repeated
ids keep one record per row, in an order that follows from their texts. An empty table makes no part.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsnap.llm.common import keep, parts, remembered, shuffle_width, work_folder

MAGIC, VERSION = b"TOKREC\x00\x00", 1
HEADER, LENGTH, CRC, DOC = "<8sII", "<Q", "<I", "<Bq"
HEADER_SIZE, LENGTH_SIZE, CRC_SIZE, DOC_SIZE = map(struct.calcsize, (HEADER, LENGTH, CRC, DOC))
INDEX = np.dtype([("offset", "<u8"), ("n_ids", "<u8")])
CACHED_WORDS = 700_000
#: A small Latin-1 letter and the punctuation after it, but for what special tokens are made of.
BORDER = re.compile(r"([a-zß-öø-ÿ])([!-&(-/:;=?@\[-`{}~])")
TOKENIZER, END_ID = "word_bpe_49k.json", 2

PARTS = "part int, path string, index string, n_docs long, n_ids long, n_bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    """A checksum of data that holds checksums is weak; rotating and adding avoids that."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


class Words(dict):
    """Ids of words, encoded when first asked for; a full memory is emptied."""

    def __init__(self, model, kind: str) -> None:
        self.encode, self.kind = model.encode, kind

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = np.array(self.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        self[word] = ids
        return ids


def encoder(tokenizer: str, end_id: int) -> tuple[Callable[[str], bytes], int]:
    """A function from a text to its ids as bytes, end id included, and the bytes per id.

    The tokenizer drops white space and treats it as a border, so the words between spaces are
    encoded one by one and remembered. It lowers case and always parts a letter from the
    punctuation after it; in Latin-1 texts without special tokens both are done beforehand, which
    leaves fewer words to know. Words stay known from one task of a worker to the next.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
    kind = "<u2" if max(model.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], kind).tobytes()
    words = Words(model, kind)
    simple = os.path.basename(tokenizer) == TOKENIZER

    def latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text

    def encode(text: str) -> bytes:
        if not simple:
            return np.array(model.encode(text, add_special_tokens=False).ids, kind).tobytes() + end
        if latin(text):
            text = BORDER.sub(r"\1 \2", text.lower())
        return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" "))) + end

    return encode, int(kind[-1])


def write_records(
    docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID
) -> DataFrame:
    """Writes the part files; one row per part. The rows are written too, so it runs once."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, width = remembered("encoder", (tokenizer, end_id), lambda: encoder(tokenizer, end_id))
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name = f"{top}/part-{part:06d}-{uuid.uuid4().hex}"
        out, n_ids, index, at = None, 0, [], HEADER_SIZE
        for batch in parts(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if out is None:
                    out = store.open_output_stream(f"{name}.rec")
                    out.write(struct.pack(HEADER, MAGIC, VERSION, width))
                ids = encode(text.as_py() or "")
                payload = struct.pack(DOC, doc_id is None, doc_id or 0) + ids
                length = struct.pack(LENGTH, len(payload))
                out.write(
                    length + struct.pack(CRC, masked(zlib.crc32(length))) + payload + struct.pack(CRC, masked(zlib.crc32(payload)))
                )
                index.append((at, len(ids) // width))
                n_ids += len(ids) // width
                at += LENGTH_SIZE + 2 * CRC_SIZE + len(payload)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{name}.idx") as side:
                side.write(np.array(index, INDEX).tobytes())
            row = [part, f"{name}.rec", f"{name}.idx", len(index), n_ids, at]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("part", "path", "index", "n_docs", "n_ids", "n_bytes"), row, strict=True))],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("index", pa.string()),
                           ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "tie")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    written = keep(ordered.select("doc_id", "text").mapInArrow(write, PARTS), "record-parts")
    # One row per part; its start is the number of ids in the parts before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def frames(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of an open part file, every length and checksum checked."""
    magic, version, width = struct.unpack(HEADER, stream.read(HEADER_SIZE))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a record file of this version")
    while head := stream.read(LENGTH_SIZE):
        yield _frame(stream, head, width)


def _frame(stream, head: bytes, width: int) -> tuple[int | None, np.ndarray]:
    def checked(data: bytes, size: int) -> bytes:
        if len(data) != size or struct.unpack(CRC, stream.read(CRC_SIZE))[0] != masked(zlib.crc32(data)):
            raise ValueError("damaged record")
        return data

    size = struct.unpack(LENGTH, checked(head, LENGTH_SIZE))[0]
    payload = checked(stream.read(size), size)
    absent, doc_id = struct.unpack_from(DOC, payload)
    return None if absent else doc_id, np.frombuffer(payload, f"<u{width}", offset=DOC_SIZE)


def read_at(store: fs.FileSystem, path: str, index: str, places: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records at the given places of a part, in the given order, by its index alone."""
    with store.open_input_stream(index) as side:
        offsets = np.frombuffer(side.read(), INDEX)["offset"]
    with store.open_input_file(path) as stream:
        width = struct.unpack(HEADER, stream.read(HEADER_SIZE))[2]
        for place in places:
            stream.seek(int(offsets[place]))
            yield _frame(stream, stream.read(LENGTH_SIZE), width)


def read_records(parts: DataFrame, folder: str, chunk: int = 2_000) -> DataFrame:
    """Reads the part files back: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        schema = pa.schema([(n, pa.int64()) for n in names])
        for batch in batches:
            for part in batch.to_pylist():
                rows, start = [], part["start"]
                with store.open_input_stream(part["path"]) as stream:
                    for doc_id, ids in frames(stream):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == chunk:
                            yield _columns(rows, schema)
                            rows = []
                if rows:
                    yield _columns(rows, schema)

    n = max(1, parts.count())
    spread = parts.repartitionById(n, F.pmod("part", F.lit(n)).cast("int"))
    return spread.select("path", "start").mapInArrow(read, RECORDS)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def token_records(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes the records of all documents to the shared folder and reads them back."""
    folder = work_folder(docs.sparkSession, "records")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_records(write_records(docs, folder, tokenizer, end_id), folder)
