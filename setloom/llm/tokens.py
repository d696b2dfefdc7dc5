"""Token ids in Arrow files of equal-length sequences.

Documents are ranged and sorted by doc_id; each range is one shard of two Arrow IPC files in the shared folder: sequences
(fixed-size lists of ids and of a mask, read in place through a memory map) and the documents' places in them. A shard's
last sequence is filled up with id 0 under mask 0. A task writes to names of its own and only the manifest says which
files count, so tasks that run twice do no harm. The manifest's sums give each shard its offset.

Defined results: null or empty text is the end id alone; null doc_ids come last; rows of one doc_id are ordered by
their text's hash, repeated rows follow one another; a text of any length is encoded whole and may span sequences; columns
of other names are ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, new_path, pick, spread

VOCABULARY = "byte_bpe_50k.json"
#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH = 1024, 64
END = 0
#: Pieces a worker remembers.
MEMORY = 1_000_000
#: Input of a shard; shards there are at most, as the driver sums up their sizes; beyond, shards grow.
MB, MOST_SHARDS = 16.0, 20_000

#: Texts of these characters alone are cut into pieces here, just as the library cuts them: letters, digits and the rest.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e¡¢£§«»¿×÷‐-‧{LETTER}]*")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")


class Encoder:
    """The library's ids of a text, as bytes; pieces met before are not encoded again."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values(), default=0) + 1
        #: Which ids begin with a space, and with a line's end, in the alphabet of bytes.
        self.begins = [np.zeros(top, bool), np.zeros(top, bool)]
        for token, i in vocabulary.items():
            self.begins[0][i], self.begins[1][i] = token.startswith("Ġ"), token.startswith("Ċ")

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        known, cut = self.known, []
        for text in texts:
            plain = text and "<|" not in text and PLAIN.fullmatch(text)
            cut.append(PIECES.findall(text) if plain else None)
        new = set().union(*[p for p in cut if p]).difference(known)
        spaced = [p for p in new if p[0] == " " and not p.isspace()]
        tight = [p for p in new if not p[0].isspace()]
        own: dict[str, bytes] = {}
        self.learn(own, spaced, "".join(spaced), self.begins[0], 0)
        self.learn(own, tight, "\n" + "\n".join(tight), self.begins[1], 1)
        for piece in new.difference(own):
            own[piece] = self.pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        full = len(known) >= MEMORY  # frequent pieces come early
        known.update(own)
        find = known.__getitem__
        out = []
        for text, pieces in zip(texts, cut):
            if pieces is not None:
                out.append(b"".join(map(find, pieces)))
            else:
                out.append(self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b"")
        if full:
            for piece in own:
                del known[piece]
        return out

    def learn(self, own: dict[str, bytes], new: list[str], joined: str, begins: np.ndarray, skip: int) -> None:
        """Encodes many pieces in one call: a space or a line's end before each keeps the library's cuts where they were.

        Only the first id of a piece begins with its space; skip: ids of a line's end, itself no part of a piece. Should
        the number of pieces differ, or a line's end be joined with what follows, nothing is learned here.
        """
        if not new:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        edge = np.append(np.flatnonzero(begins[ids]), len(ids))
        sizes = np.diff(edge) - skip
        if len(sizes) == len(new) and edge[0] == 0 and sizes.min() > 0 and (not skip or len(np.unique(ids[edge[:-1]])) == 1):
            raw, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
            starts, ends = ((edge[:-1] + skip) * width).tolist(), (edge[1:] * width).tolist()
            own.update((p, raw[a:b]) for p, a, b in zip(new, starts, ends))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def sequence_schema(kind: str, length: int) -> pa.Schema:
    ids = pa.uint16() if kind == "<u2" else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class Shard:
    """Writer of one shard's two files."""

    def __init__(self, folder: str, kind: str, length: int):
        self.fs, at = place(folder)
        self.fs.create_dir(at, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}"
        _, path = place(self.name)
        self.schema, self.kind, self.length = sequence_schema(kind, length), kind, length
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [self.fs.open_output_stream(f"{path}.seq.arrow"), self.fs.open_output_stream(f"{path}.doc.arrow")]
        self.seq = pa.ipc.new_file(self.streams[0], self.schema)
        self.doc = pa.ipc.new_file(self.streams[1], self.doc_schema)
        self.rest: list[bytes] = []
        self.held = self.n = self.docs = 0
        self.first = None

    def add(self, doc_ids: list, texts: list[bytes]) -> None:
        width = np.dtype(self.kind).itemsize
        counts = [len(t) // width for t in texts]
        starts = (np.cumsum([0, *counts])[:-1] + self.n).tolist()
        if not self.docs:
            self.first = doc_ids[0]
        self.docs += len(doc_ids)
        self.n += sum(counts)
        self.doc.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self.doc_schema))
        self.rest += texts
        self.held += sum(counts)
        if self.held >= self.length * BATCH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), self.kind)
        full = self.length * BATCH
        upto = len(ids) if last else len(ids) // full * full
        for at in range(0, upto, full):
            part = ids[at : min(at + full, upto)]
            fill = -len(part) % self.length
            mask = np.concatenate([np.ones(len(part), bool), np.zeros(fill, bool)])
            part = np.concatenate([part, np.zeros(fill, self.kind)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.seq.write_batch(pa.record_batch(lists, schema=self.schema))
        self.rest = [ids[upto:].tobytes()]
        self.held = len(ids) - upto

    def close(self) -> None:
        self.flush(True)
        self.seq.close()
        self.doc.close()
        for s in self.streams:
            s.close()


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """doc_id, text -> the manifest of the shards written: first_id, first_hash, path, n_docs, n_tokens."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    end = np.array([END], kind).tobytes()

    def run(batches):
        shard, own = None, encoder(path, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [ids + end for ids in own.encode_all(part.column(1).to_pylist())]
                if not shard:
                    shard, first_hash = Shard(folder, kind, length), part.column(2)[0].as_py()
                shard.add(part.column(0).to_pylist(), texts)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"first_id": pa.array([shard.first], pa.int64()), "first_hash": pa.array([first_hash], pa.int64()), "path": [shard.name], "n_docs": pa.array([shard.docs], pa.int64()), "n_tokens": pa.array([shard.n], pa.int64())})

    n = shards or min(spread(docs, MB), MOST_SHARDS)
    order = [F.col("doc_id").asc_nulls_last(), "h"]  # so rows of one doc_id, or of none, are dealt over shards too
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(run, "first_id long, first_hash long, path string, n_docs long, n_tokens long"), "tokens-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The manifest's files -> doc_id, start, n_tokens, ids_crc32; start counts the ids of all documents before."""
    shards = manifest.orderBy(F.col("first_id").asc_nulls_last(), "first_hash").select("path", "n_tokens").collect()  # at most MOST_SHARDS
    base, rows = 0, []
    for s in shards:
        rows.append((s.path, base))
        base += s.n_tokens

    def opened(uri: str):
        fs, path = place(uri)
        return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))

    def run(batches):
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq, doc = opened(f"{path}.seq.arrow"), opened(f"{path}.doc.arrow")
                flat = [seq.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True) for i in range(seq.num_record_batches)]
                size = len(flat[0]) if flat else 1
                for i in range(doc.num_record_batches):
                    part = doc.get_batch(i)
                    sums = []
                    for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        crc = 0
                        while n:
                            b, at = divmod(start, size)
                            ids = flat[b][at : at + n]
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            start, n = start + len(ids), n - len(ids)
                        sums.append(crc)
                    starts = pa.array(part.column(1).to_numpy() + offset, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    todo = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")
    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, written in ascending doc_id and read back: where they start, how many, their checksum."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    return read(write(docs, new_path(spark, "tokens")))
