"""Training-order materialisation: token sequences in fixed-stride binary shards, in a keyed random order.

A row's ids are followed by an end id and cut into sequences of ``length`` ids; the last one is padded. Each row is given as
many numbers as it can have sequences at most, which Spark counts alone, in the order of the input's partitions; a keyed
Feistel permutation with cycle walking sends each number to a place. Ranges of places are the shards, and a
range partition writes its sequences by place, each at the same stride. So ids are made once, in one pass, and no
table of them is written; places without a sequence take no room. The global slot of a sequence is that of its
place among all taken ones: the sequences of the shards before its own and its row there, at byte row * stride.

A task writes its shards whole under a name of its own and then renames them; a repeated or lost task writes the same
bytes again, and a shard that stands in the folder is complete and left as it is, so a run that broke off is
resumed by the same call. The rows that the writer returns are the manifest, which ``write_documents`` keeps.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, shared_path
from .feistel import permute_array

#: Ranks of a public byte-level BPE (one base64 piece and its id a line), and the pattern that cuts a text for it.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Bpe:
    """Ids (uint16) of texts by a BPE of at most 2**16 - 2 pieces."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pieces = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder's address and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def _values(encoder: Callable | None, dtype: str):
    """What makes an Arrow array of texts (with an encoder), of binaries or of arrays of numbers an iterator of ids."""
    encode = encoder() if encoder else None

    def run(column: pa.Array) -> Iterator[np.ndarray]:
        for x in column:
            if not x.is_valid:
                yield np.empty(0, dtype)
            elif encode:
                yield encode(x.as_py()) if len(x.as_py()) else np.empty(0, dtype)
            elif pa.types.is_binary(column.type):
                yield np.frombuffer(x.as_buffer(), dtype)
            else:
                yield x.values.to_numpy(zero_copy_only=False).astype(dtype)

    return run


def _cut(offsets_of: dict[int, int], expected: dict[int, int], n: int, length: int, dtype: str, end: int, key: int, words: bytes, encoder: Callable | None):
    """Sequences of a partition's rows at their places; rows are numbered from the partition's offset by the most sequences they can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = first = offsets_of.get(part, 0)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        read = _values(encoder, dtype)
        for batch in batches:
            doc, seq, place, valid, payload, held = [], [], [], [], [], 0

            def out():
                return pa.RecordBatch.from_pydict(
                    {
                        "place": pa.array(np.concatenate(place), pa.int64()),
                        "doc_id": pa.array(doc, pa.int64()),
                        "seq": pa.array(seq, pa.int64()),
                        "n_ids": pa.array(valid, pa.int64()),
                        "payload": pa.array(payload, pa.binary()),
                    }
                )

            for doc_id, most, values in zip(batch["doc_id"].to_pylist(), batch["most"].to_pylist(), read(batch["ids"]), strict=True):
                count = len(values) // length + 1
                if count > most:
                    raise ValueError(f"{len(values)} ids need {count} sequences; {most} were counted at most")
                data = np.append(values, np.array([end], dtype)).tobytes()
                place.append(permute_array(np.arange(number, number + count), n, key))
                number += most
                doc += [doc_id] * count
                seq += range(count)
                valid += [length] * (count - 1) + [len(values) + 1 - (count - 1) * length]
                stride = length * np.dtype(dtype).itemsize
                payload += [packer.compress(data[i * stride : (i + 1) * stride]) for i in range(count)]
                held += len(data)
                if held >= 8 << 20:
                    yield out()
                    doc, seq, place, valid, payload, held = [], [], [], [], [], 0
            if doc:
                yield out()
        if number - first != expected.get(part, 0):
            raise RuntimeError(f"partition {part} has {number - first} numbers, {expected.get(part, 0)} were counted; the input isn't read the same way twice: write it to a table first")

    return run


def _write(folder: str, per_shard: int, length: int, dtype: str, pad: int, words: bytes):
    """Unpacks and pads the sequences, writes each shard of a partition that is sorted by place; returns where each sequence stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        shard, sink, name, row = None, None, "", 0
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        blank = np.full(length, pad, dtype).tobytes()
        final = lambda k: f"{root}/shard-{k:08d}.bin"

        def close() -> None:
            if sink is not None:
                sink.close()
                files.move(name, final(shard))

        try:
            for batch in batches:
                shards = batch["place"].to_numpy() // per_shard
                crc, rows = [], []
                for s, payload in zip(shards.tolist(), batch["payload"], strict=True):
                    if s != shard:
                        close()
                        shard, name, sink, row = s, f"{root}/.{s}-{uuid.uuid4().hex}", None, 0
                        if files.get_file_info(final(s)).type != fs.FileType.File:
                            sink = files.open_output_stream(name)
                    buffer = unpacker.decompress(payload.as_buffer())
                    buffer += blank[len(buffer) :]
                    if sink is not None:
                        sink.write(buffer)
                    crc.append(zlib.crc32(buffer))
                    rows.append(row)
                    row += 1
                yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("doc_id", "seq", "n_ids")} | {"shard": pa.array(shards, pa.int64()), "row": pa.array(rows, pa.int64()), "crc32": pa.array(crc, pa.int64())})
            close()
            sink = None
        finally:
            if sink is not None and not sink.closed:
                sink.close()

    return run


def _dictionary(ids: DataFrame, dtype: str, encoder: Callable | None, rows: int = 1000, each: int = 2048) -> bytes:
    """A compression dictionary for what is shuffled, from the beginnings of a bounded sample; it has no bearing on what is written."""
    head = F.slice("ids", 1, each) if dict(ids.dtypes)["ids"].startswith("array") else F.substring("ids", 1, each)
    found = [r[0] for r in ids.select(head.alias("ids")).limit(rows).collect() if r[0]]
    encode = encoder() if encoder else lambda x: bytes(x) if isinstance(x, bytes | bytearray) else np.array(x, dtype)
    parts = [x if isinstance(x := encode(r), bytes) else x.astype(dtype).tobytes() for r in found]
    pieces = [p[i : i + 512] for p in parts for i in range(0, len(p), 512)]
    try:
        return zstandard.train_dictionary(65_536, pieces).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_shards(df: DataFrame, id_col: str, ids: Column, most: Column, folder: str, length: int, per_shard: int, dtype: str = "uint16", end: int = 1, pad: int = 0, key: int = 20240229, encoder: Callable | None = None) -> DataFrame:
    """Write the sequences of ``df`` to ``folder``; rows (doc_id, seq, n_ids, shard, row, crc32, slot), one a sequence.

    ``ids``: array of int or binary column (ids as ``dtype``), or a text column with ``encoder``, which makes a function from text to ids in
    each worker. ``most``: the number of ids at most, computed by Spark alone. ``per_shard``: places of a shard. ``df`` must be
    read from files: its partitions are visited twice and must hold the same rows each time; each task checks this and fails
    otherwise. Null ids count as none: one sequence with the end id. Repeated rows are written each. An empty input writes no
    shard. The ids go through one shuffle, to the task that writes their shard. Shards and manifest are written by this call.
    """
    each = (F.floor(F.coalesce(most, F.lit(0)) / length).cast("long") + 1).alias("most")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), each, ids.alias("ids"))
    parts = rows.select(F.spark_partition_id().alias("p"), "most").groupBy("p").agg(F.sum("most").alias("n")).collect()
    expected = {r["p"]: r["n"] for r in parts}
    offsets, total = {}, 0
    for p, n in sorted(expected.items()):
        offsets[p], total = total, total + n
    words = _dictionary(rows.select("ids"), dtype, encoder)
    sequences = rows.mapInArrow(_cut(offsets, expected, total, length, dtype, end, key, words, encoder), "place long, doc_id long, seq long, n_ids long, payload binary")
    shards = max(1, -(-total // per_shard))
    dealt = sequences.repartitionById(shards, F.expr(f"cast(place div {int(per_shard)} as int)")) if total else sequences
    written = dealt.sortWithinPartitions("place").mapInArrow(_write(folder, per_shard, length, dtype, pad, words), "doc_id long, seq long, n_ids long, shard long, row long, crc32 long")
    manifest = materialise(written, "shard-manifest")
    # One row a shard: what comes before it.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return manifest.join(starts, "shard").select(*manifest.columns, (F.col("first") + F.col("row")).alias("slot"))


def read_shards(folder: str, length: int, dtype: str = "uint16", start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from slot ``start`` on, shard by shard in training order. Shards before it are skipped by their sizes."""
    files, root = store(folder)
    stride = length * np.dtype(dtype).itemsize
    slot = 0
    for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda x: x.base_name):
        if not info.base_name.startswith("shard-"):
            continue
        held = info.size // stride
        if slot + held <= start:
            slot += held
            continue
        with files.open_input_file(info.path) as f:
            skip = max(start - slot, 0)
            f.seek(skip * stride)
            slot += skip
            while data := f.read(stride):
                yield slot, np.frombuffer(data, dtype)
                slot += 1


def write_documents(docs: DataFrame, folder: str, length: int = 512, per_shard: int = 65_536, key: int = 20240229, ranks_path: str = RANKS_PATH) -> DataFrame:
    """Write documents as token ids (uint16) with the two ids after the vocabulary's last as end and padding; the rows of ``write_shards``.

    A text has no more ids than bytes. Columns other than doc_id and text don't matter, whatever their names.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    last = max(int(line.split()[1]) for line in ranks.splitlines() if line.strip())
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return write_shards(docs.select("doc_id", "text"), "doc_id", F.col("text"), F.octet_length("text"), folder, length, per_shard, "uint16", last + 1, last + 2, key, lambda: Bpe(shared.value).encode)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence of the shards: doc_id, seq, n_ids, shard, row, crc32 of its bytes, slot."""
    return write_documents(documents(spark, sf_dir), shared_path(spark, "token-shards"))
