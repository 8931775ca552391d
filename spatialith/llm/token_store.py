"""Token sequences in training order, as fixed-stride binary shards.

Documents are tokenised (SentencePiece, two bytes an id), each ends with an end-of-text id, and the stream of all of
them, in the order of the table (file, then row), is cut into sequences of ``SEQUENCE`` ids; the last one is filled up
with end-of-text ids.  A keyed Feistel network permutes the sequences' numbers; numbers that leave the range walk on
along their cycle, so the result is a permutation of exactly that range.  A sequence's image is its slot in training
order.  Slots are dealt to shards by range, and a shard is its sequences in slot order without headers, so sequence k of
the order lies at byte k % per_shard * stride of file k / per_shard, and a reader resumes anywhere by seeking.

Scale: tokens are stored once (compressed) and shuffled once, to the range of shards that a task writes.  A task that
tokenises counts its tokens as it goes, so a document's place in the stream needs only the sums of the tasks before
(one row a task and file, added up in one window, and joined to the tokens).  Ranges hold ``SHARDS_A_TASK`` shards,
however large the corpus, and go to tasks by their number, so none is empty or doubly full.  Shards are written under a
temporary name and moved, so that repeated tasks leave the same file.  The query writes all shards below the shared
folder and returns the slots as read back from the files.

Edge cases: null and empty texts are an end-of-text id alone.  Identifiers play no part, so null and repeated ones are
harmless.  Rows that don't come straight from files are stored first, in the order in which they come.  An empty table
gives no sequences.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textbatch as B
from .jaccard_join import whole_groups
from .pieces import Vocabulary, encode_chunks, worker_encoder
from .store import Scratch, located, table

SEQUENCE = 1024
STRIDE = 2 * SEQUENCE
PER_SHARD = 1024
#: Files of two megabytes that a task writes, and reads back.
SHARDS_A_TASK = 8
#: Documents from whose tokens the compression is set up, and bytes of its dictionary.
SAMPLE_DOCS = 2000
DICTIONARY_BYTES = 1 << 16
KEY = 0x5EED_0F_0DDC0FFEE
END_ID = 2
FEISTEL_ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, with cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = x.astype(np.uint64, copy=True)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(FEISTEL_ROUNDS):
            salt = np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
            left, right = right, left ^ (B.mix64(right + salt) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


class Packer:
    """Two-byte ranks of ids by frequency, low bytes before high bytes, compressed with a dictionary that all tasks share."""

    def __init__(self, ids_by_rank: np.ndarray, dictionary: bytes = b""):
        import zstandard

        self.ids = ids_by_rank
        self.rank = np.empty(len(self.ids), "<u2")
        self.rank[self.ids] = np.arange(len(self.ids))
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.squeeze = zstandard.ZstdCompressor(3, dict_data=shared, write_content_size=True, write_dict_id=False)
        self.expand = zstandard.ZstdDecompressor(dict_data=shared)

    def planes(self, ids: np.ndarray) -> bytes:
        return self.rank[ids].view(np.uint8).reshape(-1, 2).T.tobytes()

    def pack(self, ids: np.ndarray) -> bytes:
        return self.squeeze.compress(self.planes(ids))

    def unpack(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(self.expand.decompress(data), np.uint8)
        return self.ids[raw.reshape(2, -1).T.copy().view("<u2").ravel()]


def packing(rows: DataFrame, vocabulary: Vocabulary, sample: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> tuple:
    """What ``Packer`` is made of, from about ``sample`` documents by hash of their places; it changes sizes alone."""
    import zstandard

    n_ids = len(vocabulary.out_at) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for _, _, ids, edges in encode_chunks(encoder, batch.column(0).to_pylist()):
                parts = [ids[x : min(y, x + SEQUENCE)].astype("<u2").tobytes() for x, y in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])

    share = max(1, rows.count() // sample)
    few = rows.filter(F.pmod(F.xxhash64("file", "row"), F.lit(share)) == 0).select("text")
    parts = sorted(bytes(r.part) for r in few.mapInArrow(run, "part binary").collect())
    parts = [np.frombuffer(p, "<u2") for p in parts if len(p) >= 8]
    count = np.bincount(np.concatenate(parts), minlength=n_ids) if parts else np.zeros(n_ids, int)
    by_rank = np.argsort(-count, kind="stable").astype("<u2")
    plain = Packer(by_rank)
    try:
        return by_rank, zstandard.train_dictionary(size, [plain.planes(p) for p in parts]).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return by_rank, b""


def _tokenise(vocabulary: Vocabulary, end_id: int, shared: tuple):
    """Maps (text, file, row) to (part, file, row, start, n, data): start is the place among its task's tokens of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer, part = worker_encoder(vocabulary), Packer(*shared), TaskContext.get().partitionId()
        done: dict[str, tuple[int, int]] = {}
        for batch in batches:
            texts, files, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for a, b, ids, edges in encode_chunks(encoder, texts):
                data = [packer.pack(np.append(ids[x:y], end_id)) for x, y in zip(edges, edges[1:], strict=False)]
                n, starts = (np.diff(edges) + 1).tolist(), []
                for file, row, size in zip(files[a:b], rows[a:b].tolist(), n, strict=True):
                    at, last = done.get(file, (0, -1))
                    if row <= last:
                        raise RuntimeError(f"rows of {file} come out of order")
                    starts.append(at)
                    done[file] = at + size, row
                place = [pa.array([part] * (b - a), pa.int32()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)]
                columns = [*place, pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "file", "row", "start", "n", "data"])

    return run


def _fragments(n_sequences: int, length: int, per_task: int, key: int, shared: tuple):
    """Maps (start, data) to the pieces of sequences that it fills: (task, slot, pos, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(*shared)
        for batch in batches:
            starts, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a in range(0, len(packed), 512):
                number, pos, data = [], [], []
                for start, raw in zip(starts[a : a + 512].tolist(), packed[a : a + 512], strict=True):
                    ids = packer.unpack(raw)
                    at = 0
                    while at < len(ids):
                        seq, off = divmod(start + at, length)
                        take = min(length - off, len(ids) - at)
                        number.append(seq)
                        pos.append(off)
                        data.append(raw if take == len(ids) else packer.pack(ids[at : at + take]))
                        at += take
                slot = feistel(np.array(number, np.int64), n_sequences, key)
                task = pa.array((slot // per_task).astype(np.int32))
                columns = [task, pa.array(slot), pa.array(pos, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["task", "slot", "pos", "data"])

    return run


def _assemble(length: int, per_shard: int, end_id: int, shared: tuple):
    """Maps sorted fragments to whole sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(*shared)
        for t, at in whole_groups(batches, ["slot"]):
            slots = t.column("slot").to_numpy()
            data = t.column("data").to_pylist()
            for lo in range(0, len(at) - 1, 1024):
                hi = min(lo + 1024, len(at) - 1)
                rows, filled = [], []
                for x, y in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=False):
                    ids = np.concatenate([packer.unpack(d) for d in data[x:y]])
                    filled.append(len(ids))
                    rows.append(np.pad(ids, (0, length - len(ids)), constant_values=end_id).astype("<u2").tobytes())
                slot = slots[at[lo:hi]]
                columns = [slot // per_shard, slot, slot % per_shard * 2 * length, np.array(filled, np.int32)]
                names = ["shard", "slot", "byte_offset", "n_tokens", "tokens"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(rows, pa.binary())], names)

    return run


SEQUENCES = "shard long, slot long, byte_offset long, n_tokens int, tokens binary"


def _dealt(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str, length: int, per_shard: int, key: int, end_id: int
) -> tuple[DataFrame, Callable] | None:
    """Fragments sorted by slot in the task that owns their range of shards, and the map that makes them sequences.

    None if there are no documents.
    """
    if len(vocabulary.out_at) - 1 > 1 << 16:
        raise ValueError("ids must fit in two bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store")
    rows = located(docs, scratch).select(F.col(f"doc.{text_col}").alias("text"), F.col("_file").alias("file"), F.col("_row").alias("row"))
    shared = packing(rows, vocabulary)
    schema = "part int, file string, row long, start long, n long, data binary"
    tokens = scratch.keep(rows.mapInArrow(_tokenise(vocabulary, end_id, shared), schema), "tokens")
    runs = tokens.groupBy("part", "file").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
    runs = scratch.keep(runs, "runs")
    total = runs.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    before = W.orderBy("file", "row").rowsBetween(W.unboundedPreceding, -1)
    bases = scratch.keep(runs.select("part", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    placed = tokens.select("part", "file", "start", "data").join(bases, ["part", "file"])
    placed = placed.select((F.col("base") + F.col("start")).alias("start"), "data")
    n_sequences = (total + length - 1) // length
    per_task = per_shard * SHARDS_A_TASK
    pieces = placed.mapInArrow(_fragments(n_sequences, length, per_task, key, shared), "task int, slot long, pos int, data binary")
    dealt = pieces.repartitionById(-(-n_sequences // per_task), F.col("task")).sortWithinPartitions("slot", "pos")
    return dealt.select("slot", "data"), _assemble(length, per_shard, end_id, shared)


def sequences(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text_col: str = "text",
    length: int = SEQUENCE,
    per_shard: int = PER_SHARD,
    key: int = KEY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per sequence, partitioned by ranges of shards and sorted by slot: shard, slot, byte_offset, n_tokens, tokens.

    ``tokens``: ``length`` little-endian two-byte ids; ``n_tokens`` of them come from documents.
    """
    found = _dealt(docs, vocabulary, text_col, length, per_shard, key, end_id)
    if found is None:
        return docs.sparkSession.createDataFrame([], SEQUENCES)
    rows, assemble = found
    return rows.mapInArrow(assemble, SEQUENCES)


def _write_files(uri: str):
    """Writes each shard of sorted sequences as one file; yields what it wrote.  Files that are whole already stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for t, at in whole_groups(batches, ["shard"]):
            for x, y in zip(at, at[1:], strict=False):
                part = t.slice(x, y - x)
                shard, data = part.column("shard")[0].as_py(), b"".join(part.column("tokens").to_pylist())
                path = f"{root}/shard-{shard:08d}.bin"
                digest = hashlib.sha256(data).hexdigest()
                info = store.get_file_info(path)
                whole = info.size == len(data)
                if whole:
                    with store.open_input_stream(path) as f:
                        whole = hashlib.sha256(f.read()).hexdigest() == digest
                if not whole:
                    own = f"{root}/.tmp-{uuid.uuid4().hex}"
                    with store.open_output_stream(own) as f:
                        f.write(data)
                    store.move(own, path)
                n_tokens = sum(part.column("n_tokens").to_pylist())
                yield pa.RecordBatch.from_pylist(
                    [{"shard": shard, "path": path, "first_slot": part.column("slot")[0].as_py(), "n_sequences": y - x, "n_tokens": n_tokens, "sha256": digest}]
                )

    return run


MANIFEST = "shard long, path string, first_slot long, n_sequences long, n_tokens long, sha256 string"


def _folder(uri: str) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)


def write_shards(rows: DataFrame, uri: str) -> DataFrame:
    """Write ``sequences`` as files below ``uri`` (a folder that all executors share); the manifest, one row a shard."""
    _folder(uri)
    most = rows.agg(F.max("shard")).first()[0] or 0
    task = F.floor(F.col("shard") / SHARDS_A_TASK).cast("int")
    rows = rows.repartitionById(most // SHARDS_A_TASK + 1, task).sortWithinPartitions("shard", "slot")
    return Scratch(rows.sparkSession, "token-manifest").keep(rows.mapInArrow(_write_files(uri), MANIFEST), "manifest")


def read_slots(uri: str, first: int, end: int, length: int = SEQUENCE, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences of slots ``first`` to ``end`` - 1, read one after the other by seeking."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    while first < end:
        shard = first // per_shard
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(first % per_shard * 2 * length)
            while first < end and first // per_shard == shard:
                yield np.frombuffer(f.read(2 * length), "<u2")
                first += 1


def _read_files(uri: str, length: int, short: tuple[int, int]):
    """Maps manifest rows to the slots of their files; ``short``: the slot that is filled up, and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_stream(r["path"]) as f:
                    data = f.read()
                if len(data) != r["n_sequences"] * 2 * length or hashlib.sha256(data).hexdigest() != r["sha256"]:
                    raise OSError(f"{r['path']} is not what its manifest says")
                slot = r["first_slot"] + np.arange(r["n_sequences"])
                at = 2 * length * np.arange(r["n_sequences"])
                filled = np.where(slot == short[0], short[1], length).astype(np.int32)
                tokens = pa.array([data[x : x + 2 * length] for x in at.tolist()], pa.binary())
                columns = [pa.array(np.full(len(slot), r["shard"])), pa.array(slot), pa.array(at), pa.array(filled), tokens]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "byte_offset", "n_tokens", "tokens"])

    return run


def read_shards(manifest: DataFrame, uri: str, length: int = SEQUENCE, key: int = KEY) -> DataFrame:
    """The rows of ``sequences``, from the files that ``write_shards`` left below ``uri``."""
    m = manifest.agg(F.count(F.lit(1)).alias("shards"), F.sum("n_sequences").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    if not m.shards:
        return manifest.sparkSession.createDataFrame([], SEQUENCES)
    last = int(feistel(np.array([m.n - 1]), m.n, key)[0])
    short = (last, m.tokens - (m.n - 1) * length)
    return manifest.repartition(-(-m.shards // SHARDS_A_TASK)).mapInArrow(_read_files(uri, length, short), SEQUENCES)


def store(docs: DataFrame, vocabulary: Vocabulary, uri: str, length: int = SEQUENCE, per_shard: int = PER_SHARD) -> DataFrame:
    """Write all shards of ``docs`` below ``uri``; returns their slots, read back from the files."""
    spark = docs.sparkSession
    found = _dealt(docs, vocabulary, "text", length, per_shard, KEY, END_ID)
    if found is None:
        return spark.createDataFrame([], SEQUENCES)
    rows, assemble = found
    write = _write_files(uri)
    _folder(uri)
    # sequences go from the assembler to the writer within one worker
    manifest = rows.mapInArrow(lambda batches: write(assemble(batches)), MANIFEST)
    return read_shards(Scratch(spark, "token-manifest").keep(manifest, "manifest"), uri, length)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"), Vocabulary(), Scratch(spark, "token-shards").path("shards"))
