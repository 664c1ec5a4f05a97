"""Token ids in binary shards with a minimal perfect hash index.

A shard is three files. ``<name>.ids`` holds the ids of its documents one after another as raw
little-endian unsigned integers, of 16 bits if the vocabulary has no larger id, else of 32.
``<name>.idx`` is the index: a header of fixed size; a minimal perfect hash over the distinct keys, as levels of bits
(a key stays at the first level at which it is alone in its bit; its number is the count of bits
before it) in blocks of 64 bytes, each with the count before it and 448 bits; a record for each
number, of a stored 32-bit fingerprint, the key's first document and how many it has; and the offset of each
document (in ids). ``<name>.keys`` lists the keys in order, for readers that want every document.

A lookup by key reads a block a level (1.6 on average), a record, two offsets and the ids:
its time and memory don't depend on the size of the shard, and absent keys are found out but for
one in 2**32. Readers of all documents look every key up in the same index, many at once, and read
ids in long stretches. Shards hold ascending key ranges and are listed, with their totals, in a
manifest table of one row a shard.

Files go to the shared folder through pyarrow's file systems under names of their own, and only
the names that finished tasks report are in the manifest, so a retried task leaves no trace.

Defined cases: null and empty texts have the end id alone; repeated keys keep their order of
arrival and share a number; a null key comes first and isn't indexed; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.runtime import BLOCK_BYTES, shared_dir, stored, text_bytes
from millrace.llm.units import Units, pretoken_units, ragged

MANIFEST = "shard long, name string, first_key long, n_docs long, n_ids long"
#: Bits for each key at a level of the hash.
GAMMA = 2
#: Bits of a block after its count, bytes of the header, and what it begins with.
BLOCK_BITS, HEADER, MAGIC = 448, 640, 0x31305844494C494D
RECORD = np.dtype([("print", "<u4"), ("count", "<u4"), ("first", "<u8")])
#: Documents that are looked up together, and ids that are read together, where all are read.
STRETCH, STRETCH_IDS = 8192, 2 << 20
#: Units that go to the tokenizer as one string.
JOINED = 256
#: Units that a worker remembers: to encode one again costs much more than to find it.
REMEMBERED = 1 << 20


class Encoder:
    """Ids of the tokenizers library; each distinct unit of a worker's texts is encoded once."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.length = np.array([len(added[i].encode()) if i in added else len(self.tokenizer.id_to_token(i)) for i in range(size)], np.int64)
        self.added = [t.encode() for t in added.values() if t]
        self.units = Units(self._encode, REMEMBERED)

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # many units go as one string: those led by a space stand after one another, those of
        # visible ASCII ends stand on lines of their own, whose line ends are left out again
        led, lines, alone = [], [], []
        for k, u in enumerate(units):
            if len(u) > 1 and u[0] == 32 and 32 < u[1] < 127 and 32 < u[-1] < 127:
                led.append(k)
            elif 32 < u[0] < 127 and 32 < u[-1] < 127:
                lines.append(k)
            else:
                alone.append(k)
        texts = [b"".join(units[k] for k in led[i : i + JOINED]) for i in range(0, len(led), JOINED)]
        texts += [b"".join(b"\n" + units[k] for k in lines[i : i + JOINED]) for i in range(0, len(lines), JOINED)]
        texts += [units[k] for k in alone]
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.int32)
        order = np.array(led + lines + alone, np.int64)
        ends = np.array([len(units[k]) for k in order], np.int64)
        ends[len(led) : len(led) + len(lines)] += 1
        at = np.concatenate([[0], np.cumsum(self.length[ids])])
        cuts = np.searchsorted(at, np.concatenate([[0], np.cumsum(ends)]))
        first, counts = cuts[:-1].copy(), np.diff(cuts)
        first[len(led) : len(led) + len(lines)] += 1
        counts[len(led) : len(led) + len(lines)] -= 1
        back = np.argsort(order)
        return ids[ragged(first[back], counts[back])], counts[back]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and id offsets; ``end_id`` closes each text."""
        part, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        raw = part.tobytes()
        if any(t in raw for t in self.added):
            # strings of added tokens are found before anything else; such texts aren't cut
            got = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)
            ids, row = np.fromiter(chain.from_iterable(e.ids for e in got), np.int32), np.arange(len(got))
            counts = np.array([len(e.ids) for e in got], np.int64)
        else:
            starts, ends, row = pretoken_units(part, at) if len(part) else (np.zeros(0, np.int64),) * 3
            ids, counts = self.units(part, starts, ends)
        per = np.bincount(row, weights=counts, minlength=len(at) - 1).astype(np.int64)
        more = int(end_id is not None)
        out = np.zeros(len(at), np.int64)
        np.cumsum(per + more, out=out[1:])
        if not more:
            return ids, out
        flat = np.full(int(out[-1]), end_id, np.int32)
        body = np.ones(len(flat), bool)
        body[out[1:] - 1] = False
        flat[body] = ids
        return flat, out


_encoders: dict[bytes, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    key = raw[:64] + raw[-64:] + len(raw).to_bytes(8, "little")
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def hashed(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key at a level of ``size`` bits."""
    return (W.mix(keys.astype(W.U64) + W.U64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))) % W.U64(size)).astype(np.int64)


def levels_of(keys: np.ndarray) -> list[np.ndarray]:
    """The levels of a minimal perfect hash over distinct keys."""
    levels: list[np.ndarray] = []
    while len(keys):
        size = GAMMA * len(keys) + 1
        at = hashed(keys, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (W.mix(keys.astype(W.U64) ^ W.U64(0xA5A5F00DC0FFEE11)) >> W.U64(32)).astype(np.uint32)


def blocks_of(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Each level as blocks of 64 bytes: the number of bits before the block, and its own bits."""
    out, before = [], 0
    for bits in levels:
        n = -(-len(bits) // BLOCK_BITS)
        full = np.zeros(n * BLOCK_BITS, bool)
        full[: len(bits)] = bits
        full = full.reshape(n, BLOCK_BITS)
        counts = full.sum(1)
        ranks = (np.cumsum(counts) - counts + before).astype("<u8")
        out.append(np.concatenate([ranks.view(np.uint8).reshape(n, 8), np.packbits(full, axis=1, bitorder="little")], axis=1))
        before += int(counts.sum())
    return out


class Index:
    """A minimal perfect hash with records, read from ``read(n_bytes, at)``: little for each key that is looked up."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = np.frombuffer(read(HEADER, 0), "<i8")
        if head[0] != MAGIC:
            raise ValueError("no index of a shard")
        self.width, self.n_docs, self.n_null, self.n_keys, n_levels = (int(x) for x in head[1:6])
        self.sizes = [int(x) for x in head[6 : 6 + n_levels]]
        self.starts, at = [], HEADER
        for size in self.sizes:
            self.starts.append(at)
            at += 64 * -(-size // BLOCK_BITS)
        self.records, self.offsets = at, at + RECORD.itemsize * self.n_keys

    @staticmethod
    def build(keys: np.ndarray, first: np.ndarray, count: np.ndarray, offsets: np.ndarray, n_null: int, width: int) -> bytes:
        """``keys``: distinct ones, with the first document and number of documents of each."""
        levels = levels_of(keys)
        head = np.zeros(HEADER // 8, "<i8")
        head[: 6 + len(levels)] = [MAGIC, width, len(offsets) - 1, n_null, len(keys), len(levels), *map(len, levels)]
        blocks = b"".join(x.tobytes() for x in blocks_of(levels))
        empty = Index(lambda n, at: (head.tobytes() + blocks)[at : at + n])
        records = np.zeros(len(keys), RECORD)
        records[empty.numbers(keys)] = np.rec.fromarrays([fingerprint(keys), count, first], dtype=RECORD)
        return head.tobytes() + blocks + records.tobytes() + offsets.astype("<u8").tobytes()

    def number(self, key: int) -> int:
        """The number of one key; -1 where no level has it."""
        keys = np.array([key], np.int64)
        for level, size in enumerate(self.sizes):
            block, bit = divmod(int(hashed(keys, level, size)[0]), BLOCK_BITS)
            raw = self.read(64, self.starts[level] + 64 * block)
            bits = int.from_bytes(raw[8:], "little")
            if bits >> bit & 1:
                return int.from_bytes(raw[:8], "little") + (bits & ((1 << bit) - 1)).bit_count()
        return -1

    def find(self, key: int) -> tuple[int, int]:
        """First document and number of documents of one key; (-1, 0) if there is none."""
        number = self.number(key)
        if number < 0:
            return -1, 0
        record = np.frombuffer(self.read(RECORD.itemsize, self.records + RECORD.itemsize * number), RECORD)[0]
        return (int(record["first"]), int(record["count"])) if record["print"] == fingerprint(np.array([key], np.int64))[0] else (-1, 0)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level has it. Reads whole levels."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            n = -(-size // BLOCK_BITS)
            blocks = np.frombuffer(self.read(64 * n, self.starts[level]), np.uint8).reshape(n, 64)
            ranks = np.ascontiguousarray(blocks[:, :8]).view("<u8").reshape(-1)
            missed = []
            for lo in range(0, len(todo), 4096):
                own = todo[lo : lo + 4096]
                block, bit = np.divmod(hashed(keys[own], level, size), BLOCK_BITS)
                bits = np.unpackbits(blocks[block, 8:], axis=1, bitorder="little")
                hit = bits[np.arange(len(own)), bit] > 0
                out[own[hit]] = ranks[block[hit]].astype(np.int64) + (bits[hit] * (np.arange(BLOCK_BITS) < bit[hit, None])).sum(1)
                missed.append(own[~hit])
            todo = np.concatenate(missed) if missed else todo
        return out

    def first_of(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, -1 if there is none."""
        number = self.numbers(keys)
        if not self.n_keys:
            return number
        records = np.frombuffer(self.read(RECORD.itemsize * self.n_keys, self.records), RECORD)[number]
        return np.where((number >= 0) & (records["print"] == fingerprint(keys)), records["first"].astype(np.int64), -1)

    def ends(self, lo: int, hi: int) -> np.ndarray:
        """Offsets (in ids) of documents lo to hi, and the end."""
        return np.frombuffer(self.read(8 * (hi - lo + 1), self.offsets + 8 * lo), "<u8").astype(np.int64)


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class Shard:
    """Access to one shard by key, or to all of its documents (``whole``: the index is read at once)."""

    def __init__(self, folder: str, name: str, whole: bool = False):
        fs, base = _files(folder)
        self.at = f"{base}/{name}"
        self.fs, self.file = fs, fs.open_input_file(f"{self.at}.ids")
        index = fs.open_input_file(f"{self.at}.idx")
        if whole:
            raw = memoryview(index.read())
            self.index = Index(lambda n, at: raw[at : at + n])
        else:
            self.index = Index(index.read_at)
        self.kind = np.dtype(f"<u{self.index.width}")

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids number lo to hi of the shard."""
        return np.frombuffer(self.file.read_at(self.kind.itemsize * (hi - lo), self.kind.itemsize * lo), self.kind)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key."""
        first, count = self.index.find(key)
        if first < 0:
            return []
        ends = self.index.ends(first, first + count)
        return [self.ids(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches of documents: keys (which of them are null), offsets and their ids. Where a key's documents are, the index says."""
        index, done, last, start = self.index, 0, None, 0
        keys_file = self.fs.open_input_file(f"{self.at}.keys")
        while done < index.n_docs:
            n = min(STRETCH, index.n_docs - done)
            keys = np.frombuffer(keys_file.read_at(8 * n, 8 * done), "<i8").astype(np.int64)
            own = np.arange(done, done + n)
            null = own < index.n_null
            # equal keys stand together: the k-th of a run has the k-th document of its key
            new = np.ones(n, bool)
            new[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
            new[0] = (int(keys[0]), bool(null[0])) != last
            run = np.maximum.accumulate(np.where(new, own, start))
            last, start = (int(keys[-1]), bool(null[-1])), int(run[-1])
            at = np.where(null, own, index.first_of(keys) + own - run)
            if (np.diff(at) != 1).any() or at[0] < 0:
                raise ValueError(f"the index of {self.at} doesn't lead to its documents")
            ends = index.ends(int(at[0]), int(at[-1]) + 1)
            lo = 0
            while lo < n:  # some documents at a time, one at least
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + STRETCH_IDS, side="right")) - 1)
                yield keys[lo:hi], null[lo:hi], ends[lo : hi + 1], self.ids(int(ends[lo]), int(ends[hi]))
                lo = hi
            done += n


def _index(keys: np.ndarray, is_null: np.ndarray, offsets: np.ndarray, kind: str) -> bytes:
    n_null = int(is_null.sum())
    distinct, first, count = np.unique(keys[n_null:], return_index=True, return_counts=True)
    return Index.build(distinct, first + n_null, count, offsets, n_null, int(kind[-1]))


def write_shards(docs: DataFrame, tokenizer: bytes, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode and write all documents in ascending key order; the manifest, a row a shard in key order."""
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    parts = max(1, -(-text_bytes(base, "__text") // shard_bytes))
    fs, at = _files(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, name = encoder_of(tokenizer), uuid.uuid4().hex
        keys, nulls, sizes, out = [], [], [], None
        fs, base_path = _files(folder)
        for batch in batches:
            data, offsets = W.column(batch, "__text")
            keys.append(W.int_column(batch, "__id"))
            nulls.append(batch.column("__id").is_null().to_numpy(zero_copy_only=False))
            if out is None:
                out = fs.open_output_stream(f"{base_path}/{name}.ids")
            for lo, hi in W.pieces(offsets):
                ids, ends = encoder.encode(data, offsets[lo : hi + 1], end_id)
                out.write(ids.astype(encoder.kind).tobytes())
                sizes.append(np.diff(ends))
        if out is None or not sum(map(len, keys)):
            return
        out.close()
        key, null, size = np.concatenate(keys), np.concatenate(nulls), np.concatenate(sizes)
        with fs.open_output_stream(f"{base_path}/{name}.idx") as f:
            f.write(_index(key, null, np.concatenate([[0], np.cumsum(size)]), encoder.kind))
        with fs.open_output_stream(f"{base_path}/{name}.keys") as f:
            f.write(key.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([None if null[0] else int(key[0])], pa.int64()), pa.array([len(key)], pa.int64()), pa.array([int(size.sum())], pa.int64())], names=["shard", "name", "first_key", "n_docs", "n_ids"])

    ordered = base.repartitionByRange(parts, "__id").sortWithinPartitions("__id")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document in key order: doc_id, start (ids before it), n_tokens and ids_crc32 (of its raw ids), from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("name", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                for keys, null, ends, ids in Shard(folder, name, whole=True).documents():
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cuts = (4 * (ends - ends[0])).tolist()
                    crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(ends[:-1] + before), pa.array(np.diff(ends)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, manifest.count()), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_folder(docs: DataFrame) -> str:
    """A new folder for shards in the shared folder."""
    return f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
