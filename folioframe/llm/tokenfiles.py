"""Token-id files of fixed-width bit-packed ids.

A file is a run of frames, each ended by FRAME_END. A frame (all integers little-endian):

    magic "FFTK1", version byte, shard int64, ordinal int64, n_docs int64, n_ids int64, bits int64, block int64,
    open int64 (1: the last document goes on in the next frame), body length int64, then the body and FRAME_END.

The body has n_docs document keys (int64), n_docs document lengths (int64), the offsets of blocks of `block` ids (bit
offsets, int64) and the ids, `bits` each, most significant bit first; every block begins at a byte. `bits` is the least
that the vocabulary needs. A block is found by its offset and unpacked by numpy without the ones before it.

Files are written by Spark's own text writer and commit protocol: one row a frame with FRAME_END as the line separator,
so they land in any store that Spark writes, retried tasks leave no half files, and no executor opens a path itself.
They are read as binary files. Documents go by ascending key (nulls first, ties by text) over shards that are ranges of
the key; a document may span frames, which its length of zero or more ids in each frame adds up over.

Cases: null text counts as empty; a repeated key is written each time; extra columns are ignored; an empty table gives
no frames and an empty result. Files hold the order of documents; their global offsets come from the frames' counts, one
small row a shard.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.bpe import gathered
from folioframe.llm.kernels import HashIndex, Words, slices, text_bytes

MAGIC = b"FFTK1\x01"
FRAME_END = "\n"
BLOCK = 4096
FRAME_IDS = 1 << 20
HEAD = len(MAGIC) + 8 * 8
CACHE_WORDS = 2_000_000
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
NULL_KEY = -(2**63)


def bits_for(vocabulary: int) -> int:
    """The least bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    flags = (ids[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(flags.astype(np.uint8)).tobytes()


def unpack_block(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return raw[: 2 * n].view(">u2").astype(np.int64)
    flags = np.unpackbits(raw[: (n * bits + 7) // 8], count=n * bits).reshape(n, bits).astype(np.int64)
    return flags @ (1 << np.arange(bits - 1, -1, -1))


def make_frame(shard: int, ordinal: int, keys: np.ndarray, lens: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK, more: bool = False) -> bytes:
    """A frame without its FRAME_END."""
    packed, offsets, at = [], [], 0
    for i in range(0, len(ids), block):
        b = pack_block(ids[i : i + block], bits)
        offsets.append(at * 8)
        at += len(b)
        packed.append(b)
    body = b"".join([keys.astype("<i8").tobytes(), lens.astype("<i8").tobytes(), np.array(offsets, "<i8").tobytes(), *packed])
    head = np.array([shard, ordinal, len(keys), len(ids), bits, block, int(more), len(body)], "<i8").tobytes()
    return MAGIC + head + body


class Frame:
    """A frame over the bytes of a file, from `at` on."""

    def __init__(self, data: np.ndarray, at: int = 0):
        if data[at : at + len(MAGIC)].tobytes() != MAGIC:
            raise ValueError("not a token frame")
        head = np.frombuffer(data[at + len(MAGIC) : at + HEAD].tobytes(), "<i8")
        self.shard, self.ordinal, self.n_docs, self.n_ids, self.bits, self.block, self.open, size = (int(x) for x in head)
        body = data[at + HEAD : at + HEAD + size]
        self.end = at + HEAD + size + len(FRAME_END)
        self.keys = np.frombuffer(body[: 8 * self.n_docs].tobytes(), "<i8")
        self.lens = np.frombuffer(body[8 * self.n_docs : 16 * self.n_docs].tobytes(), "<i8")
        n_blocks = -(-self.n_ids // self.block)
        lo = 16 * self.n_docs
        self.offsets = np.frombuffer(body[lo : lo + 8 * n_blocks].tobytes(), "<i8")
        self.packed = body[lo + 8 * n_blocks :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop; only the blocks that hold them are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last = start // self.block, (stop - 1) // self.block
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack_block(self.packed[int(self.offsets[b]) // 8 :], n, self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]


def frames(data: bytes) -> Iterator[Frame]:
    raw, at = np.frombuffer(data, np.uint8), 0
    while at < len(raw):
        f = Frame(raw, at)
        at = f.end
        yield f


class WordEncoder:
    """A `tokenizers` file whose normaliser and pre-tokeniser never look across ASCII white space and fold A-Z, applied
    to whole texts by way of their distinct words. A `.` or `,` after an ASCII letter or digit is a pre-token of its own
    and counts as a word. New words of letters are coded many at a time, as a text with single spaces: each of them is
    one pre-token, which ends at an id that carries the end-of-word mark. Other words are coded each for itself. Words
    are known by 64-bit hashes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            self.ends[i] = word.endswith("</w>")
        self.marks = {ord(m): np.array(self._encode([m])[0], np.int32) for m in ".,"}
        self.split_marks = all(len(x) == 1 for x in self.marks.values())
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of the words."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        found: list = [None] * len(words)
        groups = [plain[lo : lo + 200] for lo in range(0, len(plain), 200)]
        other = [i for i, w in enumerate(words) if not w.isalpha()]
        for group, ids in zip(groups, self._encode([" ".join([words[i] for i in g]) for g in groups]) if groups else [], strict=True):
            ids = np.array(ids, np.int32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group):
                for i, part in zip(group, np.split(ids, cut[:-1]), strict=True):
                    found[i] = part
            else:  # a letter that the file treats otherwise
                other += group
        for i, ids in zip(other, self._encode([words[i] for i in other]) if other else [], strict=True):
            found[i] = np.array(ids, np.int32)
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.array([len(x) for x in found], np.int64)

    def _learn(self, w: Words, h: np.ndarray, which: np.ndarray) -> None:
        """Add the words at the places `which`, whose hashes are distinct and not known."""
        raw, start, end = w.data.tobytes(), w.start[which].tolist(), w.end[which].tolist()
        flat, lens = self._coded([raw[a:b].decode("utf-8") for a, b in zip(start, end, strict=True)])
        base = int(self.at[-1])
        if base + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:base], np.zeros(max(len(self.ids), len(flat)), np.int32)])
        self.ids[base : base + len(flat)] = flat
        self.at = np.concatenate([self.at, base + np.cumsum(lens)])
        self.index.add(h[which])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts (their UTF-8 bytes and offsets) and each text's count."""
        w = Words(data, offsets)
        last, before = data[w.end - 1], data[np.maximum(w.end - 2, 0)]
        marked = np.zeros(len(w), bool)
        if self.split_marks:
            marked = ((last == 46) | (last == 44)) & (w.end - w.start > 1) & _ALNUM[before]
        w.end = w.end - marked
        h = w.hashes(fold=True)
        k = self.index.find(h)
        new = np.flatnonzero(k < 0)
        if len(new):
            if self.index.size > CACHE_WORDS:
                self._clear()
                new = np.arange(len(h))
            _, one = np.unique(h[new], return_index=True)
            self._learn(w, h, new[one])
            k = self.index.find(h)
        n = self.at[k + 1] - self.at[k]
        ends = np.cumsum(n + marked)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        stem = np.ones(len(flat), bool)
        stem[ends[marked] - 1] = False
        flat[stem] = gathered(self.ids, self.at[k], n) if len(k) else 0
        for byte, ids in self.marks.items():
            flat[ends[marked & (last == byte)] - 1] = ids[0]
        total = np.concatenate([[0], ends])
        return flat, np.diff(total[w.first])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int, key: str = "doc_id", text: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Encode every text, append end_id, and write the ids in ascending key order below `folder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        bits = bits_for(max(enc.size, end_id + 1))
        shard, ordinal = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys_all = np.array([NULL_KEY if k is None else k for k in batch.column(0).to_pylist()], np.int64)
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                flat, lens = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(lens)
                ids = np.insert(flat.astype(np.int64), ends, end_id)
                lens = lens + 1
                # A longer slice than frame_ids is one long document as a rule; its frames share the key.
                for lo in range(0, max(1, len(ids)), frame_ids):
                    hi = min(len(ids), lo + frame_ids)
                    stop = np.cumsum(lens)
                    part = np.minimum(stop, hi) - np.maximum(stop - lens, lo)
                    here = part > 0
                    frame = make_frame(shard, ordinal, keys_all[i:j][here], part[here], ids[lo:hi], bits, more=not (stop == hi).any())
                    ordinal += 1
                    yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["frame"])

    ordered = df.select(key, text).repartitionByRange(parts, F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    made = ordered.mapInArrow(run, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", FRAME_END).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: shard, place in it, doc_id, n_tokens, ids_crc32, `before` (ids before it in its shard)
    and, at the shard's last document, total (ids of the shard)."""
    names = ["shard", "place", "doc_id", "n_tokens", "ids_crc32", "before", "total"]

    def documents(data: bytes) -> Iterator[list]:
        place, before, row, going_on = 0, 0, None, False
        for f in frames(data):
            ids, at = f.ids().astype("<u4"), 0
            for k, n in zip(f.keys.tolist(), f.lens.tolist(), strict=True):
                part = ids[at : at + n].tobytes()
                at += n
                if going_on:
                    row[3] += n
                    row[4] = zlib.crc32(part, row[4])
                else:
                    if row is not None:
                        yield row
                    row = [f.shard, place, None if k == NULL_KEY else k, n, zlib.crc32(part), before, None]
                    place += 1
                before += n
                going_on = False
            going_on = bool(f.open)
        if row is not None:
            row[6] = before
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = documents(raw.as_py())
                while chunk := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk, strict=True)], names=names)

    content = spark.read.format("binaryFile").load(folder).select("content")
    return content.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def with_starts(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32. One row a shard goes through the window: as many as there are files."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = docs.where("total IS NOT NULL").select("shard", "total")
    shards = shards.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return docs.join(shards, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
