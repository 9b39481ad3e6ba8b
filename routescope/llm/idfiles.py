"""Token-id files: every document compressed on its own under one shared dictionary.

A data set is a folder of shards and a dictionary. A shard holds, one after another, the
zstandard frames of its documents' ids, then an index of (doc_id, place, length, n_tokens)
per document, then a footer with the dictionary's hash, the count and the place of the index.
So a short document is read by one seek and decompressed with the dictionary, alone.

Ids are little-endian unsigned 16-bit integers if the vocabulary fits, else 32-bit. The
dictionary is trained on the ids of at most ``SAMPLE`` documents, those first by a hash of
the id, of each at most ``SAMPLE_IDS`` ids; it shapes sizes, never contents. Every shard is
written under a name of its attempt and then moved in place, so a task may be run again.

Documents go to shards by ascending doc_id, rows of equal id by text, null ids first; empty
and null texts hold the end id alone. Texts are encoded by the tokenizers library piece by
piece between spaces and line breaks, where neither the normaliser nor a token of a
vocabulary that drops white space can reach across; other vocabularies get whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer, pre_tokenizers

from routescope.session import qualified, ship_package

MAGIC = b"rsids001"
ENTRY = "<?qQQQ"  # has an id, doc_id, place, length, n_tokens
FOOTER = "<8s32sBQQ"  # magic, dictionary hash, bytes an id, documents, place of the index
SAMPLE, SAMPLE_IDS, DICTIONARY = 2000, 4096, 112_640
LEVEL = 3
KEPT, KEPT_CHARS = 1_000_000, 16_000_000  # pieces of text remembered by a worker, and their length in all
CLOSING = ".,;:!?|#$%&*"
#: Composed letters with a single small form: neither NFC nor lowering depends on what stands around them.
LATIN = re.compile("[\x00-\u012f]*")
END_ID = 2


class Encoder:
    """Ids of whole texts, with a memory of the pieces between spaces."""

    def __init__(self, vocabulary_json: str, end_id: int):
        self.tokenizer = Tokenizer.from_str(vocabulary_json)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.pieces = drops_spaces(vocabulary_json)
        reserved = [re.escape(t["content"]) for t in json.loads(vocabulary_json).get("added_tokens") or []]
        self.reserved = re.compile("|".join(reserved) or r"(?!)", re.IGNORECASE)
        self.known: dict[str, bytes] = {}
        self.held = 0
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {i: alphabet.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x130)}
        self.one = [np.array([i], self.kind).tobytes() for i in range(size)] if self.pieces else []

    def bytes_of(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return [self._packed(e.ids) + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out, known = [], self.known
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            new = {w for w in words if w not in known}
            if new:
                size = sum(map(len, new))
                if len(known) + 3 * len(new) > KEPT or self.held + 2 * size > KEPT_CHARS:
                    known.clear()
                    new = set(words)
                    self.held, size = 0, sum(map(len, new))
                self.held += 2 * size
                self._learn(new)
            out.append(b"".join([known[w] for w in words]) + self.end)
        return out

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of ``words``. The vocabulary knows no capitals, and marks after a letter or digit
        begin a token of their own, so many new words are a known one with another ending or case. Words that
        may hold a reserved token are taken as they are, for those are found before any lowering.

        Lower-case Latin words go straight to the merges, spelled in the byte alphabet, as no other step
        before them would change one."""
        known, one, merges, spelled = self.known, self.one, self.tokenizer.model.tokenize, self.spelled
        reserved = self.reserved.search(" ".join(words))
        for word in words:
            if not LATIN.fullmatch(word) or (reserved and self.reserved.search(word)):
                known[word] = self._slowly(word)
                continue
            low = word.lower()
            core = low.rstrip(CLOSING)
            if not core or not core[-1].isalnum():
                core = low
            tail = low[len(core) :]
            ids = known.get(core)
            if ids is None:
                if core.isalpha():
                    ids = b"".join([one[t.id] for t in merges(core.translate(spelled))])
                else:
                    ids = self._slowly(core)
                known[core] = ids
            if tail:
                if tail not in known:
                    known[tail] = self._slowly(tail)
                ids += known[tail]
            known[word] = ids

    def _slowly(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder_of(vocabulary_json: str, end_id: int) -> Encoder:
    """The worker's own, with its memory, for all tasks that it runs."""
    key = (zlib.crc32(vocabulary_json.encode()), end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary_json, end_id)
    return _encoders[key]


def drops_spaces(vocabulary_json: str) -> bool:
    """Whether the vocabulary's splitter leaves white space out and parts letters from marks, after lower-casing,
    with nothing but the byte alphabet between it and the merges,
    and no reserved token holds white space or looks at its surroundings."""
    spec = json.loads(vocabulary_json)
    lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
    alone = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]))
                for t in spec.get("added_tokens") or [])
    mapped = all(s.get("type") == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    return lowers and splits and mapped and r"[^\s" in first["pattern"].get("Regex", "") and alone


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _ordered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def trained(docs: DataFrame, vocabulary_json: str, end_id: int = END_ID) -> bytes:
    """A dictionary from a bounded sample, made in one task; empty if the sample is too small for one."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = _ordered(docs).join(ids, "doc_id")

    def encode(batches):
        encoder = encoder_of(vocabulary_json, end_id)
        for batch in batches:
            for text in batch.column("text"):
                ids = encoder.bytes_of([text.as_py()])[0]
                n = len(ids) // encoder.kind.itemsize
                at = zlib.crc32(ids) % max(1, n - SAMPLE_IDS + 1) * encoder.kind.itemsize  # a place as good as any
                yield pa.RecordBatch.from_arrays([pa.array([ids[at : at + SAMPLE_IDS * encoder.kind.itemsize]], pa.binary())], ["ids"])

    def train(batches):
        parts = [x for batch in batches for x in batch.column("ids").to_pylist()][: 2 * SAMPLE]
        try:
            out = zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
        except zstandard.ZstdError:
            out = b""
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["dictionary"])

    ship_package(docs.sparkSession)
    encoded = sample.select("text").mapInArrow(encode, "ids binary").orderBy("ids")
    return bytes(encoded.coalesce(1).mapInArrow(train, "dictionary binary").first()["dictionary"])


def write(docs: DataFrame, folder: str, vocabulary_file: str, end_id: int = END_ID) -> DataFrame:
    """Writes the data set into ``folder``; (shard, path, documents, tokens) of its shards, in order."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    with open(vocabulary_file) as f:
        vocabulary = f.read()
    dictionary = trained(docs, vocabulary, end_id)
    where, path = _place(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast((vocabulary, dictionary))  # both of fixed size

    def run(batches):
        vocabulary, dictionary = shared.value
        encoder = encoder_of(vocabulary, end_id)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if own:
            own.precompute_compress(level=LEVEL)  # else every document would load the dictionary anew
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        where, path = _place(folder)
        name = uuid.uuid4().hex
        index, place, total, shard, out = [], 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column("shard")[0].as_py()
                out = where.open_output_stream(f"{path}/writing-{name}")
            texts = batch.column("text")
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = encoder.bytes_of([text.as_py()])[0]
                frame = squeeze.compress(ids)
                out.write(frame)
                n = len(ids) // encoder.kind.itemsize
                index.append(struct.pack(ENTRY, doc is not None, doc or 0, place, len(frame), n))
                place += len(frame)
                total += n
        if out is None:
            return
        out.write(b"".join(index))
        out.write(struct.pack(FOOTER, MAGIC, hashlib.sha256(dictionary).digest(), encoder.kind.itemsize, len(index), place))
        out.close()
        final = f"{path}/shard-{shard:06d}"
        where.move(f"{path}/writing-{name}", final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([final]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())],
            ["shard", "path", "documents", "tokens"])

    ship_package(spark)
    # ranged by a digest: the sample that finds the ranges goes to the driver, and whole texts must not
    keyed = _ordered(docs).withColumn("digest", F.unhex(F.md5("text")))
    sorted_rows = keyed.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").drop("digest")
    placed = sorted_rows.withColumn("shard", F.spark_partition_id().cast("bigint"))
    schema = "shard bigint, path string, documents bigint, tokens bigint"
    # the shards are few: a row for each task that wrote one
    return spark.createDataFrame(placed.mapInArrow(run, schema).collect(), schema).orderBy("shard")


class Shard:
    """A shard opened for reading documents one at a time."""

    def __init__(self, path: str, folder: str):
        where, at = _place(path)
        self.file = where.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(FOOTER))
        magic, digest, width, self.documents, self.index_at = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        store, base = _place(folder)
        with store.open_input_stream(f"{base}/dictionary") as f:
            dictionary = f.read()
        if magic != MAGIC or hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{path}: not a shard of this dictionary")
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def entry(self, i: int) -> tuple:
        self.file.seek(self.index_at + i * struct.calcsize(ENTRY))
        return struct.unpack(ENTRY, self.file.read(struct.calcsize(ENTRY)))

    def ids(self, entry: tuple) -> np.ndarray:
        _, _, place, length, n = entry
        self.file.seek(place)
        return np.frombuffer(self.unpack.decompress(self.file.read(length), max_output_size=n * self.kind.itemsize), self.kind)

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id, by halving the index."""
        lo, hi = 0, self.documents
        while lo < hi:
            mid = (lo + hi) // 2
            has, own, *_ = self.entry(mid)
            lo, hi = (mid + 1, hi) if not has or own < doc_id else (lo, mid)
        if lo == self.documents or self.entry(lo)[:2] != (True, doc_id):
            return None
        return self.ids(self.entry(lo))


def read(spark: SparkSession, folder: str, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files.

    Starts run over all shards in order: a sum over a row per shard, then one within each."""
    folder = qualified(spark, folder)
    before = F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    todo = shards.select("path", before.alias("before")).repartition(max(1, shards.count()), "path")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                shard = Shard(path, folder)
                for a in range(0, shard.documents, 1024):
                    rows, lists = [], []
                    for i in range(a, min(a + 1024, shard.documents)):
                        entry = shard.entry(i)
                        ids = shard.ids(entry).astype("<u4")
                        rows.append((entry[1] if entry[0] else None, start, len(ids), zlib.crc32(ids.tobytes())))
                        lists.append(ids.astype(np.int32) if with_ids else None)
                        start += len(ids)
                    cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int32()))] * with_ids,
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    ship_package(spark)
    return todo.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
