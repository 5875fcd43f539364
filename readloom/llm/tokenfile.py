"""Token ids in binary files: each document compressed by itself with one shared zstandard dictionary.

A set of files is a folder with ``dictionary`` and shards in ascending order of document id. A shard holds a header
(magic, bytes an id takes, SHA-256 of the dictionary), one zstandard frame for each document's ids, little-endian, and
an index of fixed-width rows (doc_id, its null flag, offset of the frame, bytes, ids) with a footer that says where it
starts. A document is read with one seek into the index and one into the frames; a reader refuses a dictionary whose
hash isn't the header's. Numbers of ids before a shard are in the manifest that ``write`` returns.

Scale: texts move once, range-partitioned by id and sorted inside; ids are made and compressed after that, straight
into the shard of the partition. A shard is written under a name of its attempt and then renamed, and only a finished
task's manifest row names it, so lost executors and second attempts leave no half shard in the set. The dictionary
learns from about ``SAMPLE`` texts drawn by a hash, of each a stretch of at most ``STRETCH`` ids from a place that a hash draws too.
The driver sees these and a row for each shard. All ids of all texts are written.

Words between blanks and line ends are encoded once per worker and remembered (bounded): a token never holds a blank that follows
another character, so cutting there changes no id.

Defined cases: a null text is empty and has the end id only. Null doc_ids come first; rows with equal ids follow each
other by a hash of the text, then by text, and all are kept. An empty table gives no shard and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import GAP, id_text, looked_up, map_slices, materialise, new_path, scratch, ship, slices, table

MAGIC, END_ID = b"RLTOKEN1", 2
SAMPLE, STRETCH, DICTIONARY_BYTES, LEVEL = 1_000, 10_000, 64 << 10, 3
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
#: In the memory, goes before what has no blank before it.
_BARE = "\x01"
#: Fixed values of byte-level vocabularies: how a byte is written, and how text below U+0250 is split.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: chr(b if b in _PRINTED else 0x100 + k) for k, b in enumerate(sorted(set(range(256)) - _PRINTED))} | {b: chr(b) for b in _PRINTED}
_LETTERS, _NUMBERS, _BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[{1}]+| ?[{2}]+| ?[^{0}{1}{2}{3}]+|{3}|[{0}]+(?![^{0}{3}])|[{0}]+"
#: A full stop or comma that belongs to what is before it.
_GLUED = re.compile(r"[.,](?<![^\W_][.,])[ \n]")
_CUT = re.compile(r"(?<!\s) ")


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them. ``remember``: words kept in each of two generations.

    New words are split as the tokenizer would and go through the library's merges many at a time, in one long text
    with marks between them that nothing merges across; that costs a third of encoding each. Only words of up to 64
    characters below U+0250 go this way, of which every one's kind is beyond doubt; any other is encoded by itself."""

    def __init__(self, tokenizer_json: str, remember: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.young, self.old = Tokenizer.from_str(tokenizer_json), remember, {}, {}
        # The cut between blanks holds for byte-level splitting; any other tokenizer sees whole texts.
        made = json.loads(tokenizer_json)
        pre, model = made.get("pre_tokenizer") or {}, made["model"]
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.cut = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout") and not any(" " in x["content"] or "\n" in x["content"] or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in made.get("added_tokens", []))
        marks = self._unmerged(model["vocab"])[:2] if self.cut and not any(model.get(x) for x in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) else []
        self.marks = marks if len(marks) == 2 else None
        if self.marks:
            self.bare = Tokenizer.from_str(json.dumps(made | {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
            self.between_id, self.behind_id = (model["vocab"][_BYTES[ord(x)]] for x in self.marks)
            self.split = re.compile(_SPLIT.format(_BLANKS, _LETTERS, _NUMBERS, self.marks[1]))

    @staticmethod
    def _unmerged(vocabulary: dict[str, int]) -> list[str]:
        """Control characters that are in no piece but their own: nothing merges across them."""
        several = set("".join(piece for piece in vocabulary if len(piece) > 1))
        return [chr(b) for b in range(9) if _BYTES[b] in vocabulary and _BYTES[b] not in several and chr(b) not in (_BARE, GAP)]

    def _each(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of each word by itself."""
        if not self.marks:
            return self._alone([lead + w for w in words])
        out: list[bytes] = [b""] * len(words)
        alone, known = [], []
        every = "\n".join(words)
        odd = [x for x in (*self.marks, *self.added) if x in every]
        for k, w in enumerate(words):
            (known if (w.isascii() or max(w) < "\u0250") and len(w) <= 64 and not (odd and any(x in w for x in odd)) else alone).append(k)
        between, behind = self.marks
        for k in range(0, len(known), 4096):
            some = known[k : k + 4096]
            # The marks: one between the parts that the tokenizer splits a word into, another between words.
            parts = self.split.findall(behind.join([lead + words[i] for i in some]))
            ids = np.array(self.bare.encode_batch_fast([between.join(parts).encode("utf-8").decode("latin-1").translate(_BYTES)], add_special_tokens=False)[0].ids, dtype="<u4")
            ids = ids[ids != self.between_id]
            ends, raw = (np.flatnonzero(ids == self.behind_id) * 4).tolist(), ids.tobytes()
            if len(ends) != len(some) - 1:
                raise ValueError("the tokenizer doesn't keep the marks apart")
            for i, a, b in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(raw)]):
                out[i] = raw[a:b]
        for k, ids in zip(alone, self._alone([lead + words[k] for k in alone])):
            out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.cut:
            return self._alone(texts)
        out, lines, at = [b""] * len(texts), [], []
        for k, t in enumerate(texts):
            if _BARE in t or GAP in t:
                out[k] = self._alone([t])[0]
                continue
            plain = t.replace("\n", " ")
            if "  " in plain or plain[:1] == " " or plain[-1:] == " " or not plain.isprintable():
                # More than one sign of white space between two words, or one that is neither blank nor line end.
                line = _CUT.sub(GAP, t)
            else:
                # Line ends, and a full stop or comma after a letter or digit, stand by themselves: fewer words to remember.
                plain = t.replace("\n", f" {_BARE}\n {_BARE}")
                if not _GLUED.search(t):
                    plain = plain.replace(". ", f" {_BARE}. ").replace(", ", f" {_BARE}, ")
                line = plain.replace(" ", GAP)
            lines.append(_BARE + line)
            at.append(k)
        for k, ids in zip(at, looked_up(lines, self._remembered)):
            out[k] = ids.tobytes()
        return out

    def _alone(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 4096):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
        return out

    def _remembered(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, which are remembered: the older generation goes when the younger is full, so what is asked for often stays."""
        found = list(map(self.young.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(gaps, list(map(self.old.get, [words[k] for k in gaps]))):
            found[k] = ids
        new = [k for k in gaps if found[k] is None and words[k][:1] != _BARE]
        bare = [k for k in gaps if found[k] is None and words[k][:1] == _BARE]
        for some, made in ((new, self._each([words[k] for k in new], " ")), (bare, self._each([words[k][1:] for k in bare], ""))):
            for k, ids in zip(some, made):
                found[k] = ids
        if len(self.young) + len(gaps) > self.limit:
            self.old, self.young = self.young, {}
        if len(gaps) <= self.limit:
            self.young.update((words[k], found[k]) for k in gaps if len(words[k]) <= 64)
        return found


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One for each Python worker; what it remembers outlives a task."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def packed(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype(f"<u{width}").tobytes()


def stretch(ids: bytes) -> bytes:
    """Of many ids a stretch of STRETCH, from a place that depends on them."""
    n = len(ids) // 4
    at = 4 * (zlib.crc32(ids) % max(1, n - STRETCH + 1))
    return ids[at : at + 4 * STRETCH]


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their own bytes, or nothing."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


class ShardWriter:
    def __init__(self, sink, dictionary: bytes, width: int):
        self.sink, self.width, self.rows, self.at, self.ids = sink, width, [], 0, 0
        own = _dictionary(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=own) if own else zstandard.ZstdCompressor(level=LEVEL)
        self._put(MAGIC + struct.pack("<I", width) + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(packed(ids, self.width))
        self.rows.append((doc_id or 0, doc_id is None, self.at, len(frame), len(ids) // 4))
        self.ids += len(ids) // 4
        self._put(frame)

    def close(self) -> None:
        at = self.at
        self._put(np.array(self.rows, dtype=_INDEX).tobytes())
        self._put(struct.pack("<QQQ", at, len(self.rows), self.ids) + MAGIC)


class ShardReader:
    def __init__(self, source, size: int, dictionary: bytes):
        self.source = source
        head = self._get(0, 44)
        foot = self._get(size - 32, 32)
        if head[:8] != MAGIC or foot[24:] != MAGIC:
            raise ValueError("not a token shard, or cut short")
        if head[12:44] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.width = struct.unpack("<I", head[8:12])[0]
        at, n, self.ids = struct.unpack("<QQQ", foot[:24])
        self.index = np.frombuffer(self._get(at, n * _INDEX.itemsize), dtype=_INDEX)
        own = _dictionary(dictionary)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def document(self, k: int) -> np.ndarray:
        row = self.index[k]
        return np.frombuffer(self.decompressor.decompress(self._get(int(row["offset"]), int(row["bytes"])), max_output_size=max(1, int(row["ids"]) * self.width)), dtype=f"<u{self.width}").astype("<u4")


def filesystem(path: str):
    """pyarrow's file system for a path of the shared folder, and the path in it."""
    from pyarrow import fs

    # Hadoop's names of one store are several; pyarrow knows it by one.
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path) if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?=[^/])", "file:///", path)


def write(docs: DataFrame, tokenizer_json: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> tuple[str, list]:
    """Writes the shards; returns the folder and the manifest: (shard, documents, ids) in order."""
    spark = docs.sparkSession
    ship(spark)
    folder = _uri(folder or new_path(spark, "tokens"))
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    content = spark.sparkContext.broadcast(tokenizer_json)
    vocabulary = json.loads(tokenizer_json)
    width = 2 if max([*vocabulary["model"]["vocab"].values(), *(x["id"] for x in vocabulary.get("added_tokens", [])), end_id]) < 1 << 16 else 4
    n = rows.count()
    drawn = rows.filter(F.xxhash64("text", "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) < min(1.0, SAMPLE / max(1, n)) * float(1 << 53)).select("text").distinct()

    def serialised(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([packed(stretch(x), width) for x in encoder(content.value).encode(batch.column(0).to_pylist())], pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in map_slices(drawn, serialised, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(2 * SAMPLE).collect())
    dictionary = make_dictionary(samples)
    system, place = filesystem(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/dictionary") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, task = None, TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        system, place = filesystem(folder)
        draft = f"{place}/.draft-{number}-{attempt}"
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    sink = system.open_output_stream(draft)
                    writer = ShardWriter(sink, shared.value, width)
                end = np.array([end_id], dtype="<u4").tobytes()
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(content.value).encode(part.column(1).to_pylist())):
                    writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            sink.close()
            name = f"shard-{number:08d}-{attempt}"
            system.move(draft, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([len(writer.rows)], pa.int64()), pa.array([writer.ids], pa.int64())], names=["number", "shard", "documents", "ids"])

    manifest = materialise(ordered.mapInArrow(run, "number int, shard string, documents bigint, ids bigint"), "manifest", f"{folder}/manifest")
    return folder, [(r.shard, r.documents, r.ids) for r in manifest.orderBy("number").collect()]


def read(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    starts, before = [], 0
    for shard, documents, ids in manifest:
        starts.append((shard, before))
        before += ids
    if not starts:
        return spark.createDataFrame([], schema)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        dictionary = None
        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns)):
                if dictionary is None:
                    with system.open_input_file(f"{place}/dictionary") as f:
                        dictionary = f.read()
                with system.open_input_file(f"{place}/{shard}") as f:
                    reader = ShardReader(io.BufferedReader(f, 1 << 20), f.size(), dictionary)
                    for k in range(0, len(reader.index), 10_000):
                        rows = reader.index[k : k + 10_000]
                        crcs = [zlib.crc32(reader.document(k + i).tobytes()) for i in range(len(rows))]
                        counts = rows["ids"].astype(np.int64)
                        at = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64(), mask=rows["null"].astype(bool)), pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(starts, "shard string, start bigint").repartition(len(starts))
    return shards.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    folder, manifest = write(table(spark, sf_dir, "documents"), content)
    return read(spark, folder, manifest)
