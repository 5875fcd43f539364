"""BAM files as a Python data source: ``spark.read.format("bam")`` and ``df.write.format("bam")``.

BGZF blocks are inflated by zlib. A large file is cut at byte offsets; each task finds the first block from its offset
on, and the first record in it by looking for a stretch of plausible records, so one file feeds many tasks. Only the
columns of the schema that is asked for are decoded, and rows go to Spark as Arrow batches. Options: ``split_bytes``
(32 MB); for writing ``header``, ``level`` of compression, and ``single`` for one file in place of a folder of parts: tasks compress their records
to drafts, and as BGZF blocks can be set end to end, the driver only copies bytes. Paths are opened through pyarrow's file systems.
"""

from __future__ import annotations

import re
import shutil
import struct
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from readloom.sources.files import filesystem, in_order

SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,struct<type:string,value:string>>, file string, ord bigint"
SPLIT_BYTES, LEAST_SPLIT = 32 << 20, 1 << 20
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Bases to the digits of their codes and back; anything else is N.
_FROM_HEX = str.maketrans("0123456789abcdef", _BASES)
_TO_HEX = {**{i: "f" for i in range(1 << 7)}, **{ord(c): f"{i:x}" for i, c in enumerate(_BASES)}, **{ord(c.lower()): f"{i:x}" for i, c in enumerate(_BASES)}}
_QUALITY = bytes(min(q + 33, 255) for q in range(256))
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
#: Effort of compression, 1 to 9.
LEVEL = 3
#: Rows of an Arrow batch.
BATCH = 4096
_TAGS = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))
_TYPES = {"flag": pa.int32(), "pos": pa.int64(), "mapq": pa.int32(), "pnext": pa.int64(), "tlen": pa.int64(), "tags": _TAGS, "ord": pa.int64()}
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_NUMBER = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def list_files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, place = filesystem(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.Directory:
        found = [x for x in system.get_file_info(fs.FileSelector(place)) if x.path.endswith(".bam")]
        prefix = path.rstrip("/")
        return sorted((f"{prefix}/{x.base_name}", x.size) for x in found)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(path, info.size)]


def block_size(head: bytes) -> int:
    """Bytes of the BGZF block that begins here; 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 4 <= 12 + extra and at + 6 <= len(head):
        a, b, n = head[at], head[at + 1], struct.unpack("<H", head[at + 2 : at + 4])[0]
        if (a, b, n) == (66, 67, 2):
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + n
    return 0


def inflate(block: bytes) -> bytes:
    extra = struct.unpack("<H", block[10:12])[0]
    return zlib.decompress(block[12 + extra : -8], -15)


def blocks(f, size: int, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from an offset on, at which one begins."""
    while at < size:
        f.seek(at)
        n = block_size(head := f.read(64))
        if not n:
            raise ValueError(f"no BGZF block at byte {at}")
        yield at, inflate(head[:n] if n <= len(head) else head + f.read(n - len(head)))
        at += n


def next_block(f, size: int, at: int) -> int:
    """Offset of the first block from ``at`` on: one that is followed by another, or ends the file."""
    f.seek(at)
    window = f.read((1 << 17) + 64)
    k = window.find(b"\x1f\x8b\x08\x04")
    while k >= 0:
        n = block_size(window[k : k + 64])
        if n:
            f.seek(at + k + n)
            if at + k + n == size or block_size(f.read(64)):
                return at + k
        k = window.find(b"\x1f\x8b\x08\x04", k + 1)
    return size


def read_header(f, size: int) -> tuple[str, list[tuple[str, int]], int, int]:
    """Header text, references, and where the records begin: block and byte in it."""
    data, starts = b"", []

    def parsed():
        if len(data) < 8:
            return None
        text_end = 8 + struct.unpack("<i", data[4:8])[0]
        if len(data) < text_end + 4:
            return None
        n, at, refs = struct.unpack("<i", data[text_end : text_end + 4])[0], text_end + 4, []
        for _ in range(n):
            if len(data) < at + 4:
                return None
            k = struct.unpack("<i", data[at : at + 4])[0]
            if len(data) < at + 8 + k:
                return None
            refs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack("<i", data[at + 4 + k : at + 8 + k])[0]))
            at += 8 + k
        return data[8:text_end].rstrip(b"\0").decode(), refs, at

    for offset, content in blocks(f, size):
        starts.append((offset, len(data)))
        data += content
        if data[:4] != b"BAM\1":
            raise ValueError("not a BAM file")
        if found := parsed():
            text, refs, at = found
            offset, before = max((x for x in starts if x[1] <= at), key=lambda x: x[1])
            return text, refs, offset, at - before
    raise ValueError("the BAM header is cut short")


def plausible(data: bytes, at: int, n_refs: int) -> int:
    """End of the record that may begin here; 0 if it can't; -1 if that can't be told."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", data[at : at + 36])
    need = 32 + name + 4 * n_ops + (n_seq + 1) // 2 + n_seq if n_seq >= 0 else 1 << 40
    if size < need or size > 1 << 28 or not name or not -1 <= ref < n_refs or not -1 <= mate < n_refs or pos < -1 or mate_pos < -1:
        return 0
    end = at + 36 + name
    if end <= len(data) and (data[end - 1] != 0 or not all(33 <= c <= 126 for c in data[at + 36 : end - 1])):
        return 0
    if end + 4 * n_ops <= len(data) and any(data[k] & 15 > 8 for k in range(end, end + 4 * n_ops, 4)):
        return 0
    return at + 4 + size


def first_record(data: bytes, n_refs: int, whole: bool) -> int:
    """Where the first record begins: a place from which five records in a row are plausible, or all up to the end."""
    for at in range(len(data)):
        k, n = at, 0
        while n < 5:
            end = plausible(data, k, n_refs)
            if end <= 0 or end > len(data):
                break
            k, n = end, n + 1
        if n == 5 or n and (k == len(data) if whole else end != 0):
            return at
    return len(data)


def _tags(data: bytes) -> dict:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in _NUMBER:
            n = struct.calcsize(_NUMBER[kind])
            value, shown, at = struct.unpack(_NUMBER[kind], data[at : at + n])[0], "f" if kind == "f" else "i", at + n
            value = f"{value:g}" if kind == "f" else str(value)
        elif kind == "A":
            value, shown, at = chr(data[at]), "A", at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, shown, at = data[at:end].decode(), kind, end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack("<i", data[at + 1 : at + 5])[0]
            step = struct.calcsize(_NUMBER[sub])
            raw = struct.unpack(f"<{n}{_NUMBER[sub][1]}", data[at + 5 : at + 5 + n * step])
            value, shown, at = ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in raw)]), "B", at + 5 + n * step
        else:
            raise ValueError(f"unknown tag type {kind!r}")
        out.setdefault(name, (shown, value))
    return out


def decode_record(data: bytes, refs: list[tuple[str, int]], wanted: frozenset[str]) -> dict:
    """The wanted fields of a record."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + n_name
    after = at + 4 * n_ops
    quality = after + (n_seq + 1) // 2
    out = {"flag": flag, "pos": pos + 1, "mapq": mapq, "pnext": mate_pos + 1, "tlen": tlen, "rname": refs[ref][0] if ref >= 0 else "*", "rnext": "*" if mate < 0 else "=" if mate == ref else refs[mate][0]}
    if "qname" in wanted:
        out["qname"] = data[32 : at - 1].decode()
    if "seq" in wanted:
        out["seq"] = data[after:quality].hex().translate(_FROM_HEX)[:n_seq] or "*"
    if "qual" in wanted:
        out["qual"] = data[quality : quality + n_seq].translate(_QUALITY).decode("ascii") if n_seq and data[quality] != 255 else "*"
    if "cigar" in wanted or "tags" in wanted:
        ops = struct.unpack_from(f"<{n_ops}I", data, at)
        long = n_ops == 2 and ops[0] & 15 == 4 and ops[0] >> 4 == n_seq  # more than 65,535 operations
        tags = _tags(data[quality + n_seq :]) if long or "tags" in wanted else {}
        if long and "CG" in tags:
            ops = tuple(int(x) for x in tags.pop("CG")[1].split(",")[1:])
        out["cigar"] = "".join([f"{x >> 4}{_OPS[x & 15]}" for x in ops]) or "*"
        out["tags"] = [(k, {"type": t, "value": v}) for k, (t, v) in tags.items()]
    return out


def _bin(start: int, end: int) -> int:
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def encode_record(row: dict, numbers: dict[str, int]) -> bytes:
    """row: the fields of a read; tags as (name, type, value)."""
    number = lambda n: numbers[n] if n not in (None, "*") else -1
    ref = number(row["rname"])
    mate = ref if row["rnext"] == "=" else number(row["rnext"])
    ops = [(int(n), o) for n, o in _CIGAR.findall(row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    at = (row["pos"] or 0) - 1
    tags = b""
    for k, kind, value in sorted(row["tags"] or ()):
        if kind == "i":
            tags += k.encode() + (b"i" + struct.pack("<i", int(value)) if -(1 << 31) <= int(value) < 1 << 31 else b"I" + struct.pack("<I", int(value)))
        elif kind == "f":
            tags += k.encode() + b"f" + struct.pack("<f", float(value))
        elif kind == "A":
            tags += k.encode() + b"A" + value.encode()
        elif kind == "B":
            sub, *items = value.split(",")
            tags += k.encode() + b"B" + sub.encode() + struct.pack(f"<i{len(items)}{_NUMBER[sub][1]}", len(items), *((float if sub == "f" else int)(x) for x in items))
        else:
            tags += k.encode() + kind.encode() + value.encode() + b"\0"
    packed_ops = [n << 4 | _OPS.index(o) for n, o in ops]
    if len(packed_ops) > 65535:
        tags += b"CGBI" + struct.pack(f"<i{len(packed_ops)}I", len(packed_ops), *packed_ops)
        packed_ops = [len(seq) << 4 | 4, span << 4 | 3]
    raw = bytes.fromhex(seq.translate(_TO_HEX) + "0" * (len(seq) % 2))
    scores = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(c - 33 for c in row["qual"].encode("ascii"))
    name = (row["qname"] or "*").encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, at, len(name), row["mapq"] or 0, _bin(max(at, 0), max(at, 0) + span), len(packed_ops), row["flag"] or 0, len(seq), mate, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body += name + struct.pack(f"<{len(packed_ops)}I", *packed_ops) + raw + scores + tags
    return struct.pack("<i", len(body)) + body


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as ``encode_record`` takes them; columns are turned into lists one by one."""
    names, columns = batch.schema.names, []
    for name, column in zip(names, batch.columns):
        if not pa.types.is_map(column.type):
            columns.append(column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist())
            continue
        at, flat = column.offsets.to_pylist(), [x.to_numpy(zero_copy_only=False).tolist() for x in (column.keys, column.items.field("type"), column.items.field("value"))]
        every = list(zip(*flat))
        columns.append([every[a:b] for a, b in zip(at, at[1:])])
    return (dict(zip(names, row)) for row in zip(*columns))


def deflate(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class BgzfSink:
    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.level, self.held = sink, level, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= 65280:
            self.sink.write(deflate(bytes(self.held[:65280]), self.level))
            del self.held[:65280]

    def close(self, end: bool = True) -> None:
        if self.held:
            self.sink.write(deflate(bytes(self.held), self.level))
        if end:
            self.sink.write(_EOF)
        self.sink.close()


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, number: int):
        self.path, self.start, self.end, self.number = path, start, end, number


class BamReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.split, self.columns = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), columns

    def partitions(self):
        out = []
        for path, size in list_files(self.path):
            out += [(path, a, min(a + self.split, size)) for a in range(0, max(size, 1), self.split)]
        return [_Part(*x, i) for i, x in enumerate(out)]

    def read(self, part: _Part):
        """Arrow batches of the columns that are asked for."""
        wanted, rows = frozenset(self.columns), []
        schema = pa.schema([(c, _TYPES.get(c, pa.string())) for c in self.columns])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in self.columns], schema=schema)

        for data, refs, order in self._records(part):
            row = decode_record(data, refs, wanted)
            row["file"], row["ord"] = part.path, order
            rows.append(row)
            if len(rows) >= BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()

    def _records(self, part: _Part) -> Iterator[tuple[bytes, list, int]]:
        system, place = filesystem(part.path)
        with system.open_input_file(place) as f:
            size = f.size()
            _, refs, block, within = read_header(f, size)
            # A record belongs to the part in which its first byte's block begins.
            start = block if part.start <= block else next_block(f, size, part.start)
            if part.end <= block or start >= part.end:
                return
            data, marks, found, n = b"", [], part.start <= block, 0
            at = within if found else 0
            for offset, content in blocks(f, size, start):
                marks.append((len(data), offset))
                data += content
                if not found:
                    if len(data) < 1 << 18 and offset + 1 < size and len(marks) < 8 and not _last(f, size, offset):
                        continue
                    at, found = first_record(data, len(refs), _last(f, size, offset)), True
                while at + 4 <= len(data):
                    end = at + 4 + struct.unpack("<i", data[at : at + 4])[0]
                    if max(x for x in marks if x[0] <= at)[1] >= part.end:
                        return
                    if end > len(data):
                        break
                    yield data[at + 4 : end], refs, (part.number << 33) + n
                    n, at = n + 1, end
                keep = max(k for k, x in enumerate(marks) if x[0] <= at)
                base = marks[keep][0]
                data, at, marks = data[base:], at - base, [(x - base, y) for x, y in marks[keep:]]
                if at == len(data) and offset >= part.end:
                    return


def _last(f, size: int, offset: int) -> bool:
    f.seek(offset)
    after = offset + block_size(f.read(64))
    return after >= size or after + len(_EOF) >= size


def header_block(text: str) -> tuple[bytes, dict[str, int]]:
    """The head of a BAM file, and the numbers of the references in the @SQ lines."""
    refs = []
    for line in text.splitlines():
        if line.startswith("@SQ"):
            f = dict(x.split(":", 1) for x in line.split("\t")[1:])
            refs.append((f["SN"], int(f["LN"])))
    raw = (text.rstrip("\n") + "\n" if text else "").encode()
    out = b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out, {n: i for i, (n, _) in enumerate(refs)}


class BamWriter(DataSourceArrowWriter):
    """A folder with a file for each task, each with the header; or one file (``single``). ``header`` holds its text, @SQ
    lines included. Drafts get their names when the job commits: names rise with the time, so rows that are appended come
    after those that are there."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options.get("header", ""), overwrite
        self.level = int(options.get("level", LEVEL))
        self.single, self.job = str(options.get("single", "")).lower() == "true", f"{time.time_ns():020d}"
        self.folder = f"{self.path}.drafts-{self.job}" if self.single else self.path

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        head, numbers = header_block(self.header)
        system, place = filesystem(self.folder)
        system.create_dir(place, recursive=True)
        draft = f"{place}/.draft-{self.job}-{task.partitionId()}-{task.taskAttemptId()}"
        sink = BgzfSink(system.open_output_stream(draft), self.level)
        if not self.single:
            sink.write(head)
        for batch in batches:
            for row in rows_of(batch):
                sink.write(encode_record(row, numbers))
        sink.close(not self.single)
        out = WriterCommitMessage()
        out.draft, out.number = draft, task.partitionId()
        return out

    def commit(self, messages) -> None:
        system, place = filesystem(self.folder)
        drafts = sorted((m.number, m.draft) for m in messages if m)
        if not self.single:
            before = [x.path for x in self._parts(system, place)] if self.overwrite else []
            for number, draft in drafts:
                system.move(draft, f"{place}/part-{self.job}-{number:05d}.bam")
            for path in before:
                system.delete_file(path)
            return
        _, target = filesystem(self.path)
        with system.open_output_stream(f"{target}.draft-{self.job}") as out:
            sink = BgzfSink(out)
            sink.write(header_block(self.header)[0])
            if sink.held:
                out.write(deflate(bytes(sink.held)))
            for _, draft in drafts:
                with system.open_input_stream(draft) as f:
                    shutil.copyfileobj(f, out, 1 << 22)
            out.write(_EOF)
        from pyarrow import fs

        if system.get_file_info(target).type == fs.FileType.Directory:
            system.delete_dir(target)
        system.move(f"{target}.draft-{self.job}", target)
        if drafts:
            system.delete_dir(place)

    @staticmethod
    def _parts(system, place: str) -> list:
        from pyarrow import fs

        return [x for x in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if x.path.endswith(".bam")]

    def abort(self, messages) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            if m:
                system.delete_file(m.draft)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options, schema.names)

    def writer(self, schema, overwrite) -> BamWriter:
        return BamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamDataSource)


def even_split(size: int, cores: int) -> int:
    """Bytes for each task: ``SPLIT_BYTES``, or less, so that every core has several tasks of about one size."""
    return min(SPLIT_BYTES, max(LEAST_SPLIT, -(-size // (4 * cores))))


def read_bam(spark: SparkSession, path: str, split_bytes: int | None = None, columns: list[str] | None = None):
    """Reads of a file or a folder; with ``columns`` only these are decoded."""
    register(spark)
    split_bytes = split_bytes or even_split(sum(n for _, n in list_files(path)), spark.sparkContext.defaultParallelism)
    kinds = {x.split(" ", 1)[0]: x for x in re.split(r", (?=\w+ )", SCHEMA)}
    return spark.read.format("bam").schema(", ".join(kinds[c] for c in columns or kinds)).option("split_bytes", split_bytes).load(path)


def bam_header(path: str) -> str:
    path = list_files(path)[0][0]
    system, place = filesystem(path)
    with system.open_input_file(place) as f:
        return read_header(f, f.size())[0]


def write_bam(reads, path: str, header: str, order: str | None = "ord", single: bool = False, append: bool = False) -> None:
    """Writes reads in input order, part by part in a folder; ``single`` makes one file. What is there is replaced, unless parts are to be added (``append``)."""
    if single and append:
        raise ValueError("reads are added to a folder of parts, not to one file")
    register(reads.sparkSession)
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")][:12]
    ordered = in_order(reads, order) if order else reads
    ordered.select(*names).write.format("bam").mode("append" if append else "overwrite").option("header", header).option("single", str(single).lower()).save(path)
