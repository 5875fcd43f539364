"""What the corpus operators share: tables, shared scratch space, Arrow slices and word splitting."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; keeps a worker's memory flat whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes.translate: A-Z to lower case, every other ASCII byte that is no digit or letter to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read; any other column, whatever its name, is left out of the scan."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: str | object, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(column):
    return F.translate(column, _UPPER, _LOWER)


#: Stands between two parts of a line that are looked up apart.
GAP = "\x02"


def looked_up(lines: list[str], look: Callable[[list[str]], list[bytes]]) -> list:
    """For each line the numbers (numpy, uint32) of its parts one after the other; ``look`` gives those of distinct parts, little-endian."""
    import numpy as np
    import pyarrow.compute as pc

    if not lines:
        return []
    parts = pc.split_pattern(pa.array(lines, pa.large_string()), GAP)
    words = parts.flatten().dictionary_encode()
    found, which = look(words.dictionary.to_pylist()), words.indices.to_numpy()
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    first, each = np.cumsum(size) - size, size[which]
    ends = np.cumsum(each)
    every = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(first[which] - ends + each, each) + np.arange(ends[-1])]
    bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy()].tolist()
    del parts, words
    pa.default_memory_pool().release_unused()
    return [every[a:b] for a, b in zip(bounds, bounds[1:])]


_own_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session without one gets its own."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return f"{conf.rstrip('/')}/readloom"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own_scratch:
        _own_scratch["dir"] = tempfile.mkdtemp(prefix="readloom-")
        atexit.register(shutil.rmtree, _own_scratch["dir"], True)
    return f"file://{_own_scratch['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, and a lost executor costs no earlier step."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for a context, by way of the shared folder, so that a cluster needs no prior install."""
    sc = spark.sparkContext
    if getattr(sc, "_readloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for top, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        path = f"{new_path(spark, 'code')}/readloom_code.zip"
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(held.getvalue())
        out.close()
        sc.addPyFile(path)
    sc._readloom_shipped = True


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each with at most ``limit`` bytes of text or else with one row."""
    if not batch.num_rows:
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | object, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow, with the work dealt out in slices of bounded size."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield function(part)

    return df.mapInArrow(run, schema)
