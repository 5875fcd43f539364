import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from readloom.llm import common as C


def test_slices_keep_every_row_and_the_limit():
    texts = ["a" * 10, None, "", "é" * 30, "b" * 200, "c", "d" * 99, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    for limit in (1, 50, 100, 1000):
        parts = list(C.slices(batch, "text", limit))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= limit for p in parts)
    assert list(C.slices(batch.slice(0, 0), "text")) == []


def test_fold_and_fresh(spark):
    df = spark.createDataFrame([(7, "x"), (None, "y"), (-3, "z")], "doc_id long, Score string")
    assert [r[0] for r in df.select(C.fold("doc_id", 3)).collect()] == [zlib.crc32(x) % 3 for x in (b"7", b"", b"-3")]
    assert C.fresh(df, "score") == "score_" and C.fresh(df, "other") == "other"
    assert df.select(C.lower_ascii(F.lit("AZ É az"))).first()[0] == "az É az"


def test_materialise_reads_back_what_it_wrote(spark):
    df = spark.range(10).withColumn("t", F.lit("x"))
    out = C.materialise(df, "kept")
    assert out.dtypes == df.dtypes and out.count() == 10 and all(f.startswith("file:") for f in out.inputFiles())


def test_the_session_names_the_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "hdfs://cluster/shared/" if key == "spark.checkpoint.dir" else default)

    assert C.scratch(Session) == "hdfs://cluster/shared/readloom"
    assert C.new_path(Session, "x").startswith("hdfs://cluster/shared/readloom/x-") and C.new_path(Session, "x") != C.new_path(Session, "x")
