import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import tags
from readloom.plans import synth
from readloom.sources import bam, sam
from readloom.streaming import tagging

HEADER = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:chr1\tLN:200000000\n@SQ\tSN:chr2\tLN:100000000"
LINES = [
    "r1\t0\tchr1\t100\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tNM:i:0\tMD:Z:10\tNM:i:5\tXF:f:1.5\tXB:B:c,1,-2,3",
    "short\t0\tchr1\t100",
    "r2\t16\tchr2\t5\t0\t4M2N3M\t=\t7\t-9\tACGTNAC\t*\tXA:A:q\txx",
    "r3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*",
]


def sam_file(path, lines=LINES):
    path.write_text(HEADER + "\n" + "\n".join(lines) + "\n")
    return str(path)


def test_sam(spark, tmp_path):
    reads = sam.read_sam(spark, sam_file(tmp_path / "a.sam"))
    rows = reads.orderBy("ord").collect()
    assert [r.qname for r in rows] == ["r1", "r2", "r3"] and rows[0].pos == 100 and rows[0].flag == 0
    assert tuple(rows[0].tags["NM"]) == ("i", "0") and tuple(rows[0].tags["XB"]) == ("B", "c,1,-2,3") and set(rows[1].tags) == {"XA"}
    header = sam.with_program(sam.read_header(spark, str(tmp_path / "a.sam")), "tag a.sam")
    tagged = tags.set_tags(tags.tag_reads(reads))
    sam.write_sam(tagged, str(tmp_path / "out"), header, single=True)
    (part,) = (tmp_path / "out").glob("part-*")
    out = part.read_text().splitlines()
    assert out[:3] == HEADER.splitlines() and out[3].startswith("@PG\tID:readloom\tPN:readloom\tVN:") and out[3].endswith("CL:tag a.sam")
    assert [x.split("\t")[0] for x in out[4:]] == ["r1", "r2", "r3"] and "XS:Z:single" in out[4] and out[6] == LINES[3]
    again = sam.read_sam(spark, str(part)).orderBy("ord").collect()
    assert again[0].tags == tagged.orderBy("ord").collect()[0].tags


def random_bam(spark, n):
    rng, rows = random.Random(2), []
    for k in range(n):
        size = rng.randint(1, 400)
        rows.append((f"read{k:06d}", rng.choice([0, 16, 4]), rng.choice(["chr1", "chr2", "*"]), rng.randint(0, 90_000_000), rng.randint(0, 60), f"{size}M" if k % 9 else "*", rng.choice(["*", "=", "chr2"]), rng.randint(0, 1000), rng.randint(-500, 500), "".join(rng.choice("ACGTN") for _ in range(size)), "".join(chr(rng.randint(33, 90)) for _ in range(size)) if k % 3 else "*", {"NM": ("i", str(rng.randint(-5, 70000))), "MD": ("Z", "5A6"), "XF": ("f", "0.5"), "XC": ("B", "S,1,2,65535"), "XA": ("A", "c")} if k % 4 else {}, k))
    return spark.createDataFrame(rows, bam.SCHEMA.replace("file string, ", ""))


@pytest.mark.parametrize("split", [1 << 30, 20_000, 3_000])
def test_bam_round_trip(spark, tmp_path, split):
    reads = random_bam(spark, 3000)
    bam.write_bam(reads.repartition(1), str(tmp_path / "x.bam"), HEADER, order=None)
    back = bam.read_bam(spark, str(tmp_path / "x.bam"), split)
    if split < 1 << 30:
        assert back.rdd.getNumPartitions() > 5
    names = [c for c in reads.columns if c not in ("ord", "rnext")]
    # A mate on the read's own sequence is written as =
    mate = F.when((F.col("rnext") == F.col("rname")) & (F.col("rname") != "*"), "=").when((F.col("rnext") == "=") & (F.col("rname") == "*"), "*").otherwise(F.col("rnext")).alias("rnext")
    got = sorted(map(str, back.select(*names, mate).collect()))
    assert got == sorted(map(str, reads.select(*names, mate).collect()))
    assert bam.bam_header(str(tmp_path / "x.bam")).splitlines() == HEADER.splitlines()


def test_bam_order_and_empty(spark, tmp_path):
    reads = random_bam(spark, 500)
    bam.write_bam(reads.repartition(7), str(tmp_path / "o.bam"), HEADER)
    assert [r.qname for r in bam.read_bam(spark, str(tmp_path / "o.bam")).orderBy("ord").collect()] == [f"read{k:06d}" for k in range(500)]
    bam.write_bam(reads.limit(0).repartition(1), str(tmp_path / "e.bam"), HEADER)
    assert bam.read_bam(spark, str(tmp_path / "e.bam")).count() == 0


def test_bam_is_tagged_like_sam(spark, tmp_path):
    reads = sam.read_sam(spark, sam_file(tmp_path / "a.sam"))
    bam.write_bam(reads, str(tmp_path / "a.bam"), HEADER)
    a, b = (sorted(tuple(r) for r in tags.tag_reads(x).select("qname", "xi", "xb", "xs", "xt", "xc", "x5", "x3").collect()) for x in (reads, bam.read_bam(spark, str(tmp_path / "a.bam"))))
    assert a == b and len(a) == 3


def test_stream_is_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    names = synth.mapping(spark)
    tagging.tag_stream(synth.reads_from_events(stream), names, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    cols = ["qname", "xi", "xb", "xs", "xt", "xc", "x5", "x3"]
    want = sorted(map(tuple, tags.tag_reads(synth.reads_from_events(batch), names).select(cols).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(cols).collect())) == want and len(want) > 500
    counted = tagging.windowed_counts(tags.tag_reads(synth.reads_from_events(stream), names), "x5")
    counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    whole = tagging.windowed_counts(tags.tag_reads(synth.reads_from_events(batch), names), "x5")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, whole.collect()))


def test_sam_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sam_file(tmp_path / "in" / "a.sam")
    stream = tagging.sam_stream(spark, str(tmp_path / "in"))
    tagging.tag_stream(stream, None, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {(r.qname, r.xs) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("r1", "single"), ("r2", tags.tag_reads(sam.read_sam(spark, str(tmp_path / "in"))).filter("qname = 'r2'").first().xs), ("r3", None)}


def calmd(pos, cigar, seq, ref):
    """What stands in the reference where a read differs, base by base."""
    out, same, r, q = "", 0, pos - 1, 0
    from tests.spec import ops

    for n, o in ops(cigar):
        if o in "M=X":
            for i in range(n):
                if r + i >= len(ref):
                    break
                a, b = seq[q + i].upper(), ref[r + i].upper()
                if a == b != "N" or a == "=":
                    same += 1
                else:
                    out, same = f"{out}{same}{b}", 0
            r, q = r + n, q + n
        elif o == "D":
            gone = ref[r : r + n].upper()
            if gone:
                out, same = f"{out}{same}^{gone}", 0
            r += n
        elif o == "N":
            r += n
        elif o in "IS":
            q += n
    return f"{out}{same}"


@pytest.mark.parametrize("size", [1 << 14, 7])
def test_md_from_the_reference(spark, size):
    from readloom.operators import reference
    from tests import spec

    rng = random.Random(size)
    refs = {n: "".join(rng.choice("ACGTacgtN" if n == "chr1" else "ACGT") for _ in range(900)) for n in ("chr1", "chr2")}
    rows = []
    for k in range(400):
        c = "".join(f"{rng.randint(1, 30)}{rng.choice('MMMMXNDISH')}" for _ in range(rng.randint(1, 6)))
        n = sum(n for n, o in spec.ops(c) if o in "MIS=X")
        name, pos = rng.choice(["chr1", "chr2"]), rng.randint(1, 880)
        seq = "".join(rng.choice("ACGT=") if rng.random() < 0.2 else refs[name][(pos + i) % 900] for i in range(n))
        rows.append((k, 0, name, pos, c, seq, "old"))
    rows += [(1000, 4, "chr1", 5, "3M", "ACG", "old"), (1001, 0, "chrZ", 5, "3M", "ACG", "old"), (1002, 0, "chr1", 5, "3M", "*", "old"), (1003, 0, "chr1", 5, "*", "ACG", "old"), (1004, 0, None, None, None, None, None)]
    reads = spark.createDataFrame(rows, "ord long, flag int, rname string, pos long, cigar string, seq string, md string")
    contigs = spark.createDataFrame([*[(n, s, 1) for n, s in refs.items()], ("chr1", "TTTT", 0), ("none", "", 2)], "name string, seq string, ord int")
    out = {r.ord: r.md for r in reference.with_md(reads, contigs, size).collect()}
    assert len(out) == len(rows) and {out[k] for k in range(1000, 1005)} == {None}
    for k, _, name, pos, c, seq, _ in rows[:400]:
        if not seq:
            assert out[k] is None
            continue
        if any(o in "M=XD" for _, o in spec.ops(c)) and out[k] is not None:
            assert out[k] == calmd(pos, c, seq, refs[name]), (pos, c)
        else:  # nothing of it lies on the contig
            r = pos - 1
            for n, o in spec.ops(c):
                assert o not in "M=XD" or r >= 900
                r += n if o in "M=XDN" else 0


def test_sites(spark):
    from readloom.operators import sites

    rng = random.Random(8)
    reads = [(rng.choice(["chr1", "chr2"]), rng.choice("+-"), rng.randint(-50, 30_000), k) for k in range(3000)] + [("chr1", "+", 500, -1)] * 50
    known = [(rng.choice(["chr1", "chr3"]), rng.choice("+-"), rng.randint(0, 30_000)) for _ in range(150)] * 2
    out = sites.near_sites(spark.createDataFrame(reads, "rname string, strand string, site long, k int"), spark.createDataFrame(known, "rname string, strand string, at long"))
    got = sorted((r.rname, r.strand, r.site, r.k, r.hit) for r in out.collect())
    assert got == sorted((*r, any(r[:2] == x[:2] and abs(r[2] - x[2]) <= 100 for x in known)) for r in reads)
    e = spark.createDataFrame([("chr1", 0, "+", 10), ("chr1", 16, "-", 10)], "rname string, flag int, s string, pos long").withColumn("cigar", F.lit("5M5N5M"))
    s = tags.with_structure(e)
    assert [r.site for r in sites.ends(s, True).collect()] == [10, 24] and [r.site for r in sites.ends(s, False).collect()] == [24, 10]


def test_one_bam_of_many_tasks(spark, tmp_path):
    reads, path = random_bam(spark, 2000), tmp_path / "one.bam"
    for _ in range(2):  # the second replaces the first
        bam.write_bam(reads.repartition(5), str(path), HEADER, single=True)
    assert path.is_file() and [x.name for x in tmp_path.iterdir()] == ["one.bam"]
    data, at, blocks = path.read_bytes(), 0, 0
    while at < len(data):
        at, blocks = at + bam.block_size(data[at:]), blocks + 1
    assert blocks > 5 and data.endswith(bam._EOF) and data.count(bam._EOF) == 1
    for split in (1 << 30, 30_000):
        assert [r.qname for r in bam.read_bam(spark, str(path), split).orderBy("ord").collect()] == [f"read{k:06d}" for k in range(2000)]
    bam.write_bam(reads.limit(0), str(path), HEADER, single=True)
    assert bam.read_bam(spark, str(path)).count() == 0 and bam.bam_header(str(path)).splitlines() == HEADER.splitlines()


def test_bam_parts_are_added_or_replaced(spark, tmp_path):
    reads, path = random_bam(spark, 300), str(tmp_path / "x.bam")
    bam.write_bam(reads.filter("ord < 100").repartition(2), path, HEADER)
    bam.write_bam(reads.filter("ord >= 100").repartition(2), path, HEADER, append=True)
    assert [r.qname for r in bam.read_bam(spark, path).orderBy("ord").collect()] == [f"read{k:06d}" for k in range(300)]
    bam.write_bam(reads.filter("ord < 50"), path, HEADER)
    assert bam.read_bam(spark, path).count() == 50


def test_bam_columns(spark, tmp_path):
    reads, path = random_bam(spark, 200), str(tmp_path / "x.bam")
    bam.write_bam(reads, path, HEADER)
    some = ["tags", "pos", "cigar"]
    got = bam.read_bam(spark, path, columns=some)
    assert got.columns == some and sorted(map(str, got.collect())) == sorted(map(str, bam.read_bam(spark, path).select(some).collect()))
    assert "seq" not in bam.decode_record(b"\0" * 32, [("chr1", 9)], frozenset(["pos"]))


def test_sites_without_a_broadcast_and_large_mappings(spark, monkeypatch):
    from readloom.operators import decode, sites

    reads = spark.createDataFrame([("chr1", "+", k % 700, k) for k in range(500)], "rname string, strand string, site long, k int")
    known = spark.createDataFrame([("chr1", "+", 5), ("chr1", "+", 6), ("chr1", "+", 600)], "rname string, strand string, at long")
    want = sorted(map(tuple, sites.near_sites(reads, known).collect()))
    names = synth.mapping(spark)
    tagged = tags.tag_reads(spark.createDataFrame([("a", 0, f"chr{k}", 5, "10M5N5M") for k in range(1, 25)], "qname string, flag int, rname string, pos long, cigar string"), names).select("rname", "xb", "xs")
    decoded = sorted(map(str, decode.decode_tags(tagged, names).collect()))
    monkeypatch.setattr(sites, "BROADCAST_BINS", 0)
    monkeypatch.setattr(decode, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(tags, "BROADCAST_NAMES", 0)
    assert sorted(map(tuple, sites.near_sites(reads, known).collect())) == want and sum(x[-1] for x in want) > 100
    assert sorted(map(str, decode.decode_tags(tagged, names).collect())) == decoded
