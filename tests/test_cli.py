import json

import pytest

from readloom import __main__ as cli
from readloom.sources import bam, sam
from tests.test_sources import HEADER

GENOME = ">chr1 one\n" + "ACGTACGTAC" * 30 + "\n>chr2\n" + "TTTTTCCCCC" * 30 + "\n"
SAM = f"{HEADER}\nr1\t0\tchr1\t11\t60\t5M20N5M\t*\t0\t0\tACGTAAGTAC\t*\nr2\t16\tchr2\t1\t60\t10M\t*\t0\t0\tTTTTTCCCCC\t*\tXS:A:+\nr3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "g.fa").write_text(GENOME)
    (tmp_path / "in.sam").write_text(SAM)
    return tmp_path


def run(spark, *args):
    a = cli.parser().parse_args([str(x) for x in args])
    return a.run(spark, a)


@pytest.mark.parametrize("suffix", ["sam", "bam", "parquet"])
def test_tag(spark, files, suffix):
    out = files / f"out.{suffix}"
    stats = run(spark, "tag", "-i", files / "in.sam", "-o", out, "-g", files / "g.fa", "--keep-ambiguous-bases", "--cache", files / "cache").first()
    assert (stats.total_reads, stats.processed_reads, stats.tagged_xv, stats.variants_emitted) == (3, 2, 1, 1)
    back = {"sam": lambda: sam.read_sam(spark, str(out)), "bam": lambda: bam.read_bam(spark, str(out)), "parquet": lambda: spark.read.parquet(str(out))}[suffix]()
    rows = {r.qname: r.tags for r in back.collect()}
    assert rows["r1"]["XV"].value.startswith("ga4gh:VA.") and rows["r1"]["XS"].value.count(".") == 2
    assert tuple(rows["r2"]["XS"]) == ("Z", "single") and "XV" not in rows["r2"] and not rows["r3"]
    if suffix != "parquet":
        header = bam.bam_header(str(out)) if suffix == "bam" else "\n".join(r.line for r in sam.read_header(spark, str(out)).collect())
        assert header.count("@PG") == 1 and header.startswith(HEADER)


def test_policy_comes_first(spark, files):
    with pytest.raises(ValueError, match="unmasked"):
        run(spark, "tag", "-i", files / "in.sam", "-o", files / "x.sam", "-g", files / "g.fa")
    assert not (files / "x.sam").exists()
    stats = run(spark, "tag", "-i", files / "in.sam", "-o", files / "x.sam", "-g", files / "g.fa", "--no-variants").first()
    assert stats.processed_reads == 2 and "tagged_xv" not in stats


def test_malformed_accessions_are_told_before_any_work(spark, files):
    (files / "bad.json").write_text(json.dumps({"metadata": {"ambiguous_bases_masked": False}, "refget_mapping": {"chr1": "SQ.short"}}))
    with pytest.raises(ValueError, match="chr1 SQ.short"):
        run(spark, "tag", "-i", files / "in.sam", "-o", files / "x.sam", "-r", files / "bad.json", "-g", files / "g.fa")


def test_refget(spark, files):
    run(spark, "refget", "-f", files / "g.fa", "-o", files / "m.json", "-g", "mine")
    made = json.loads((files / "m.json").read_text())
    assert made["metadata"]["genome"] == "mine" and made["metadata"]["total_sequences"] == 2 and {"1", "chr1", "Chr1", "CHR1"} <= set(made["refget_mapping"])
    run(spark, "refget", "--merge", files / "m.json", files / "m.json", "-o", files / "both.json", "-g", "both")
    assert json.loads((files / "both.json").read_text())["refget_mapping"] == made["refget_mapping"]
    assert run(spark, "refget", "--test").first().refget_id.startswith("SQ.aKF498dA")
    with pytest.raises(SystemExit):
        run(spark, "refget", "-o", files / "x.json")
    names = run(spark, "decode", "-b", f"{made['refget_mapping']['chr1'][3:11]}p.3e8.1004", "-r", files / "m.json").first().chr_names
    assert names == ["1", "CHR1", "Chr1", "chr1"]


def test_decode(spark):
    r = run(spark, "decode", "-b", "aKF498dAp.3e8.1004", "-s", "aKF498dAp.4b0.7d0.866.bb8").first()
    assert [(e.start, e.end) for e in r.exons] == [(1000, 1200), (2000, 2150), (3000, 4100)] and r.chr_names == ["<chr_hash:aKF498dA>"]
    r = run(spark, "decode", "-s", "aKF498dAm.4b0.7d0").first()
    assert (r.strand, r.junction_coords, r.n_junctions) == ("-", [1200, 2000], 1)
    with pytest.raises(SystemExit):
        run(spark, "decode", "-s", "single")
