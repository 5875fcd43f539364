import json

import pytest

from readloom.operators import refget
from readloom.sources import fasta, mapping
from tests.spec import digest


def texts(n, mapped):
    return json.dumps({"metadata": {"genome": n, "ambiguous_bases_masked": n != "open", "total_sequences": len(mapped), "other": 1}, "refget_mapping": mapped})


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("lost text\n>chr1 first contig\nacgt\nNNRY\n\n>empty\n>7\r\nAC GT\r\nACGT\n>chr1 again\nTTTT\n>last\nA")
    (tmp_path / "b.fa").write_text(">only\nACGU\n")
    rows = [(r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()]
    assert rows == [("chr1", "acgtNNRY"), ("7", "ACGTACGT"), ("chr1", "TTTT"), ("last", "A")]
    assert [(r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "b.fa")).collect()] == [("only", "ACGU")]
    assert {r.name for r in fasta.fasta_headers(spark, str(tmp_path / "a.fa")).collect()} == {"chr1", "empty", "7", "last"}
    made = {r.name: r for r in refget.from_sequences(fasta.read_fasta(spark, str(tmp_path / "a.fa"))).collect()}
    assert made["chr1"].refget_id == "SQ." + digest("TTTT") and made["7"].length == 8 and made["7"].n_ambiguous == 0
    kept = {r.name: r for r in refget.from_sequences(fasta.read_fasta(spark, str(tmp_path / "b.fa")), keep_ambiguous=True).collect()}
    assert kept["only"].refget_id == "SQ." + digest("ACGU") and kept["only"].n_ambiguous == 1


def test_names(spark):
    rows = [("chr1", "a", 0), ("1", "b", 1), ("NC_000067.7", "c", 2), ("chrUn_x", "d", 3), ("CHRm", "e", 4), ("a-b", "f", 5)]
    out = dict(refget.with_variants(spark.createDataFrame(rows, "name string, refget_id string, ord int")).collect())
    assert {out[k] for k in ("1", "chr1", "Chr1", "CHR1")} == {"b"} and out["NC_000067.7"] == "c" and out["a-b"] == "f"
    assert {out[k] for k in ("Un_x", "chrUn_x", "ChrUn_x", "CHRUn_x")} == {"d"} and {out[k] for k in ("m", "chrm", "CHRm")} == {"e"}
    assert len(out) == 14


def test_bogus(spark):
    names = ["67", "chr67", "CHR31", "chr30", "30", "chrX", "NC_67", "031", "030", "9" * 40, "cHr67", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(refget.is_bogus(df.n)).collect()] == [True, True, True, False, False, False, False, True, False, True, False, False]


def test_merge_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(texts("one", {"chr1": "SQ.a", "67": "SQ.z", "NC_1.1": "SQ.a"}))
    (tmp_path / "b.json").write_text(texts("open", {"chr1": "ga4gh:SQ.b", "chr2": "SQ.b", "Chr1": "SQ.c"}))
    (tmp_path / "none.json").write_text('{"metadata": {}}')
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    rows = mapping.read_mapping(spark, paths)
    assert {(r.name, r.refget_id, r.file_ord) for r in rows.collect()} >= {("chr1", "SQ.b", 1), ("67", "SQ.z", 0)}
    assert [(r.name, r.kept, r.dropped) for r in refget.conflicts(rows).collect()] == [("chr1", "SQ.a", ["SQ.b"])]
    out = mapping.merge(spark, paths, str(tmp_path / "out.json"), "merged")
    got = dict(out.collect())
    # Chr1 belongs to a digest that is seen later, so its spellings win over those of the first file's chr1.
    assert got["NC_1.1"] == "SQ.a" and got["chr2"] == got["2"] == "SQ.b" and got["1"] == got["chr1"] == "SQ.c" and "67" not in got
    saved = json.loads((tmp_path / "out.json").read_text())
    assert saved["refget_mapping"] == got and saved["metadata"]["ambiguous_bases_masked"] is False
    assert saved["metadata"]["source_genomes"] == ["one", "open"] and saved["metadata"]["source_files"] == ["a.json", "b.json"] and saved["metadata"]["total_sequences"] == 3
    assert mapping.read_mapping(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        mapping.merge(spark, paths[:1], str(tmp_path / "x.json"), "x")


def test_cache(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1\nACGTR\n")
    args = {"fasta": str(tmp_path / "g.fa"), "folder": str(tmp_path / "cache")}
    masked = dict(mapping.load_or_build(spark, **args).collect())
    kept = dict(mapping.load_or_build(spark, keep_ambiguous=True, **args).collect())
    assert masked["1"] == "SQ." + digest("ACGTN") and kept["1"] == "SQ." + digest("ACGTR")
    assert len(list((tmp_path / "cache").glob("g-*.parquet"))) == 2
    assert dict(mapping.load_or_build(spark, **args).collect()) == masked and mapping.load_or_build(spark) is None
    (tmp_path / "m.json").write_text(texts("one", {"chr1": "SQ.a"}))
    assert dict(mapping.load_or_build(spark, json_path=str(tmp_path / "m.json"), **args).collect()) == {"chr1": "SQ.a"}


def test_malformed(spark):
    good = "SQ.aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2"
    rows = spark.createDataFrame([("a", good), ("b", f"ga4gh:{good}"), ("c", "SQ.short"), ("d", None), ("e", "chr1")], "name string, refget_id string")
    assert {r.name for r in mapping.malformed(rows).collect()} == {"c", "d", "e"}


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_files_of_one_name_keep_their_order(spark, tmp_path, order):
    for k in (0, 1):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "m.json").write_text(texts(f"genome{k}", {"chr1": f"SQ.{k}", f"chr{k + 5}": f"SQ.own{k}"}))
    paths = [str(tmp_path / f"d{k}" / "m.json") for k in order]
    got = dict(mapping.merge(spark, paths, str(tmp_path / "out.json"), "merged").collect())
    assert got["chr1"] == f"SQ.{order[0]}" and got["chr5"] == "SQ.own0" and got["chr6"] == "SQ.own1"
    meta = json.loads((tmp_path / "out.json").read_text())["metadata"]
    assert meta["source_genomes"] == [f"genome{k}" for k in order] and meta["source_files"] == ["m.json", "m.json"]


def test_text_before_a_header_is_no_contig_in_any_file(spark, tmp_path):
    from readloom.sources import fasta

    for k in range(6):
        (tmp_path / f"g{k}.fa").write_text(("" if k % 2 else f"junk{k}\nACGT\n") + f">c{k} more\nAC\nGT\n>d{k}\nGG\n")
    assert sorted((r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path)).collect()) == sorted([(f"c{k}", "ACGT") for k in range(6)] + [(f"d{k}", "GG") for k in range(6)])
    (tmp_path / "only.txt").write_text("no header at all\n")
    assert fasta.read_fasta(spark, str(tmp_path / "only.txt")).collect() == []
