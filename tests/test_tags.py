import random

import pytest
from pyspark.sql import functions as F

from readloom.config import TagConfig
from readloom.functions import bins, cigar, hashing, md
from readloom.operators import decode, stats, tags
from tests import spec

ACGT = "aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2"
# id: (flag, rname, pos, cigar, mode) and the values known for it
GOLDEN = {
    "R1": ((0, "chr1", 1000, "200M2000N150M", "middle"), {"xb": "aKF498dAp.3e8.d15", "xs": "aKF498dAp.4af.c80", "xt_serial": "+|0|0|2000|1199|3200", "xc_serial": "+|2|20|15", "xi": "zK4N3kwLlxD4z1ZBXp9UtCMYHeBZSADi", "xt": "_CqY5YI-dzS-Qt9JQfqFInEub7mhpM9b", "xc": "P7U7xlqP4V-a1BH9MX0xow0VhYP8eZRc", "x5": "FTiMm_F3Iz1rF7h7tjLj1jyA_RbFcwLb", "x3": "r9Eh6A2QndyubyyQ4kaQFJuD4Wms2mr6"}),
    "R2": ((16, "chr1", 1000, "200M2000N150M", "middle"), {"xb": "aKF498dAm.3e8.d15", "xi": "eLNkPsslaKgQbSM0a_JKYrBTgvSDrpg-", "xt": "KKdFIFelhMOAl3jW_WxxuneTC1tSyYbI", "xc": "Dylpdj09aNzUHdvL-TbBCwuHkzlyjOxs", "x5": "M-fh_Oh655fgQuMBv_F-uL7bEDzbM02r", "x3": "63CFxwdFYDJFfxt0YTb4ikDQwYM0mvjG"}),
    "R3": ((0, "chr1", 15000, "5S500M3I2D498M4H", "middle"), {"xb": "aKF498dAp.3a98.3e7f", "xs": "single", "xt_serial": "+|20000|1000|1000", "xc_serial": "+|15|100", "xi": "ebmYdj2mmC1qULoRF35tjw6bxGOWL2f2", "xt": "fzTjCg4RKJy3flcUruMC5E8t10z1E1R6", "xc": "deN8HG8o4UojzeBbw4Gg96e0Acd9-Y6-", "x5": "SWRu1J9NGmrbN2Ihib6kh0cp5AUUNHSo", "x3": "x9GeEV4EaNkxkMjyEshj1SYFtRghJAu7"}),
    "R4": ((0, "chr1", 1000, "5N10M", "middle"), {"xb": "aKF498dAp.3e8.3f6", "xs": "aKF498dAp.3e7.3ed", "xt_serial": "+|0|0|0|999|1005", "xc_serial": "+|1|0|1", "xi": "c_Eln2GPSnKZqzYMjbEM7Wc01hRl3Ktm", "xt": "vsMqFnA3SnhNZMZ0itKQaa6cX7v2aeZy", "xc": "I213yPy1fr1nSZuIfc8uVz5tSeMJWHLv"}),
    "R5": ((16, "chr1", 14990, "10M5N3D4M", "5prime"), {"xb": "aKF498dAm.3a8e.3aa3", "xs": "aKF498dAm.3a97.3aa0", "xt_serial": "-|20000|0|0|14999|15008", "xc_serial": "-|15|1|0", "xi": "LLX5jfCfbZuqNsu0SujLU2YyJc_SnapY", "xt": "tpJKH7ABU1UXGn_aV38hruQBGMp6Zp08", "xc": "7WlRw859CDWWQCSc1UybLfNmI9c9it7I", "x5": "kAB9hJNwJdQkOOVp_6vyWGOj0bFLrAr3", "x3": "TcOtO9PE8-ICkdoYoV7TVngeKNMrNOXU"}),
    "R5b": ((16, "chr1", 14990, "10M5N3D4M", "3prime"), {"xt_serial": "-|10000|0|0|14999|15008", "xt": "v2BqwXj8RtzIKqArdNw6MLnIRZgLHkE8"}),
    "R6": ((0, "chrX", 1000, "100M", "middle"), {"xb": "MXPwVkq5p.3e8.44b", "xs": "single", "xt_serial": "+|0|0|0", "xc_serial": "+|1|10", "xi": "pUPhnZZ6HTrGM79M67fi0WNby4u-4SIE", "xt": "bwdafHk4E5_ONTUGvXh12FpJsq4eioPL", "xc": "h6LS-7337TpLRcXV6fnA_EMTakxnIYsV", "x5": "je7fAX6e3xr_f8viLzd3JU2fWqp5F751", "x3": "je7fAX6e3xr_f8viLzd3JU2fWqp5F751"}),
}
READ = "qname string, flag int, rname string, pos long, cigar string"


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("chr1", f"SQ.{ACGT}"), ("chr2", f"ga4gh:SQ.{ACGT}")], "name string, refget_id string")


@pytest.mark.parametrize("mode", ["5prime", "middle", "3prime"])
def test_golden_reads(spark, names, mode):
    some = {k: v for k, v in GOLDEN.items() if v[0][4] == mode}
    out = tags.tag_reads(spark.createDataFrame([(k, *v[0][:4]) for k, v in some.items()], READ), names, TagConfig(clustermode=mode))
    rows = {r.qname: r for r in out.collect()}
    for k, (_, want) in some.items():
        chr32 = rows[k].chr32
        for tag, value in want.items():
            assert rows[k][tag] == (f"{chr32}|{value}" if tag.endswith("_serial") else value), (k, tag)


def test_untagged_reads_stay(spark, names):
    rows = [("a", 4, "chr1", 5, "10M"), ("b", 0, "chr1", 5, "*"), ("c", 0, "chr1", 5, "10S"), ("d", 0, "chr1", 5, None), ("e", 0, "chr1", 5, ""), ("f", 256, "chr1", 5, "10M"), ("g", None, None, None, None), ("h", 0, "chr2", 5, "7Q10M")]
    out = {r.qname: r for r in tags.tag_reads(spark.createDataFrame(rows, READ), names).collect()}
    assert {k for k, r in out.items() if r.tagged} == {"f", "h"} and len(out) == 8
    assert all(out["a"][t] is None for t in ("xi", "xb", "xs", "xt", "xc", "x5", "x3"))
    assert out["h"].chr32 == ACGT and out["h"].xb == "aKF498dAp.5.e"
    only = tags.tag_reads(spark.createDataFrame(rows, READ), names, TagConfig(primary_only=True)).filter("tagged").collect()
    assert [r.qname for r in only] == ["h"]


def random_reads(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        parts = [f"{rng.randint(1, 40)}{rng.choice('MMMMNNDDISHP=X')}" for _ in range(rng.randint(1, 9))]
        c = "".join(parts)
        size = sum(n for n, o in spec.ops(c) if o in "MIS=X")
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        text, at = "", 0
        for n, o in spec.ops(c):
            if o in "M=X":
                for i in range(n):
                    if rng.random() < 0.15:
                        text += f"{at}{rng.choice('ACGTNacgt')}"
                        at = 0
                    else:
                        at += 1
            elif o == "D":
                text += f"{at}^" + "".join(rng.choice("ACGT") for _ in range(n))
                at = 0
        out.append((str(k), rng.choice([0, 16]), rng.choice(["chr1", "chrX", "7"]), rng.randint(0, 60_000), c, rng.choice([seq, seq, seq, "*", ""]) if k % 5 else seq[: len(seq) // 2], rng.choice([text + str(at), text + str(at), None])))
    return out


def test_random_reads_follow_the_rules(spark, names):
    rows = random_reads(1500, 4)
    out = tags.with_serials(tags.with_structure(spark.createDataFrame(rows, READ + ", seq string, md string"), names))
    out = {r.qname: r for r in out.withColumn("v", md.candidates(F.col("ops"), F.col("pos"), F.col("seq"), F.col("md"))).collect()}
    for q, flag, rname, pos, c, seq, text in rows:
        r, e = out[q], spec.exons(pos, spec.ops(c))
        assert [(x.start, x.end) for x in r.exons] == e and r.tagged == bool(e), c
        assert r.chr32 == (ACGT if rname == "chr1" else spec.digest(rname.upper().replace("CHR", "")))
        if e:
            want = spec.serials(r.chr32, "-" if flag else "+", e)
            assert {t: r[t if t in ("xb", "xs") else f"{t}_serial"] for t in want} == want
        got = [(v.start, v.ref, v.alt) for v in r.v]
        assert got == spec.variants(pos, spec.ops(c), seq, text), (c, seq, text)


def test_round_trip(spark, names):
    out = tags.tag_reads(spark.createDataFrame([r[:5] for r in random_reads(600, 9)], READ), names).filter("tagged")
    back = decode.decode_tags(out.select("qname", "xb", "xs", F.col("exons").alias("was")), names).collect()
    assert len(back) > 300
    for r in back:
        assert r.exons == r.was and r.tags_consistent and r.total_exon_length == sum(e.end - e.start + 1 for e in r.was)
        assert r.chr_names in (["chr1", "chr2"], [f"<chr_hash:{r.chr8}>"])


def test_decode_edges(spark):
    rows = [("aKF498dAp.3e8.1004", "aKF498dAp.4b0.7d0.866.bb8"), ("aKF498dAp.3e8.1004", None), ("aKF498dAp.3e8.1004", "None"), ("aKF498dAp.3e8.1004", "single"), ("aKF498dAp.3e8.1004", "aKF498dAm.4b0.7d0")]
    out = decode.decode_tags(spark.createDataFrame(rows, "xb string, xs string")).collect()
    assert [[(e.start, e.end) for e in r.exons] for r in out[:2]] == [[(1000, 1200), (2000, 2150), (3000, 4100)], [(1000, 4100)]]
    assert out[1].exons == out[2].exons == out[3].exons and [r.tags_consistent for r in out] == [True] * 4 + [False]
    assert (out[0].n_junctions, out[0].span, out[0].intron_length, out[1].intron_length) == (2, 3101, 3101 - 201 - 151 - 1101, None)
    with pytest.raises(Exception, match="not hexadecimal"):
        decode.decode_tags(spark.createDataFrame([("aKF498dAp.zz.1", None)], "xb string, xs string")).collect()


def test_bins(spark):
    v = spark.createDataFrame([(x,) for x in [*range(-2500, 2501, 50), 500, 1500, 2500]], "v long")
    x = F.col("v")
    for r in v.select("v", bins.down(x, 200).alias("d"), bins.up(x, 200).alias("u"), bins.nearest(x, 1000).alias("n"), bins.floor_div(x, 7).alias("f")).collect():
        assert (r.d, r.u, r.n, r.f) == (r.v // 200 * 200, -(-r.v // 200) * 200, round(r.v / 1000) * 1000, r.v // 7)


def test_config_is_checked():
    for bad in ({"xc_bin_size": 0}, {"position_quantum": -1}, {"clustermode": "both"}):
        with pytest.raises(ValueError):
            TagConfig(**bad)


def test_identifiers(spark):
    one = spark.range(1)
    acc, acc2 = "SQ.IIB53T8CNeJJdUqzn9V_JnRtQadwWCbl", "SQ.dLZ15tNO1Ur0IcGjwc3Sdi_0A6Yf4zm7"
    lit = lambda v: F.lit(v)
    r = one.select(
        hashing.sha512t24u(lit("ACGT")).alias("d"), hashing.location_digest(lit(acc), lit(44908821), lit("C")).alias("l"), hashing.allele_id(lit(acc), lit(44908821), lit("C"), lit("T")).alias("a"),
        hashing.allele_id(hashing.bare_accession(lit("ga4gh:" + acc2)), lit(43106486), lit("A"), lit("G")).alias("b"),
        hashing.normalize_substitution(lit(10), lit("gATTc"), lit("GACTC")).alias("n"), hashing.refget_id(lit("ac\ngt")).alias("s"), hashing.refget_id(lit("acgRt")).alias("m"), hashing.refget_id(lit("acgNt")).alias("k"),
    ).first()
    assert r.d == ACGT and r.l == "wIlaGykfwHIpPY2Fcxtbx4TINbbODFVz"
    assert r.a == "ga4gh:VA.0AePZIWZUNsUlQTamyLrjm2HWUw2opLt" and r.b == "ga4gh:VA.gbvJw0s4OeAvloCeAM6BNNvrjFC_Dhc8"
    assert tuple(r.n) == (12, "T", "C") and r.s == f"SQ.{ACGT}" and r.m == r.k
    for bad, message in ((hashing.bare_accession(lit("SQ.short")), "refget accession"), (hashing.normalize_substitution(lit(1), lit("A"), lit("A")), "substitutions"), (hashing.refget_id(lit("AC-GT")), "nucleotide")):
        with pytest.raises(Exception, match=message):
            one.select(bad).collect()


def test_variants_of_reads(spark, names):
    known = spark.createDataFrame([("chr1", "SQ.IIB53T8CNeJJdUqzn9V_JnRtQadwWCbl")], "name string, refget_id string")
    rows = [("a", 0, "chr1", 44908822, "1M", "T", "0C0"), ("b", 0, "chr1", 44908822, "1M", "*", "0C0"), ("c", 0, "chr1", 44908812, "5M5N5M1I1D", "AAAAATTTTTG", "5C4^A"), ("d", 0, "chrX", 10, "4M", "ACGT", "4"), ("e", 4, "chr1", 0, "*", "ACGT", None)]
    out = {r.qname: r for r in tags.tag_reads(spark.createDataFrame(rows, READ + ", seq string, md string"), known, variants=True).collect()}
    assert out["a"].xv == "ga4gh:VA.0AePZIWZUNsUlQTamyLrjm2HWUw2opLt" and out["b"].xv is None
    assert out["c"].xv == out["a"].xv and (out["c"].variant_candidate_count, out["c"].variant_emitted_count) == (3, 1)
    assert out["d"].xv is None and out["e"].xv is None
    with pytest.raises(Exception, match="no refget accession"):
        tags.tag_reads(spark.createDataFrame([("x", 0, "chrX", 10, "4M", "ACGT", "0G3")], READ + ", seq string, md string"), known, variants=True).collect()


def test_policy(spark):
    rows = spark.createDataFrame([(i, 0, "5" if i < 10 else None) for i in range(300)], "ord long, flag int, md string")
    assert tags.variant_policy(rows, False) and not tags.variant_policy(rows, False, no_variants=True)
    assert not tags.variant_policy(rows.filter("ord > 0"), True)  # 9 of 100
    for masked in (True, None):
        with pytest.raises(ValueError, match="unmasked"):
            tags.variant_policy(rows, masked)
    with pytest.raises(ValueError, match="mapping"):
        tags.variant_policy(rows, None, has_genome=True, has_mapping=False)


def test_counts_in_passing(spark, names):
    from pyspark.sql import Observation

    seen = Observation("run")
    out = stats.observed(tags.tag_reads(spark.createDataFrame([("a", 0, "chr1", 5, "10M"), ("b", 4, "chr1", 5, "*"), ("c", 0, "chr1", 5, "5M5N5M")], READ), names), seen)
    assert out.count() == 3 and seen.get == {"total_reads": 3, "processed_reads": 2, "single_exon_reads": 1}


def test_set_tags(spark, names):
    kind = "map<string,struct<type:string,value:string>>"
    rows = spark.createDataFrame([("a", 0, "chr1", 5, "10M", {"XS": ("A", "+"), "NM": ("i", "1")}), ("b", 4, "chr1", 5, "*", {"XS": ("A", "+")}), ("c", 0, "chr1", 5, "10M", None)], f"{READ}, tags {kind}")
    out = {r.qname: r.tags for r in tags.set_tags(tags.tag_reads(rows, names)).collect()}
    assert tuple(out["a"]["XS"]) == ("Z", "single") and tuple(out["a"]["NM"]) == ("i", "1") and "XV" not in out["a"]
    assert set(out["b"]) == {"XS"} and tuple(out["b"]["XS"]) == ("A", "+") and set(out["c"]) == {"XI", "XB", "XS", "XT", "XC", "X5", "X3"}


def test_plan_has_no_shuffle_and_one_walk(spark, names):
    out = tags.tag_reads(spark.createDataFrame([("a", 0, "chr1", 5, "10M")], READ), names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan
    assert optimized.count("regexp_extract_all") == 1


def test_folds_over_blocks_are_plain_folds(spark, monkeypatch):
    from readloom.functions import cigar, folds, md

    rng = random.Random(12)
    rows = []
    for k in range(60):
        n = rng.choice([0, 1, 5, 63, 64, 65, 128, 200])
        c = "".join(f"{rng.randint(1, 9)}{rng.choice('MMMIDNS=XHP')}" for _ in range(n))
        m = "".join(rng.choice([str(rng.randint(0, 9)), "A", "^GT", "c"]) for _ in range(n))
        rows.append((k, c if k % 9 else None, rng.randint(1, 99), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 900))), m if k % 7 else None))
    d = spark.createDataFrame(rows, "k int, cigar string, pos long, seq string, md string")

    def walked():
        ops = cigar.operations(F.col("cigar"))
        values = {"e": cigar.exons(F.col("pos"), ops), "s": md.segments(ops, F.col("pos")), "m": md.md_events(F.col("md")), "v": md.candidates(ops, F.col("pos"), F.col("seq"), F.col("md"))}
        return sorted(map(str, d.select("k", *[v.alias(n) for n, v in values.items()]).collect()))

    monkeypatch.setattr(folds.emitting, "__defaults__", (1 << 30,))
    plain = walked()
    for block in (1, 2, 64):
        monkeypatch.setattr(folds.emitting, "__defaults__", (block,))
        assert walked() == plain


def test_exons_are_sorted_by_start(spark):
    from readloom.functions import cigar

    rows = spark.createDataFrame([([(9, 12), (1, 3), (5, 7)],), ([],), (None,)], "e array<struct<start:bigint,end:bigint>>")
    assert [r.s and [tuple(x) for x in r.s] for r in rows.select(cigar.sort_exons(F.col("e")).alias("s")).collect()] == [[(1, 3), (5, 7), (9, 12)], [], None]


def test_statistics_count_by_hand(spark, names):
    rows = spark.createDataFrame([("a", 0, "chr1", 5, "10M"), ("b", 0, "chr1", 5, "10M"), ("c", 16, "chr1", 5, "5M5N5M"), ("d", 4, "chr1", 5, "*")], READ).withColumn("ord", F.ascii("qname").cast("long"))
    tagged = tags.tag_reads(rows, names)
    got, near = (stats.tag_stats(tagged, approximate=x).first().asDict() for x in (False, True))
    assert got == near
    by_hand = [r.asDict() for r in tagged.orderBy("ord").collect()]
    for t in ("xi", "xb", "xs", "xt", "xc", "x5", "x3"):
        own = [r[t] for r in by_hand if r[t] is not None]
        assert (got[f"tagged_{t}"], got[f"unique_{t}"], got[f"example_{t}"]) == (len(own), len(set(own)), own[0])
    assert (got["total_reads"], got["processed_reads"], got["single_exon_reads"]) == (4, 3, 2)
    assert "example_xi" not in stats.tag_stats(tagged, None).columns
    none = stats.tag_stats(tagged.limit(0)).first()
    assert none.total_reads == none.unique_xi == 0 and none.example_xi is None
