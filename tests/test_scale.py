"""What keeps the cost of a read down: nothing is made twice, and short reads take short ways with the same results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar, md
from readloom.operators import decode
from readloom.plans import registry, synth
from readloom.sources import bam, sam
from tests import spec

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["decode_xb_xs", "roundtrip_check", "variant_candidates", "x5_x3_serials", "xb_xs"])
def test_no_filter_or_join_makes_the_cigar_anew(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if re.search(r"^\W*(Filter|\w*Join) ", x) and "lambda" in x]


def test_a_tag_is_taken_apart_and_looked_at_once(spark):
    plan = registry.QUERIES["roundtrip_check"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # One split of XB and one of XS, numbers without a text made anew, exons without filters.
    assert plan.count("split(") == 2 and "^-, " not in plan and "arrays_zip" not in plan


def test_decoded_tags_are_those_of_plain_python(spark):
    draw = random.Random(5)
    number = lambda: draw.choice((-1, 1, 1)) * draw.randrange(1 << draw.choice((1, 8, 40, 62)))
    rows = []
    for k in range(300):
        ends, coords = [number() for _ in range(draw.choice((2, 2, 3)))], [number() for _ in range(draw.randint(0, 9))]
        rows.append((k, ends, coords))
    rows.append((300, [1, 2], list(range(6001))))
    text = lambda values: "aKF498dAp." + ".".join(f"{v:x}" for v in values)
    frame = spark.createDataFrame([(k, text(e), text(c) if c else "single") for k, e, c in rows], "k int, xb string, xs string")
    got = {r.k: (r.junction_coords, [tuple(x) for x in r.exons]) for r in frame.select("k", decode.splice(F.col("xs")).alias("s"), decode.boundary(F.col("xb")).alias("b")).select("k", "s.coords", decode.exons(F.col("b"), F.col("s")).alias("exons")).select("k", F.coalesce("coords", F.array().cast("array<bigint>")).alias("junction_coords"), "exons").collect()}
    for k, (left, right, *_), c in rows:
        starts, stops = [left] + c[1::2], c[0::2] + [right]
        starts += [None] * (len(stops) - len(starts))
        assert got[k] == (c, list(zip(starts, stops)))
    for xb, xs in (("aKF498dAp.1", None), ("aKF498dAp.1.2", "aKF498dAp.1..2"), ("aKF498dAp.1.2", "aKF498dAp.1.2g"), ("aKF498dAp.1.2", "aKF498dAp.-.1")):
        with pytest.raises(Exception, match="not hexadecimal"):
            decode.decode_tags(spark.createDataFrame([(xb, xs)], "xb string, xs string")).collect()


@pytest.mark.parametrize("even", [True, False])
def test_reads_are_made_of_lines_without_interpreted_steps(spark, even):
    plan = synth.reads_from_orders(spark, SMALL, even)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan


def test_variant_counts_makes_no_tags_of_structure(spark):
    plan = registry.QUERIES["variant_counts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "_serial" not in plan


def test_candidates_of_short_reads_are_those_of_the_sorted_way(spark):
    draw = random.Random(3)
    rows = []
    for k in range(400):
        ops = [(draw.choice((0, 1, 2, 5, 9)), draw.choice("MMMMIDNSHP=X")) for _ in range(draw.randint(1, 12))]
        size = sum(n for n, o in ops if o in "MIS=X") + draw.randint(-2, 2)
        events = "".join(draw.choice((str(draw.randint(0, 6)), "A", "c", "^GT", "^a", "0", "N")) for _ in range(draw.randint(1, 14)))
        rows.append((k, draw.randint(1, 500), "".join(f"{n}{o}" for n, o in ops), "".join(draw.choice("ACGTNa") for _ in range(max(size, 0))) or "*", events))
    reads = spark.createDataFrame(rows, "k int, pos bigint, cigar string, seq string, md string").withColumn("ops", cigar.operations(F.col("cigar"))).withColumn("events", md.md_events(F.col("md"))).cache()
    of = lambda make: {r.k: [tuple(v) for v in r.v] for r in reads.select("k", make(F.col("ops"), F.col("pos"), F.col("seq"), F.col("events")).alias("v")).collect()}
    few, plain = of(md._few_candidates), of(md._sorted_candidates)
    assert few == plain and sum(map(len, few.values())) > 300
    for k, pos, text, seq, tag in rows:
        if seq != "*":
            assert few[k] == [tuple(v) for v in spec.variants(pos, spec.ops(text), seq, tag)]


def test_reads_stay_in_as_many_partitions_as_a_shuffle_has(spark):
    used = registry.QUERIES["vrs_ids"](spark, SMALL).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sorted_writing_keeps_its_ranges_and_the_header_in_the_first(spark, tmp_path):
    fields = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    reads = spark.range(40).select(*[F.lit("7").alias(x) for x in fields], (F.col("id") * 7 % 40).alias("ord")).withColumn("qname", F.col("ord").cast("string"))
    header = spark.createDataFrame([(f"@CO\t{k}", k) for k in range(30)], "line string, ord bigint")
    sam.write_sam(reads, str(tmp_path / "x"), header)
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "x").glob("part-*"))]
    assert [x for p in parts for x in p if x[0] != "@"] == ["\t".join([str(k)] + ["7"] * 10) for k in range(40)]
    assert len(parts) > 3 and [x[0] for x in parts[0]].count("@") == 30 and parts[0][:30] == [f"@CO\t{k}" for k in range(30)]


def test_one_bam_file_gives_every_core_several_tasks():
    assert bam.even_split(500 << 20, 12) == -(-(500 << 20) // 48) < bam.SPLIT_BYTES
    assert bam.even_split(1 << 40, 12) == bam.SPLIT_BYTES and bam.even_split(0, 12) == bam.LEAST_SPLIT
