"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

Each query runs once to warm up and then three times; its time is the median. Results go to the noop sink, so every
column of every row is computed. ``bam_to_bam`` reads one BAM file, tags all its reads with all eight tags and writes
one BAM file; making its input isn't timed. ``reads_per_second`` are reads of all kinds a second: with the seven tags of
structure, with all eight, and from BAM to BAM.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = 3
#: Bytes of a BAM file for each task: the file of sf0.1 is small.
SPLIT = 1 << 20
HEADLINE = ("exons", "tags_hashed", "vrs_ids", "decode_xb_xs", "tag_stats", "isoform_counts", "locus_counts", "variant_counts", "tss_windows")


def timed(frame) -> float:
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from readloom.operators import tags
    from readloom.plans import files, registry
    from readloom.plans.synth import reads_from_orders
    from readloom.sources import bam
    from readloom.sources.files import scratch

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        every = [timed(registry.QUERIES[name](spark, SF_DIR)) for _ in range(1 + RUNS)]
        times[name] = round(statistics.median(every[1:]), 3)
    source, target = files.written_bam(spark, SF_DIR), scratch(spark, "tagged") + ".bam"
    header = bam.bam_header(source)
    every = []
    for _ in range(1 + RUNS):
        began = time.perf_counter()
        tagged = tags.tag_reads(bam.read_bam(spark, source, SPLIT), registry.known_names(spark), variants=True)
        bam.write_bam(tags.set_tags(tagged), target, header, None, single=True)  # no shuffle on the way, so the order is that of the input
        every.append(time.perf_counter() - began)
    times["bam_to_bam"] = round(statistics.median(every[1:]), 3)
    reads = reads_from_orders(spark, SF_DIR).count()
    print(json.dumps({
        "metric": "total of the medians of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS), "runs": RUNS, "reads": reads, "reads_per_second": {"structure": round(reads / times["tags_hashed"]), "structure and variants": round(reads / times["vrs_ids"]), "bam to bam, all eight tags": round(reads / times["bam_to_bam"])},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
