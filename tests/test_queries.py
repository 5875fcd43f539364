import pytest

from readloom.plans import files, registry
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_is_its_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, SMALL), registry.SQL[name], SMALL) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_plan_stays_in_the_jvm_and_joins_on_keys(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "ArrowEval", "MapInArrow", "CartesianProduct", "NestedLoop", "Scan ExistingRDD") if x in plan]


def test_masks_are_counted_in_all_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert any(not r.text.isascii() for r in rows if r.text)

    def brute(text):
        kept = [c for c in text if c in "acgtnACGTN"]
        return len(text), len(text) - len(kept), len(text) - len(kept) + sum(c in "nN" for c in kept)

    want = sorted((r.doc_id, *(brute(r.text) if r.text is not None else (None,) * 3)) for r in rows)
    assert sorted(tuple(r) for r in registry.QUERIES["mask_counts_all"](spark, SMALL).collect()) == want


def test_entry(spark):
    out = registry.entry(spark, SMALL)
    assert out.columns[:4] == ["qname", "rname", "pos", "strand"] and out.count() > 1000


def test_entry_functions_agree():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and set(registry.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(files.QUERIES))
def test_query_through_files_is_its_sql(spark, name):
    assert set(files.QUERIES) == set(files.SQL) and not set(files.QUERIES) & set(registry.QUERIES)
    assert compare(files.QUERIES[name](spark, SMALL), files.SQL[name], SMALL) > 0


def test_variant_reads_are_those_of_the_plain_rules():
    from readloom.plans import vectors
    from tests import spec

    for pos, cigar, seq, md, subs in vectors._VARIANT_READS:
        assert [v for v in spec.variants(pos, spec.ops(cigar), seq, md) if len(v[1]) == len(v[2]) == 1] == subs
