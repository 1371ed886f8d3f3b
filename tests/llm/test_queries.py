"""Registered text queries on the smallest tables: against their SQL where there is one, else against brute force."""

import os

import brute
import pytest
from compare import compare, connect

from cytomosaic.llm import queries

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="sample tables are not here")


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.PLANS) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    message, failed = compare(spark, connect(SMOKE), queries.PLANS[name], queries.ORACLE[name], SMOKE)
    assert not failed, message


def rows(spark, name):
    return sorted((tuple(r) for r in queries.PLANS[name](spark, SMOKE).collect()), key=str)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]


def test_simhash_and_repeats_of_whole_tables(spark):
    docs = documents(spark)
    assert rows(spark, "op3_simhash_pigeonring") == sorted(brute.simhash(docs), key=str)
    assert rows(spark, "op6_bwt_dedup") == sorted(brute.repeats(docs), key=str)


def test_shards_of_whole_table(spark):
    got = queries.PLANS["op2_two_pass_shuffle"](spark, SMOKE).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((d, len(t.encode()) + 1, brute.crc32(t)) for d, t in documents(spark))
    assert {r.law for r in got} == {"rows"}


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    got = [r for r in queries.PLANS["op10_ppm_language"](spark, SMOKE).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMOKE)
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    assert out.columns == [*docs.columns, "shard", "slot"]
    kept = out.collect()
    ids = {r.doc_id for r in kept}
    marks = brute.simhash(documents(spark))
    assert ids <= {c for _, _, c in marks}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    dirty = {d for d, *_, flag in brute.contaminated([(r.doc_id, r.text) for r in kept], items) if flag}
    assert not dirty
