"""The registered queries of the text operators: each applies one operator to its whole table; SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import chat, codebooks, decontaminate, langid, licences, lm, mixing, negatives, oracles, repeats, sharding, simhash, superminhash, topk
from .common import table

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracles.SQL)
N_SHARDS = 16


def query(plan):
    PLANS[plan.__name__] = plan
    return plan


@query
def op1_license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op2_two_pass_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dealt = sharding.shards(docs, N_SHARDS)
    return dealt.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_simhash_pigeonring(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_fair_queueing(spark, sf_dir):
    rows = cut(mixing.sized(table(spark, sf_dir, "documents")))
    decided = mixing.decide(rows, cut(mixing.schedule(rows)))
    return decided.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op5_segment_topk(spark, sf_dir):
    rows = topk.vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


@query
def op6_bwt_dedup(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents"))


@query
def op7_stupid_backoff(spark, sf_dir):
    scored = lm.score(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", "n_backoff", mean.alias("mean_log_score"))


@query
def op8_suffix_automaton(spark, sf_dir):
    found = decontaminate.match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit()
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op9_snapshot_collapse(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op10_ppm_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    predicted = langid.identify(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op11_superminhash(spark, sf_dir):
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_drake_codebooks(spark, sf_dir):
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


@query
def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.usable(table(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 100 == 0)
