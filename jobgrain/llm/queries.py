"""One query per corpus operator, over whole tables and with production parameters, and their SQL."""

from jobgrain.llm import (codes, decontamination, html, lines, mtree, ngram_join, pieces, pii, quality, sharding, simhash, substrings,
                          whitening)
from jobgrain.llm.common import table
from jobgrain.llm.oracles import ORACLES


def op1_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op3_pii_feistel(spark, sf_dir):
    # The supplied tables hold no real data; where there are any, the key is a secret of the session.
    key = spark.conf.get("spark.jobgrain.pseudonym.key", "supplied tables only")
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key)


def op4_sentencepiece_nbest(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hilbert_sharding(spark, sf_dir):
    from pyspark.sql import functions as F
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_quality_bradley_terry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_ngram_jaccard(spark, sf_dir):
    return ngram_join.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_mtree_topk(spark, sf_dir):
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op11_simhash_gph(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_orchard_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_html_extraction, op3_pii_feistel, op4_sentencepiece_nbest, op5_substring_dedup, op6_decontamination, op7_hilbert_sharding, op8_quality_bradley_terry, op9_ngram_jaccard, op10_mtree_topk,
    op11_simhash_gph, op12_orchard_codes, op13_embedding_whitening)}
