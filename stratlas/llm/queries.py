"""Driver queries of this subpackage: thin digests of the operators' real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.llm import chat, decontam, exactdedup, html_extract, license, lm, manifest, mixing, neardup, phrases, quality, sharding, urlfilter
from stratlas.llm.oracles import ORACLES
from stratlas.llm.textops import table

Query = Callable[[SparkSession, str], DataFrame]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("ledger")
    mask = m["fail_mask"]
    return out.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (mask.bitwiseAND(F.lit(quality.BASE)) != 0).alias("base_failed"),
        quality.passes(mask).alias("kept"),
        mask.alias("fail_mask"),
    )


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy rejects, and what it alone rejects."""
    out = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.ablation(out, F.col("ledger")["fail_mask"])


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])
    text = F.col(name)["text"]
    return out.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = license.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    x = F.col(name)
    firsts = F.transform(x["base"], lambda s: s["first"])
    label = lambda a: F.transform(a, lambda s: s["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    sure = F.array_max(F.transform(F.concat(x["base"], x["found"]), lambda s: s["priority"]))
    return out.select(
        "doc_id",
        x["n_words"].alias("n_words"),
        F.size(x["base"]).cast("long").alias("n_base"),
        F.array_min(firsts).cast("long").alias("first_word"),
        F.array_max(firsts).cast("long").alias("last_word"),
        joined(label(x["base"])).alias("base_labels"),
        joined(F.concat(label(x["base"]), label(x["found"]))).alias("labels"),
        (F.coalesce(sure, F.lit(0)) / 100).alias("score"),
    )


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the license scan that SQL can state: the base phrases' places and labels."""
    return op2_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = urlfilter.filter_urls(table(spark, sf_dir, "pages"), ["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = sharding.shard(table(spark, sf_dir, "documents"), ["doc_id"])
    p = F.col(name)
    return out.select("doc_id", p["size"].alias("size"), p["text_crc32"].alias("text_crc32"), F.lit("bytes").alias("law"), p["shard"].alias("shard"), p["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score_documents(docs, docs.filter(~lm.held_out("doc_id")))
    return out.select("doc_id", lm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    out = chat.format_conversations(turns.union(own))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, result = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col(result)["items"]
    return out.select(
        "doc_id",
        F.col(result)["n_words"].alias("n_words"),
        decontam.n_hit(result).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        decontam.is_contaminated(result).alias("contaminated"),
    )


def op8_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = mixing.ranked(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["doc_id"])
    m = F.col(name)
    return out.select("doc_id", *[m[c].alias(c) for c in ("size", "source_size", "target", "taken", "positions", "ranks")])


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = exactdedup.duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *[F.col(name)[c].alias(c) for c in ("keep_id", "group_size", "kept", "text_sha256")])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    tampered = manifest.leaf([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields])
    docs = docs.withColumn("other", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered))
    out, name = manifest.manifest(docs, ["doc_id", "other"], fields)
    m = F.col(name)
    out = out.select("doc_id", *[m[c].alias(c) for c in ("leaf", "subroot", "root")], manifest.proof_digest(m["proof"]).alias("proof_sha256"), manifest.above(F.coalesce("other", m["leaf"]), m["proof"]).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_license_scans": op2_license_scans,
    "op3_url_filters": op3_url_filters,
    "op4_kd_tree_sharding": op4_kd_tree_sharding,
    "op5_ppm_scoring": op5_ppm_scoring,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_curriculum_mixing": op8_curriculum_mixing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_collocations": op13_phrase_collocations,
    "quality_rule_ablation": quality_rule_ablation,
    "license_base_places": license_base_places,
}


__all__ = ["ORACLES", "QUERIES"]
