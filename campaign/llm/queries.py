"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, language, licences, lm, neardup, packing, quality, secrets, toxicity, vectors, warc
from .oracles import ORACLES as ORACLES
from .shared import fold, shared_folder, table, unique


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a learned turn against the next one in the order of texts: rendered prompt, completions and loss ranges."""
    whole = chat.conversations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    made = chat.format_pairs(chat.pairs_of_neighbours(whole))
    return made.select("pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", chat.ranges_text(F.col("chosen_loss")).alias("chosen_loss"), "rejected", chat.ranges_text(F.col("rejected_loss")).alias("rejected_loss"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.digest(decontam.contamination(docs, items))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of held-out rows are never read: the join sees the other rows' labels only. Of clashing labels of one id the greatest counts, and
    of several texts of one id the one with the least hash is learned from, so rows are bounded as labels are."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~fold("doc_id", 4, 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = toxicity.sample(labels, "doc_id")
    learned = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    model = toxicity.train(learned)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.judge(docs, quality.train(docs, quality_target(spark, sf_dir)))


def quality_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the trusted documents."""
    return table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    trees = language.train(docs.where(~fold("doc_id", 3, 1)))
    found = language.identify(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return licences.by_document(docs, licences.train(docs))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_known", F.round("lm_score", 6).alias("lm_score"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vectors.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding")
    return vectors.digest(vectors.with_label_error(rows, "label"), books)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents", "doc_id", "text")))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives go to the shared folder and are read back from there."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    warc.write_archives(pages, folder := f"{shared_folder(spark)}/{unique('archives')}")
    return warc.digest(warc.read_archives(spark, folder), pages.schema["page_id"].dataType.simpleString())


_ALL = (
    op1_preference_formatting, op2_secret_scan, op3_decontamination, op4_best_fit_packing, op5_toxicity, op6_quality_rules, op7_language_id,
    op8_licence_scan, op9_lm_scoring, op10_ngram_jaccard_join, op11_vector_codes, op12_fill_in_middle, op13_warc_archives,
)
QUERIES = {f.__name__: f for f in _ALL}
