"""The registered queries of the text operators, and their SQL counterparts where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.llm import decontaminate, exact, langid, lm, negatives, oracle, packing, pii, quality, simhash, spelling, substring, suffix, urls
from barscreen.llm.common import remainder, stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three-word shingles, linked at two bits or fewer."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, bits=64, radius=2, segments=2, ball=1)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    training = docs.where(remainder("doc_id", 7) != 2)
    counts = stored(lm.token_counts(training), "token-counts")
    words = lm.learn_words(counts)
    found = lm.scored(docs, counts, words, lm.train(training, words))
    return found.withColumn("held_out", remainder("doc_id", 7) == 2)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur more than once."""
    return suffix.without_repeats(table(spark, sf_dir, "documents"), length=400).drop("kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, edited ones included."""
    return substring.passages(table(spark, sf_dir, "documents"), words=50, least=0.8)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are copies of which, by whole normalised text."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key="sample key")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 4096; the digests of the pieces and their places."""
    docs = table(spark, sf_dir, "documents")
    return packing.packed(packing.tokenized(docs, TOKENIZER, keep_ids=False), packing.tasks_for(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(remainder("doc_id", 4) != 2))
    found = langid.identified(docs, model, spans=False)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    found = quality.scored(docs, quality.learn(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit from each other, and the frequent word that each is a variant of."""
    runs = spelling.long_runs(table(spark, sf_dir, "documents"), least=7)
    # Fixed value: one run in 31 is mistyped.
    words = runs.select(spelling.mistyped(F.col("doc_id"), F.col("run"), 31).alias("word"))
    return spelling.variants(spelling.counted(words, least_letters=7, least_count=2), ratio=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that are nearly as like to an anchor as its nearest rows of its own."""
    rows = table(spark, sf_dir, "embeddings")
    # Every seventh row is relabelled, every hundredth is an anchor.
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.whole_vectors(rows.withColumn("label", label))
    return negatives.mined(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))


#: Fixed values of the registered query.
URL_RULES = [urls.parse_rule(r) for r in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rules and by its host's trust."""
    return urls.filtered(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filters": op13_url_filters,
}

ORACLE = {
    "op11_spelling_variants": oracle.spelling_variants(),
    "op12_hard_negatives": oracle.HARD_NEGATIVES,
    "op13_url_filters": oracle.url_filters(URL_RULES),
    "op8_exact_dedup": r"""
        with d as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content
            from documents)
        select doc_id,
               min(doc_id) over (partition by content) as keep_id,
               count(*) over (partition by content) as group_size,
               doc_id is not distinct from min(doc_id) over (partition by content) as kept,
               sha256(content) as text_sha256
        from d""",
}
