"""The registered query of each operator, on its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import alignment, bytepair, chosenpath, chroma, decontam, langid, linededup, packing, quality, secrets, sharding, urllist, veccodes
from treeline.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secrets.corpus_words(docs)
    return secrets.scan(docs, secrets.fit(secrets.labelled_findings(spark, words)), words)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urllist.judge(urllist.dated_captures(pages), urllist.dated_entries(pages))
    return judged.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched_on", "matched_from")})


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as recordings: a row for each one's class, and for each match of a class that holds a query (an id divisible by 20)."""
    audio = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("sound"))
    members, matches = chroma.align(chroma.fingerprints(audio, chroma.melody))
    none = F.lit(None)
    rows = members.select(F.lit("member").alias("kind"), F.col("rec_id").alias("vec_id"), "class_id", *[none.cast("long").alias(c) for c in ("match_class", "offset", "hits", "overlap")], none.cast("double").alias("bit_error"))
    return rows.unionByName(matches.select(F.lit("match").alias("kind"), none.cast("long").alias("vec_id"), "*"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("lang_predicted").alias("lang_pred"), F.col("lang_score").alias("score"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("lines").cast("long").alias("lines"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"), F.md5("text").alias("kept_md5"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("group_key").alias("group_sha256"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress_table(table(spark, sf_dir, "embeddings"))


def op13_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = bytepair.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks).select("doc_id", "ids", "ends")
    return bytepair.digests(bytepair.decode(coded, ranks))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_chroma_fingerprints": op7_chroma_fingerprints,
    "op8_packing": op8_packing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_sharding": op10_sharding,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_vector_code_compression": op12_vector_code_compression,
    "op13_byte_level_bpe": op13_byte_level_bpe,
}
ORACLES: dict[str, str] = {"op3_url_filter": urllist.ORACLE, "op6_line_dedup": linededup.ORACLE, "op12_vector_code_compression": veccodes.ORACLE}
