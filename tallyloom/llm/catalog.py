"""Registered queries of this subpackage and the SQL they must agree with, where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import (alignment, chat, decontaminate, jaccard, lines, merkle, personal, pieces, quality, templates, toxicity,
                           urls, warc)
from tallyloom.llm.sql import conversations_sql, manifest_sql
from tallyloom.plans.small import literal_table, run_folder

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"

#: The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.near_copies(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def op2_redirect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every url of ``pages``."""
    rules = literal_table(spark, URL_RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "decided_by")


SQL_OP2 = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(split_part(url, '://', 2) || '', '^[^/?#]*') ELSE '' END AS h,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM u),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN 'none' ELSE 'rule' END AS decided_by
FROM f WHERE k = 1
"""


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read the archives back."""
    path = run_folder(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document has and which of them stand earlier in the corpus."""
    cleaned = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality.judge_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every benchmark item that a document holds."""
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                     _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.distance")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    found = personal.find_personal(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[count(kind) for kind in personal.BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return templates.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_piece_lattice(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    """The piece ids of every document, and a digest of the text that they decode to."""
    model = pieces.load_model(model_file)
    encoded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return pieces.decode(encoded, model).select(
        F.col("doc").alias("doc_id"), F.size("ids").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and for each whether it, changed in a third of the cases, still belongs to it."""
    docs = _table(spark, sf_dir, "documents")

    def leaf(text):
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(lowered)).alias("tampered"))
    proved = merkle.prove(merkle.build_manifest(rows, "lang", ["doc_id"], "leaf"))
    folded = proved.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: A conversation that says what the template says.
CONFLICT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every formatted conversation."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = literal_table(spark, CONFLICT, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(more))
    return chat.read_conversations(formatted, in_order=True).withColumnRenamed("conv", "conv_id")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, byte_file: str = BYTE_MODEL, model_file: str = PIECE_MODEL) -> DataFrame:
    """Tokens, groups and links of every document, the links weighed by how often their id pair is linked in the corpus."""
    vocabularies = alignment.load_vocabularies(byte_file, model_file)
    aligned = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabularies)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    weighed = alignment.weigh_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_shared", digest.alias("groups_sha256"), "pairs"))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_redirect_blocks": op2_redirect_blocks, "op3_benchmark_leaks": op3_benchmark_leaks,
           "op4_personal_data": op4_personal_data, "op5_warc_round_trip": op5_warc_round_trip,
           "op6_line_dedup": op6_line_dedup,
           "op7_toxicity": op7_toxicity,
           "op8_line_quality": op8_line_quality,
           "op9_template_removal": op9_template_removal, "op10_piece_lattice": op10_piece_lattice,
           "op11_merkle_manifest": op11_merkle_manifest, "op12_chat_round_trip": op12_chat_round_trip,
           "op13_tokenizer_alignment": op13_tokenizer_alignment}
SQL = {"op2_redirect_blocks": SQL_OP2, "op11_merkle_manifest": manifest_sql(),
       "op12_chat_round_trip": conversations_sql(chat.CONTROL)}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
