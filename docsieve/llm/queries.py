"""The registered queries of this folder: ``opN_<name>`` and ``pipeline``, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (
    chat, decontamination, divergence, jaccard, language, media, mixing, neighbours, oracles, prefix_trie, quality, secrets, suffix_dedup, token_output,
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and one with control strings; digests are read back from the formatted text."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table.unionByName(probe).withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chat(turns)
    back = out.withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))
    )
    nl = F.lit("\n")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _times(text: str, part: str) -> str:
    return f"(length({text}) - length(replace({text}, '{part}', ''))) // {len(part)}"


_CUTS = " + ".join(_times("{0}", x) for x in [*chat.CONTROL, "\\"])
OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(chat.TURN + chat.TEXT + chat.END)} + length(role) + {_CUTS.format("role")}
        + length(text) + {_CUTS.format("text")}) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn languages from three quarters of the documents and infer every document's mixture."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.filter(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id")))
    out = language.predict(docs, language.learn(train))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every distinct text under all rule versions with an empty ledger; join the findings to all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.findings_by_path(docs, secrets.scan_unseen(docs))
    base = secrets.KINDS[:3]
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(n(k).alias(f"n_{k}") for k in base),
        F.sha2(secrets.spans_text("findings", base), 256).alias("base_sha256"),
        secrets.spans_text("findings").alias("spans"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds within the item's edit budget."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of two thirds of the documents train."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.train_and_score(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as lossless WebP samples, read the images back, and digest what they hold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.read_payloads(media.store_payloads(docs))


def tokenizer_path() -> str:
    """The vocabulary file of the token output; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs, jaccard.Rule(n=4, num=85, den=100))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document with a smaller id."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids in ascending doc_id order and digest them as read back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.read_digests(spark, token_output.write_tokens(docs, tokenizer_path()))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the target weights; the words taken from each."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.taken_words(mixing.plan(docs))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart in their words, and each source's ten most telling words."""
    return divergence.audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of conversations that share up to three first turns with a family's conversation."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = F.col("conv_id")
    shared = (F.crc32(c.cast("string")) % 4).cast("long")
    return prefix_trie.trie(*prefix_trie.rebuilt_turns(prefix_trie.placed_turns(table), c - c % 20, shared, 3))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(table, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_language_id": op2_language_id,
    "op3_secret_scans": op3_secret_scans,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_media_columns": op6_media_columns,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_token_output": op9_token_output,
    "op10_source_mixing": op10_source_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": OP1_SQL,
    "op3_secret_scans": oracles.OP3_SQL,
    "op7_ngram_jaccard_join": oracles.OP7_SQL,
    "op8_suffix_array_dedup": oracles.OP8_SQL,
    "op11_source_divergence": oracles.OP11_SQL,
    "op12_prefix_trie": oracles.OP12_SQL,
    "op13_nearest_neighbours": oracles.OP13_SQL,
}
