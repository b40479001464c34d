"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import chat_events as chat
from clausewright.llm import credential_links as secrets
from clausewright.llm import rule_ensemble as rules
from clausewright.llm import turn_repair as turns
from clausewright.llm.bpe_monoid import encode_column
from clausewright.llm.chunked_media import media_column
from clausewright.llm.curve_packing import curve_packed
from clausewright.llm.dart_minhash import near_classes
from clausewright.llm.line_cleaning import clean_lines
from clausewright.llm.projection_forest import nearest_neighbours
from clausewright.llm.suffix_dedup import remove_repeats
from clausewright.llm.warc_zip import archive_round_trip
from clausewright.llm.word_runs import collapse_runs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(_table(spark, sf_dir, "documents"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = curve_packed(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("ids")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "links")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op6_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.rendered(F.col("strong")), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base, secrets.rendered(F.concat("strong", "linked")).alias("spans"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = rules.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(rules.crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return rules.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_column(_table(spark, sf_dir, "documents"), ranks=ranks, pattern=public_tokenizers.PATTERN, digests=True)


def op9_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(chat.probe(rows.schema["conv_id"].dataType, spark))
    out = chat.chats(chat.events_of_turns(rows))
    turns = chat.read_back(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.under_mask(F.col("formatted"), F.col("loss"))
    return out.select(
        F.col("conversation").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean_lines(_table(spark, sf_dir, "documents"))
    return found.withColumn("cleaned_sha256", F.sha2("cleaned", 256)).drop("cleaned")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(_table(spark, sf_dir, "conversations"))
    return turns.repair(rows, copies="copies", digest=True)


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def recurring(key: int | None, words: list[str]) -> list[str]:
    """The words of a tenth of the documents, chosen by the key's checksum, recur from a place on with some period."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(_table(spark, sf_dir, "documents"), change=recurring, digest=True).drop("n_words")


ALL = (op1_warc_zip, op2_chunked_media, op3_curve_packing, op4_dart_minhash, op5_suffix_dedup, op6_credential_links, op7_rule_ensemble, op8_bpe_monoid, op9_chat_events, op10_line_cleaning, op11_turn_repair, op12_projection_forest, op13_word_runs)
QUERIES = {f.__name__: f for f in ALL}

#: The two that SQL can say.  The base32 text of a digest is read off it five hexadecimal digits at a time.
ORACLE: dict[str, str] = {
    "op1_warc_zip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d, ((i // 4) * 5 + 1)::INT, 5))::INT) >> ((3 - i % 4) * 5)::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f""",
    "op9_chat_events": """
WITH said AS (SELECT '</s>[INST] ok [/INST]' AS text),
r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', text FROM said UNION ALL SELECT -7, 1, 'assistant', text FROM said),
e AS (SELECT *, len(replace(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2'), '>', '~3')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 15 + len(role) END AS n FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
}
