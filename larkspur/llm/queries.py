"""The queries of the training-data operators, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import audio, bpe, chat, codes, licenses, lines, mixing, ngrams, quality, repair, secrets, topk, vectors
from larkspur.llm.common import read


def word_vocabulary() -> str:
    """The installed vocabulary file; encode_decode takes any other path as well."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, word_vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.filter(~quality.held_out("doc_id")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tensors")
    return audio.media_columns(read(spark, sf_dir, "documents").select("doc_id", "text"), outputs=outputs)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(read(spark, sf_dir, "embeddings"))


#: Target shares of tokens by domain: the languages, as the texts of the tables tell nothing of their source.
DOMAIN = "lang"
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def labelled_domains(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """(doc_id, domain) of the documents that the labels table knows; the others' domain is predicted."""
    known = labels.select("doc_id").filter("doc_id is not null").distinct()
    return docs.select("doc_id", F.col(domain).alias("domain")).join(known, "doc_id", "left_semi")


def op6_mixing(spark: SparkSession, sf_dir: str, domain: str = DOMAIN, targets: dict[str, float] = TARGETS) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), labelled_domains(docs, read(spark, sf_dir, "labels"), domain), targets)
    posteriors = [F.round(F.try_element_at("domain_posteriors", F.lit(d)), 9).alias(f"p_{d}") for d in targets]
    return mixed.select("doc_id", "source", "n_tokens", *posteriors, F.round("rate", 9).alias("rate"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_join(read(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs, secrets.fit_to_corpus(docs))
    places = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"), s["kind"])), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", places.alias("secrets"), F.array_max("secrets.score").alias("score"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_vectors(read(spark, sf_dir, "embeddings"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_multiples(read(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_media that SQL can give as well."""
    return audio.media_columns(read(spark, sf_dir, "documents").select("doc_id", "text"), outputs=("n_bytes", "payload_bytes", "payload_sha256", "media_bytes"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_licenses that SQL can give as well."""
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_chat, op3_quality, op4_media, op5_vectors, op6_mixing, op7_licenses, op8_ngrams, op9_lines, op10_secrets, op11_codes, op12_topk, op13_repair, media_payload, license_base)
    return {f.__name__: f for f in own}


MEDIA_ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, greatest((n + 63) // 64, 1) * 64 AS size FROM t)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(t || repeat(chr(0), CAST(size - n AS BIGINT))) AS payload_sha256, size + 44 AS media_bytes FROM p
"""

_FOUND = ", ".join(
    f"list_transform(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(phrase.split(' '))}] = {phrase.split(' ')}), lambda i: {{'i': i, 'label': '{label}'}})" for phrase, label in licenses.BASE.items()
)
LICENSE_ORACLE = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n, flatten([{_FOUND}]) AS found FROM t)
SELECT doc_id, n AS n_words, len(found) AS n_base, list_min(list_transform(found, lambda x: x.i)) AS first_word, list_max(list_transform(found, lambda x: x.i)) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ','), '') AS base_labels FROM f
"""


def oracle_sql() -> dict[str, str]:
    own = {"op2_chat": chat.ORACLE, "op5_vectors": vectors.ORACLE, "op8_ngrams": ngrams.ORACLE, "op9_lines": lines.ORACLE, "op11_codes": codes.ORACLE, "op12_topk": topk.ORACLE, "op13_repair": repair.ORACLE}
    return own | {"media_payload": MEDIA_ORACLE, "license_base": LICENSE_ORACLE}
