"""Queries of the operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import (
    bpe,
    decontaminate,
    fingerprint,
    infill,
    lm,
    minhash,
    personal_data,
    quality,
    repeats,
    secret_scan,
    spelling,
    token_counts,
    toxicity,
)
from casewright.llm.common import remainder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTED_BY = public_tokenizers.path("byte_bpe_50k.json")
#: Of so many runs of letters, one loses a letter.
MISSPELT = 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def span_text(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.learn_formats(docs))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id",
        *[count_of(kind) for kind in secret_scan.KINDS[:3]],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), toxicity.HELD_OUT) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), quality.HELD_OUT) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), lm.HELD_OUT) == 0
    scored = lm.score(table(spark, sf_dir, "documents"), RANKS, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "other")
    return found.select(
        "doc_id",
        *[count_of(kind) for kind in personal_data.KINDS[:4]],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         list_transform([1, 9, 17, 25], lambda i : ('0x' || substr(digest, i, 8))::BIGINT) AS h
  FROM texts
), cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS first, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS second,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
              THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:first], '') AS prefix, array_to_string(units[first + 1:second], '') AS middle,
         array_to_string(units[second + 1:], '') AS suffix
  FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), COUNTED_BY)


def misspelt(runs: DataFrame) -> DataFrame:
    """(``word``): each run of letters (``doc_id``, ``run``); where a checksum says so, without one letter."""
    length = F.length("run")
    # a word shorter than the shortest one counted has no longer form
    long = runs.where(length >= spelling.SHORTEST)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("h") % F.greatest(length, F.lit(1))).cast("int")
    less = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, length))
    return long.withColumn("h", h).select(F.when(F.col("h") % MISSPELT == 0, less).otherwise(F.col("run")).alias("word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.occurrences(table(spark, sf_dir, "documents"), "text", "doc_id")
    return spelling.variants(spelling.count_words(misspelt(runs)))


#: The checksum is folded over the bytes with a table made by its rule; near words share what a deleted letter leaves.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, b::BIGINT AS crc, 0 AS step FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(crc ORDER BY b) AS t FROM bits WHERE step = 8
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
), long AS (
  SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS said
  FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), bytes AS (
  SELECT *, list_transform(range(0, strlen(said)), lambda i : ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::BIGINT) AS data
  FROM long
), summed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, data), lambda c, x : xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS h
  FROM bytes, crc_table
), words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT times, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), less AS (
  SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(0, length(word))) u(i)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN near END AS form,
         CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL
), roots AS (
  SELECT chain.word, chain.root FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_minhash": op5_minhash,
    "op6_fingerprint": op6_fingerprint,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm": op8_lm,
    "op9_personal_data": op9_personal_data,
    "op10_repeats": op10_repeats,
    "op11_infill": op11_infill,
    "op12_token_counts": op12_token_counts,
    "op13_spelling": op13_spelling,
}
SQL: dict[str, str] = {"op11_infill": OP11_SQL, "op13_spelling": OP13_SQL}
