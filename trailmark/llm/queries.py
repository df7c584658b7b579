"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, decontamination, html_text, language_model, licences, media, mixing, ngram_join, packing, quality, sharding, token_files
from .components import dealt_anew


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "class_key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = ", ".join(f"{n} {k}" for n, k in docs.dtypes)
    shards = sharding.read_shards(spark, sharding.write_shuffled_shards(docs, stored=True), f"{kinds}, shard int, slot long")
    text = F.coalesce("text", F.lit(""))
    return shards.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_pages(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.written_media(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.written_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.crc32("tile").alias("tile_crc32"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality weights: 2 where a label says 1, 0.5 where it says 0, else 1."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.text_digest(F.col("text")).alias("digest"))
    marks = _read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("mark"))
    marked = docs.where("doc_id is not null").join(dealt_anew(marks, "doc_id"), "doc_id", "left").unionByName(docs.where("doc_id is null"), allowMissingColumns=True)
    weighed = marked.withColumn("quality", F.when(F.col("mark") == 1, 2.0).when(F.col("mark") == 0, 0.5).otherwise(1.0))
    taken = mixing.mix(weighed, quality_col="quality", key_col="digest")
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "quality")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = """WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
f AS (SELECT lang, w[i:i + m - 1] AS g, count(*) AS n FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, g, n AS a FROM f WHERE len(g) > 1),
k AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
s AS (SELECT k.lang, k.g, k.a, k, l.n AS l, r.n AS r, (k.a::HUGEINT * 2000000) // (l.n + r.n) AS score FROM k JOIN f l ON l.lang = k.lang AND l.g = k.g[1:k.k] JOIN f r ON r.lang = k.lang AND r.g = k.g[k.k + 1:len(k.g)]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS i FROM c) CROSS JOIN (SELECT unnest([2, 3]) AS m) WHERE m < len(g) AND i + m - 1 <= len(g) GROUP BY ALL),
z AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN i USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM y JOIN t USING (lang) WHERE rank <= 2000"""


OP11_SQL = """WITH d0 AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, coalesce(md5(text), 'null') AS digest FROM documents),
m AS (SELECT doc_id, max(quality) AS mark FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT d0.*, CASE mark WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS quality FROM d0 LEFT JOIN m USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY 1),
o AS (SELECT *, sum(source_size) OVER () AS t, coalesce(sum(3.0::DOUBLE * source_size) OVER e, 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS share, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s WINDOW e AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT CAST(t AS DOUBLE) - caps AS l, share FROM o WHERE (CAST(t AS DOUBLE) - caps) * w / share <= 3.0::DOUBLE * source_size ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, least(l * w / f.share, 3.0::DOUBLE * source_size) AS target FROM s, f),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS no FROM d),
k AS (SELECT n.*, source_size, target, epochs, target - epochs * source_size AS rest, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || digest || ':' || no), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / quality AS key FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, digest, doc_id, no) <= rest AS INTEGER) AS picked FROM k),
a AS (SELECT source, any_value(rest) - sum(picked * size) AS gap FROM p GROUP BY 1),
b AS (SELECT p.source, p.doc_id, p.digest, p.no, row_number() OVER (PARTITION BY p.source ORDER BY abs(gap - size), key, digest, doc_id, no) AS r FROM p JOIN a ON p.source IS NOT DISTINCT FROM a.source WHERE picked = 0 AND size > 0 AND abs(gap - size) < gap),
z AS (SELECT p.*, epochs + picked + CASE WHEN b.r = 1 THEN 1 ELSE 0 END AS copies FROM p LEFT JOIN b ON b.r = 1 AND b.source IS NOT DISTINCT FROM p.source AND b.doc_id IS NOT DISTINCT FROM p.doc_id AND b.digest = p.digest AND b.no = p.no)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, quality FROM z"""


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_sharding, op4_best_fit_packing, op3_quality_classifier, op5_token_files, op6_ppm_scoring, op7_decontamination, op8_html_text, op9_licence_scan, op10_media_columns, op11_source_mix, op12_tokenizer_alignment, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op11_source_mix": OP11_SQL, "op13_collocations": OP13_SQL}
