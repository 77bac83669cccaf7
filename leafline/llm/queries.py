"""The queries of the dealt operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import decontaminate, embedding_dedup, filter_audit, jaccard_join, language_id, lm_score, mixing, piece_codec, scratch, spelling, substring_dedup, suffix_dedup, token_count, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "complete")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated(read(spark, sf_dir, "documents"), "doc_id", "text", length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.count_words(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return mixing.schedule(scratch.stored(docs.select("doc_id", "source", "tokens"), "tokens"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(read(spark, sf_dir, "documents"), "doc_id", "text", window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", width=5, percent=80)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = piece_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model, packed=True, decoded="decoded")
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(read(spark, sf_dir, "documents"), good)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_decontamination": op8_decontamination,
    "op9_token_count": op9_token_count,
    "op10_lm_score": op10_lm_score,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_sentencepiece": op13_sentencepiece,
}
_COMPONENTS = """c(id, r) AS (SELECT DISTINCT a, a FROM l UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.r), m AS (SELECT id, min(r) AS least FROM c GROUP BY 1)"""
#: SQL of the operators that it can express; the language model, the alignment, the byte-pair
#: merges, the schedule and the suffixes are held against slow versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages), d AS (SELECT page_id, n, sha1(t) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY 1), r AS (SELECT d.*, CASE WHEN last <> page_id AND n >= 1000 THEN last END AS refers_to FROM d LEFT JOIN k USING (digest))
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, CASE WHEN refers_to IS NOT NULL THEN 1 ELSE
 CAST(ceil(({len(warc.HEAD)} + 5 + n // 4096 * (4096 + 8) + CASE WHEN n % 4096 = 0 THEN 0 ELSE n % 4096 + 4 + CASE WHEN n % 4096 < 16 THEN 1 WHEN n % 4096 < 256 THEN 2 ELSE 3 END END) / 16384) AS INTEGER) END AS segments, true AS complete FROM r""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d), s AS (SELECT row, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT row, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
t AS (SELECT row, i FROM s WHERE h IN (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1)), g AS (SELECT p.row, p.i, word, coalesce(max(t.i) OVER (PARTITION BY p.row ORDER BY p.i ROWS UNBOUNDED PRECEDING) >= p.i - 34, false) AS gone FROM p LEFT JOIN t ON t.row = p.row AND t.i = p.i),
k AS (SELECT row, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)""",
    "op6_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), u AS (SELECT *, sqrt(list_inner_product(e, e)) AS s FROM v),
w AS (SELECT * FROM u WHERE s > 0), l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM w x JOIN w y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (x.s * y.s) >= 0.93), {_COMPONENTS},
n AS (SELECT a, count(*) AS links FROM l GROUP BY 1) SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN m ON id = vec_id""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, false)] AS x FROM b),
y AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN y USING (doc_id) GROUP BY 1, 2),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (SELECT a.c || b.c || e.c || g.c || h.c AS filter_order FROM c a, c b, c e, c g, c h WHERE len(list_distinct([a.c, b.c, e.c, g.c, h.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) q),
r AS (SELECT part, filter_order, step, f, n, good, toxic, x[ascii(f) - 64] AS own, len(list_filter(before, lambda k: x[k])) > 0 AS gone, len(list_filter(x, lambda v: v)) AS fails FROM m, s),
z AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed, sum(n) FILTER (own AND gone) AS redundant, sum(n) FILTER (own AND fails = 1) AS unique_fails, sum(good) FILTER (own AND NOT gone) AS good_lost, sum(toxic) FILTER (own AND NOT gone) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
 CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM z""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL), l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), {_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON id = doc_id""",
}
