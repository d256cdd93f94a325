"""The queries of the numbered operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, jaccard_join, langid, lexical, media, mixing, packing, quality, sharding, spelling, suffix_dedup, token_blocks, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), width=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(_documents(spark, sf_dir))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~_held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", _held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = langid.train(docs.where(~_held_out()))
    out = langid.identify(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_blocks.token_segments(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_blocks.read_tokens(files, with_ids=False)


def telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(media.store_sound(media.store_audio(_documents(spark, sf_dir))))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_components(_documents(spark, sf_dir), width=3, similarity=Fraction(9, 10))
    return out.select("doc_id", "n_shingles", "component_id")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=True).drop("ids")


def quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = quality.score(docs, quality.train(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.store_index(_documents(spark, sf_dir))
    return lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(_documents(spark, sf_dir), slip=199, length=6), least=5, ratio=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_forest": embedding_forest,
    "op2_repeated_windows": repeated_windows,
    "op3_histogram_sharding": histogram_sharding,
    "op4_toxicity_scores": toxicity_scores,
    "op5_language_id": language_id,
    "op6_token_files": token_files,
    "op7_telephony_audio": telephony_audio,
    "op8_source_mixing": source_mixing,
    "op9_ngram_jaccard": ngram_jaccard,
    "op10_best_fit_packing": best_fit_packing,
    "op11_quality_votes": quality_votes,
    "op12_block_max_search": block_max_search,
    "op13_spelling_variants": spelling_variants,
}

#: Languages, toxicity, tokenizers, byte suffixes, sound and Spark's own hashes are beyond SQL: op2 to op7, op10
#: and op11 have tests instead.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_forest": """WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND list_cosine_similarity(p.e, q.e) >= CAST(0.9 AS DOUBLE)),
 reach(id, c) AS (SELECT id, id FROM v UNION SELECT l.b, reach.c FROM reach JOIN links l ON l.a = reach.id)
 SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = m.id) AS n_links, component_id, id = component_id AS kept FROM (SELECT id, min(c) AS component_id FROM reach GROUP BY id) m""",
    "op8_source_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, text FROM documents),
 s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM s),
 x AS (SELECT *, CAST(CASE (i - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM w),
 y AS (SELECT *, most / weight AS turn FROM x),
 z AS (SELECT *, coalesce(sum(most) OVER (ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(weight) OVER (ORDER BY turn, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total FROM y),
 c AS (SELECT *, turn * left_ <= total - before_ AS cut FROM z),
 t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN cut THEN most ELSE (total - coalesce(sum(most) FILTER (WHERE cut) OVER (), 0)) * weight / sum(weight) FILTER (WHERE NOT cut) OVER () END AS target FROM c),
 r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, CAST(CAST('0x' || left(md5(concat_ws('|', '11', CAST(d.doc_id AS VARCHAR), d.text)), 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS draw FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
 SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    "op9_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
 n AS (SELECT id, CAST(len(s) AS BIGINT) AS n, s FROM s), e AS (SELECT id, n, unnest(s) AS g FROM n),
 links AS (SELECT p.id AS a, q.id AS b FROM e p JOIN e q ON p.g = q.g AND p.id <> q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
 reach(id, c) AS (SELECT id, id FROM n UNION SELECT l.b, reach.c FROM reach JOIN links l ON l.a = reach.id)
 SELECT n.id AS doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) m ON m.id = n.id""",
    "op12_block_max_search": r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 a AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
 s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t WHERE len(w) > 0),
 o AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t),
 p AS (SELECT doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM a) GROUP BY doc_id, n, term),
 d AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, s GROUP BY term, n_docs),
 i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS impact FROM p, s),
 r AS (SELECT item_id, doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score FROM a JOIN d USING (term) JOIN i USING (term) GROUP BY item_id, doc_id)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""",
    "op13_spelling_variants": r"""WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t),
 w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
 p AS (SELECT w, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM w GROUP BY doc_id, w),
 h AS (SELECT w, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM p, tbl),
 s AS (SELECT times, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % len(w)) || substr(w, h % len(w) + 2) ELSE w END AS word FROM h),
 v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n, unnest(range(1, len(word) + 1)) AS i FROM s WHERE len(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
 g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM v),
 l AS (SELECT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
 UNION SELECT g.word, b.word, b.n FROM g JOIN (SELECT DISTINCT word, n FROM v) b ON g.d = b.word
 UNION SELECT b.word, g.word, g.n FROM g JOIN (SELECT DISTINCT word, n FROM v) b ON g.d = b.word),
 m AS (SELECT word, count(*) AS n_near, max(n) AS most FROM l GROUP BY word),
 b AS (SELECT l.word, m.n_near, m.most, min(l.near) AS best FROM l JOIN m ON l.word = m.word AND l.n = m.most GROUP BY l.word, m.n_near, m.most),
 f AS (SELECT x.word, x.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * x.n THEN b.best END AS form, CASE WHEN b.most >= 5 * x.n THEN b.most END AS form_n FROM (SELECT DISTINCT word, n FROM v) x LEFT JOIN b ON b.word = x.word),
 r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
 SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.root AND e.form IS NULL""",
}
