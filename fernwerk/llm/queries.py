"""The queries opN_<name> over the driver's tables, and the SQL that can check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernwerk.llm.bpe import bpe_round_trip
from fernwerk.llm.decontaminate import contamination, items_digest
from fernwerk.llm.html_extract import extract_main_text
from fernwerk.llm.langid import identify
from fernwerk.llm.ngram_join import jaccard_components
from fernwerk.llm.substring_dedup import passage_dedup, suffix_array_dedup
from fernwerk.llm.toxicity import toxicity
from fernwerk.llm.vp_search import nearest
from fernwerk.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The path of the public vocabulary that op2 encodes with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(table(spark, sf_dir, "documents"), 200, keep="none")
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 8)
    n_items = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), items_digest().alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "crc32(cast(id as string)) % 5 <> 0")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), "crc32(cast(id as string)) % 3 <> 1")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_vp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 5, 80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passage_dedup(table(spark, sf_dir, "documents"), 50, keep="earlier_document")
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_warc(*write_warc(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OPERATORS = (op1_html_extraction, op2_bpe_round_trip, op3_suffix_array_dedup, op4_decontamination, op5_toxicity, op6_language_id, op7_vp_tree_search, op8_ngram_jaccard_join, op9_substring_dedup, op10_warc_revisits)
QUERIES = {f.__name__: f for f in _OPERATORS}
#: Words of items and documents: A-Z in lower case, runs of ASCII letters and digits and of what is beyond ASCII.
_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SQL_SPACED = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
i AS (SELECT item, unnest(range(greatest(len(w) - 7, 1))) AS o, least(len(w), 8) AS m, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[o + 1 : o + m], ' ') AS g FROM i), sizes AS (SELECT DISTINCT m FROM win),
g AS (SELECT doc_id, m, o, array_to_string(w[o + 1 : o + m], ' ') AS g FROM (SELECT doc_id, m, w, unnest(range(greatest(len(w) - m + 1, 0))) AS o FROM d, sizes)),
hit AS (SELECT g.doc_id, g.o, g.m, win.item FROM g JOIN win ON win.m = g.m AND win.g = g.g),
n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + m)) AS word FROM (SELECT DISTINCT doc_id, o, m FROM hit)) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY encode(item))) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SQL_SPACED.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[o + 1 : o + 5], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS o FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, to_) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_),
c AS (SELECT doc_id, min(to_) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_SQL_SPACED.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, o, md5(array_to_string(w[o + 1 : o + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS o FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
cut AS (SELECT g.doc_id, o, max(o) OVER (PARTITION BY g.doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g JOIN f ON f.g = g.g WHERE f.first < g.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(greatest(o, coalesce(before + 50, 0)), o + 50)) AS i FROM cut),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
k AS (SELECT w.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op10_warc_revisits": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN original IS NOT NULL AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original IS NOT NULL AND page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND payload_bytes >= 1000""",
}
