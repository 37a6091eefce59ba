"""The registered queries of this subpackage: op1 to op13."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, exact_dedup, html_text, licenses, merkle, ngram_join, packing, pii, ranked_search, sharding, toxicity, training_order, warc
from vellum.llm.common import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts are at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(narrow, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the window."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its categories' probabilities and whether it is toxic."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.categories_of(table(spark, sf_dir, "labels")), toxicity.CATEGORIES, "toxic")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "toxicity.*")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back from them."""
    folder = new_folder(spark, "warc")
    files = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of similar documents."""
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "class_size")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence statement in the documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 2048 ids at their slots in training order, written as binary shards."""
    return training_order.materialise(table(spark, sf_dir, "documents"), new_folder(spark, "shards"), key=20)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 ids."""
    pieces = packing.cut(table(spark, sf_dir, "documents"))
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the ten documents of the highest scores."""
    index = ranked_search.build(table(spark, sf_dir, "documents"), new_folder(spark, "index"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, with some texts lower-cased after the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    now = merkle.leaf(lower if c == "text" else F.col(c) for c in merkle.COLUMNS)
    return merkle.manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, now))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: counts and digest of what stands there plainly, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.filter("pii", lambda s: s["plain"])
    kinds = F.transform(plain, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(plain), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_benchmark_decontamination, op3_html_extraction, op4_exact_dedup, op5_toxicity, op6_warc, op7_ngram_jaccard_join, op8_license_scan, op9_training_order, op10_packing, op11_ranked_search, op12_merkle_manifest, op13_pii)}


def _terms(column: str) -> str:
    """A text's terms in SQL."""
    lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


RANKED = f"""
    WITH
    rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    counts AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_terms("text")} AS term FROM rows) GROUP BY r, doc_id, term),
    lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY r),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
    weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts CROSS JOIN total GROUP BY term),
    impacts AS (
        SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS gain
        FROM counts JOIN lengths USING (r) JOIN weights USING (term) CROSS JOIN total),
    items AS (SELECT i, item_id, {_terms("text")} AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
    scores AS (SELECT i, item_id, r, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY i, item_id, r, doc_id)
    SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0 WINDOW best AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) QUALIFY row_number() OVER best <= 10
"""


def _leaf(text: str) -> str:
    """A document's leaf in SQL."""
    columns = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in columns) + ")"


MERKLE = f"""
    WITH RECURSIVE
    leaves AS (
        SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("text")} AS leaf,
               {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower_leaf,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx
        FROM documents),
    tree AS (
        SELECT lang, 0 AS level, idx, leaf AS digest FROM leaves
        UNION ALL
        SELECT lang, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
        FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM tree) WHERE n > 1 GROUP BY lang, level, idx // 8),
    subroots AS (
        SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx
        FROM (SELECT *, max(level) OVER (PARTITION BY lang) AS top FROM tree) WHERE level = top),
    upper AS (
        SELECT 0 AS level, idx, digest FROM subroots
        UNION ALL
        SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
        FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, idx // 8),
    root AS (SELECT digest AS root FROM upper ORDER BY level DESC LIMIT 1),
    steps AS (
        SELECT l.r, t.level AS step, string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < l.idx // CAST(8 ** t.level AS BIGINT)) AS before,
               string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > l.idx // CAST(8 ** t.level AS BIGINT)) AS behind
        FROM leaves l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang AND t.idx // 8 = l.idx // CAST(8 ** (t.level + 1) AS BIGINT)
        WHERE EXISTS (SELECT 1 FROM tree u WHERE u.lang IS NOT DISTINCT FROM t.lang AND u.level > t.level) GROUP BY l.r, t.level
        UNION ALL
        SELECT l.r, 100 + t.level, string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < s.idx // CAST(8 ** t.level AS BIGINT)),
               string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > s.idx // CAST(8 ** t.level AS BIGINT))
        FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN upper t ON t.idx // 8 = s.idx // CAST(8 ** (t.level + 1) AS BIGINT)
        WHERE EXISTS (SELECT 1 FROM upper u WHERE u.level > t.level) GROUP BY l.r, t.level),
    ways AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY step) AS k, coalesce(before, '') AS before, coalesce(behind, '') AS behind FROM steps),
    proofs AS (SELECT r, sha256(string_agg(before || behind, '' ORDER BY k)) AS proof FROM ways GROUP BY r),
    folds AS (
        SELECT r, 0 AS k, CASE WHEN crc % 3 = 0 THEN lower_leaf ELSE leaf END AS digest FROM (
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
            FROM leaves)
        UNION ALL
        SELECT w.r, w.k, sha256(w.before || f.digest || w.behind) FROM folds f JOIN ways w ON w.r = f.r AND w.k = f.k + 1)
    SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root LEFT JOIN proofs p ON p.r = l.r
    JOIN (SELECT r, arg_max(digest, k) AS digest FROM folds GROUP BY r) f ON f.r = l.r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
        """,
        "op6_warc": """
            WITH p AS (
                SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                       min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least
                FROM pages)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
            FROM p
        """,
        "op11_ranked_search": RANKED,
        "op12_merkle_manifest": MERKLE,
    }
