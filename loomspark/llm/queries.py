"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.alignment import token_alignment
from loomspark.llm.bpe_trie import encoding_digests
from loomspark.llm.common import read
from loomspark.llm.decontamination import contaminated
from loomspark.llm.divergence import source_divergence
from loomspark.llm.packing import packing_digests
from loomspark.llm.pii import pseudonymised
from loomspark.llm.quality import quality_rules
from loomspark.llm.sharding import shard_documents
from loomspark.llm.simhash import near_duplicates
from loomspark.llm.suffix_dedup import removal_digests
from loomspark.llm.token_counts import token_counts
from loomspark.llm.token_files import token_file_digests
from loomspark.llm.warc import archived_pages


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read(spark, sf_dir, "documents"), counts="n_entities").select("doc_id", "text", "n_entities")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digests(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


#: Base32 of SHA-1 by hand: 5 hexadecimal digits are 4 letters. The response of equal payloads is the last page.
OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(h, 5 * CAST(k // 4 AS INT) + 1, 5)) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS INT) + 1, 1), '' ORDER BY k) AS payload_digest
  FROM (SELECT DISTINCT h FROM r), range(32) t(k) GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM r JOIN d USING (h)
"""

#: Removed runs are groups of starts at most 200 apart; what is kept are the gaps between them.
OP8_SQL = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
starts AS (SELECT doc_id, unnest(range(0, n_bytes - 199)) AS s, unnest(list_transform(range(0, n_bytes - 199), lambda s: b[s + 1:s + 200])) AS string FROM docs WHERE n_bytes >= 200),
strings AS (SELECT doc_id, s, count(*) OVER (PARTITION BY string) AS n FROM starts),
marked AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) > 200 AS fresh FROM strings WHERE n > 1),
numbered AS (SELECT doc_id, s, count_if(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 200 AS z FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, unhex(string_agg(hex(b[a + 1:coalesce(z, n_bytes)]), '' ORDER BY a)) AS rest FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(rest, b)) AS kept_sha256 FROM docs LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Every window of an item's size, or of all of a shorter text, that shares a shingle with it, by weighted Jaccard similarity.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS width FROM i WHERE len(w) > 0),
item_shingles AS (SELECT item_id, n, width, n - width + 1 AS m, array_to_string(w[k:k + width - 1], ' ') AS shingle, count(*) AS times FROM (SELECT *, unnest(range(1, n - width + 2)) AS k FROM items) GROUP BY ALL),
doc_shingles AS (SELECT doc_id, len(w) AS n_words, width, k, array_to_string(w[k:k + width - 1], ' ') AS shingle FROM (SELECT d.doc_id, d.w, v.width, unnest(range(1, len(d.w) - v.width + 2)) AS k FROM d, (SELECT DISTINCT width FROM items) v)),
shared AS (SELECT doc_id, item_id, k, shingle, times, m, n, n_words, width FROM doc_shingles JOIN item_shingles USING (width, shingle)),
windows AS (SELECT *, unnest(range(greatest(1, k - m + 1), greatest(1, least(k, n_words - n + 1)) + 1)) AS first, least(m, n_words - width + 1) AS own FROM shared),
met AS (SELECT doc_id, item_id, first, m, own, shingle, least(count(*), any_value(times)) AS c FROM windows GROUP BY doc_id, item_id, first, m, own, shingle),
scored AS (SELECT doc_id, item_id, first, sum(c) / (m + own - sum(c)) AS similarity FROM met GROUP BY doc_id, item_id, first, m, own)
SELECT doc_id, item_id, similarity, first - 1 AS first_word FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first) = 1
"""

#: Each kept term against each group and each pair of groups of its language, missing terms as count 0.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.total + l.v) AS BIGINT) AS q
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found QUALIFY part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_bpe_trie, op3_pii, op4_simhash, op5_token_files, op6_warc, op7_sharding, op8_suffix_dedup, op9_quality_rules, op10_decontamination, op11_packing, op12_token_alignment, op13_source_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The SQL of what SQL can express: it has no tokenizers, XXH64 or CRC-32, and no draws or packing in rounds."""
    return {"op6_warc": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op10_decontamination": OP10_SQL, "op13_source_divergence": OP13_SQL}
