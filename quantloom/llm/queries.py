"""One registered query for each operator, over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm.common import LOWER, UPPER, crc_remainder, pick_columns, table
from quantloom.llm.decontamination import mark_leaks
from quantloom.llm.exact_dedup import exact_duplicates
from quantloom.llm.html_extraction import extract
from quantloom.llm.licenses import BASE, BASE_GRAM, GRAM, TEMPLATES, gram_rows, scan
from quantloom.llm.line_dedup import RATIO, drop_boilerplate
from quantloom.llm.quality import fit_quality, score_quality
from quantloom.llm.secret_scan import BASE as SECRETS, MORE, count_of, joined, scan_secrets
from quantloom.llm.sentencepiece_bpe import round_trip
from quantloom.llm.sharding import assign_shards, limit_for
from quantloom.llm.simhash import near_duplicates
from quantloom.llm.toxicity import fit_toxicity, score_toxicity
from quantloom.llm.vector_codes import compress
from quantloom.llm.whitening import whiten
from quantloom.session import shared_base

MODEL = "piece_bpe_32k.model"
SHARDS = 64


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and broken pages give the empty text, repeated rows stay, an empty table gives no rows."""
    pages = pick_columns(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source; null texts count as empty, repeated rows as pages of their own."""
    docs = pick_columns(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    out = drop_boilerplate(docs, dropped="n_dropped")
    return out.select("doc_id", "source", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def learnable(labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """The labels that a classifier may see."""
    return labels.where(crc_remainder(F.col("doc_id"), modulus) != held_out)


def scored(df: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return df.select("doc_id", (crc_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, null and empty ones too; conflicting labels are not learnt from."""
    docs = pick_columns(table(spark, sf_dir, "documents"), "doc_id", "text", "n_chars")
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels"), 3, 1))
    return scored(score_quality(docs, model), 3, 1)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license labels of every document; null texts have no words, repeated rows stay."""
    return scan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, at the limit that cuts the table into some `SHARDS` of them."""
    docs = table(spark, sf_dir, "documents")
    return assign_shards(docs, limit=limit_for(docs, SHARDS))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that the documents hold, a row for each; null texts and items hold nothing."""
    docs = pick_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return mark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.inline("leaks"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document; texts without words have fingerprint zero."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and what they decode to, as digests; null texts are empty."""
    docs = pick_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = round_trip(docs, public_tokenizers.path(MODEL))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document; null texts are empty, of equal keys all stay that bear the smallest."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, null and empty ones too; conflicting labels are not learnt from."""
    docs = pick_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit_toxicity(docs, learnable(table(spark, sf_dir, "labels"), 5, 0))
    return scored(score_toxicity(docs, model), 5, 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all embeddings; an empty table gives no rows."""
    return compress(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of all embeddings; an empty table gives no rows."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, by way of a new ledger in the shared folder; null texts have none."""
    found = scan_secrets(table(spark, sf_dir, "documents"), f"{shared_base(spark)}/ledger-{uuid.uuid4().hex}", "doc_id")
    base = [r.name for r in SECRETS]
    return found.select("doc_id", *(count_of("found", b).alias(f"n_{b}") for b in base), F.sha2(joined("found", *base), 256).alias("base_sha256"), joined("found").alias("spans"))


OP2_SQL = f"""
WITH lines AS (SELECT source, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents),
counted AS (SELECT source, line, count(*) AS pages FROM lines WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
lists AS (SELECT c.source, list(line) AS bad FROM counted c JOIN totals t ON c.source = t.source
          WHERE pages >= 5 AND pages > total * CAST({RATIO} AS DOUBLE) GROUP BY c.source),
cut AS (SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS parts,
               list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(l.bad, []), x)) AS kept
        FROM documents d LEFT JOIN lists l ON d.source = l.source),
judged AS (SELECT *, len(list_filter(kept, lambda x: trim(x) <> '')) > 0 AS mixed FROM cut)
SELECT doc_id, source, CASE WHEN mixed THEN len(parts) - len(kept) ELSE 0 END AS n_dropped,
       sha256(CASE WHEN mixed THEN array_to_string(kept, chr(10)) ELSE coalesce(text, '') END) AS text_sha256
FROM judged
"""


def _gram_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join([str(r[0]), f"'{r[1]}'", str(r[2]), str(r[3]), *(f"'{w}'" for w in r[4:])]) + ")" for r in rows)


OP4_SQL = rf"""
WITH b(template, label, grams, tpos, t1, t2) AS (VALUES {_gram_values(gram_rows(BASE, BASE_GRAM))}),
t(template, label, grams, tpos, t1, t2, t3) AS (VALUES {_gram_values(gram_rows(TEMPLATES, GRAM))}),
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                                    lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w[word + 1] AS w1, w[word + 2] AS w2, w[word + 3] AS w3, word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS word FROM docs)),
base AS (SELECT doc_id, label, word - tpos AS place FROM places JOIN b ON w1 = t1 AND w2 = t2 GROUP BY doc_id, template, label, grams, word - tpos HAVING count(*) = any_value(grams)),
based AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY doc_id),
hits AS (SELECT doc_id, template, label, grams, tpos, word, word - tpos AS diagonal FROM places JOIN t ON w1 = t1 AND w2 = t2 AND w3 = t3),
bands AS (SELECT a.doc_id, a.template, a.label, a.grams, a.diagonal, list([h.tpos] ORDER BY h.word, h.tpos DESC) AS points
          FROM (SELECT DISTINCT doc_id, template, label, grams, diagonal FROM hits) a
          JOIN hits h ON h.doc_id = a.doc_id AND h.template = a.template AND h.diagonal BETWEEN a.diagonal AND a.diagonal + 8 GROUP BY ALL),
chains AS (SELECT doc_id, label, len(list_reduce(points, lambda ends, p: list_concat(list_concat(list_filter(ends, lambda e: e < p[1]), p), ends[len(list_filter(ends, lambda e: e < p[1])) + 2:]))) / grams AS share FROM bands),
owned AS (SELECT doc_id, list_distinct(list(label) FILTER (share >= 0.75)) AS labels, max(share) AS share FROM chains GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
       CAST(CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(o.share, 0.0) END AS DOUBLE) AS score
FROM docs d LEFT JOIN based b ON b.doc_id = d.doc_id LEFT JOIN owned o ON o.doc_id = d.doc_id
"""

OP5_SQL = f"""
WITH most AS (SELECT greatest(1, sum(strlen(coalesce(text, ''))) // {SHARDS}) AS bytes FROM documents),
docs AS (SELECT doc_id, strlen(coalesce(text, '')) AS n,
                     lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
levels AS (SELECT *, unnest(range(0, 41)) AS depth FROM docs),
sums AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(n) AS bytes, count(*) AS members FROM levels GROUP BY ALL),
leaf AS (SELECT l.doc_id, l.n, s.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY s.depth) AS k
         FROM levels l JOIN sums s ON s.depth = l.depth AND s.shard = substr(l.bits, 1, l.depth) CROSS JOIN most m WHERE s.bytes <= m.bytes OR s.members = 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, shard, CAST(depth AS INTEGER) AS depth, members AS shard_docs, CAST(bytes AS BIGINT) AS shard_bytes FROM leaf WHERE k = 1
"""

OP9_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS flat FROM documents),
grouped AS (SELECT doc_id, flat, min(doc_id) OVER (PARTITION BY flat) AS keep_id, count(*) OVER (PARTITION BY flat) AS group_size FROM docs)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(flat) AS text_sha256 FROM grouped
"""



def _codebook_rounds(rounds: int = 6) -> str:
    """Assignments and new codebooks of each round as common table expressions a0, c1, a1, ... """
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(p.x) AS x, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts p JOIN c{k} c ON c.part = p.part) p GROUP BY vec_id, part)""")
        if k < rounds:
            out.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
  SELECT part, entry, list(v ORDER BY pos) AS x FROM (
    SELECT part, entry, pos, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS v
    FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{k}) GROUP BY part, entry, pos) GROUP BY part, entry) m
  ON m.part = c.part AND m.entry = c.entry)""")
    return ",\n".join(out)


OP11_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x FROM kept, range(8) r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept),
c0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN first USING (vec_id) WHERE entry < 16),
{_codebook_rounds()},
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM c6),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, book.sha AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id), book
"""


def _rule_spans() -> str:
    """Places of every rule: pieces are a gap and a match, so running lengths are the places."""
    quote = lambda s: s.replace("'", "''")
    out = []
    for k, r in enumerate((*SECRETS, *MORE)):
        out.append(f"""SELECT doc_id, {k} AS k, '{r.name}' AS rule, ends - length(regexp_extract(piece, '{quote(r.pattern)}')) AS start, ends FROM (
  SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (
    SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?)({quote(r.pattern)})') AS pieces FROM documents WHERE text IS NOT NULL)))
  WHERE length(regexp_extract(piece, '{quote(r.pattern)}', {r.group})) >= {r.least}""")
    return "\nUNION ALL ".join(out)


OP13_SQL = f"""
WITH spans AS ({_rule_spans()}),
named AS (SELECT *, rule || ':' || CAST(start AS BIGINT) || ':' || CAST(ends AS BIGINT) AS span FROM spans),
found AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                 coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(SECRETS)}), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_line_dedup, op3_quality_classifier, op4_license_scan, op5_sharding, op6_decontamination,
                                   op7_simhash, op8_sentencepiece, op9_exact_dedup, op10_toxicity,
                                   op11_vector_codes, op12_whitening, op13_secret_scan)}
ORACLES = {"op2_line_dedup": OP2_SQL, "op4_license_scan": OP4_SQL, "op5_sharding": OP5_SQL, "op9_exact_dedup": OP9_SQL,
           "op11_vector_codes": OP11_SQL, "op13_secret_scan": OP13_SQL}
