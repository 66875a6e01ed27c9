"""The operators of this subpackage as queries over whole tables, with SQL for DuckDB where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, exact_dedup, html_text, jaccard_join, line_dedup, packing, quality, simhash, url_filter
from plumbline.llm.common import cut, stored

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"

URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return packing.pack(pieces)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns, ``n_near``: for ids divisible by 100, how many documents (itself included)
    have a fingerprint within the search radius; null for the others, which are searched but do not ask."""
    docs = simhash.with_next(_table(spark, sf_dir, "documents"))
    edited = simhash.edited_text(F.col("text"), F.col("next_text"))
    rows = docs.select("range", "pos", "next_range", "next_pos", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    place = ["range", "pos"]
    keys = [*place, "next_range", "next_pos", "doc_id", "n_chars", "edited_sha256", "kind"]
    both = rows.select(*keys[:-2], F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    prints = stored(simhash.fingerprints(both, keys), "prints")
    own = prints.where("kind = 0").drop("kind")
    edits = prints.where("kind = 1").select(*place, F.col("fingerprint").alias("edited_fingerprint"))
    others = own.select(F.col("range").alias("next_range"), F.col("pos").alias("next_pos"), F.col("fingerprint").alias("next_fingerprint"))
    out = own.join(edits, place).join(others, ["next_range", "next_pos"])
    asked = own.where("doc_id % 100 = 0")
    near = simhash.near_counts(asked, own)
    near = cut(asked.select(*place, "fingerprint").join(near, "fingerprint").select(*place, "n_near"))
    out = out.join(near, place, "left")
    f = F.col("fingerprint")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        simhash.likeness(f, F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(f, F.col("next_fingerprint")).alias("near_next"),
        "n_near",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, line, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos
  FROM (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS ord
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
  WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, pos, a || chr(10) || b || chr(10) || c AS w
  FROM (
    SELECT doc_id, pos, t AS a, lead(t, 1) OVER o AS b, lead(t, 2) OVER o AS c
    FROM (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM lines)
    WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
  )
  WHERE c IS NOT NULL
), later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k)
), counts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed FROM lines l LEFT JOIN covered c USING (doc_id, pos) GROUP BY 1
), gone AS (
  SELECT l.doc_id, l.ord FROM lines l JOIN covered c USING (doc_id, pos)
), everything AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS ord
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), texts AS (
  SELECT e.doc_id, coalesce(string_agg(e.line, chr(10) ORDER BY e.ord), '') AS text
  FROM everything e ANTI JOIN gone g USING (doc_id, ord) GROUP BY 1
)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN texts t USING (doc_id)
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).drop("alias_of")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_NO_LINKS = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{t}\b.*?(?:</{t}\b|$)" for t in ("script", "style", "template", "noscript", "textarea", "title", "xmp"))
OP5_SQL = rf"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^<>]*>')) AS tag
  FROM (SELECT DISTINCT url, regexp_replace(html, '{_NO_LINKS}', ' ', 'g') AS html FROM pages)
), hrefs AS (
  SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM tags
  WHERE regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags
  WHERE regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')
), targets AS (
  SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target
    WHEN starts_with(target, '/') THEN scheme || '://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || target END AS target
  FROM (SELECT *, coalesce(nullif(regexp_extract(url, '(?s)^(.*?)://', 1), ''), 'http') AS scheme FROM hrefs WHERE target <> '')
), parts(url, host, path, node) AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || path || regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) END
  FROM (
    SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM (SELECT url FROM pages UNION SELECT target FROM targets)
  )
), judged AS (
  SELECT p.url, p.host, p.path, p.node, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS verdict
  FROM parts p LEFT JOIN (VALUES {_RULE_ROWS}) AS r(v, h, p) ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY ALL
), edges AS (
  SELECT a.node AS a, b.node AS b FROM targets t JOIN parts a ON t.url = a.url JOIN parts b ON t.target = b.url
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), blocked(node) AS (
  SELECT DISTINCT node FROM judged WHERE verdict = 'block' AND node IS NOT NULL
  UNION
  SELECT e.b FROM blocked JOIN both_ways e ON blocked.node = e.a
)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule, coalesce(j.verdict, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN judged j ON p.url = j.url LEFT JOIN blocked b ON j.node = b.node
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_arrivals(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, arg_min(doc_id, (-length(body), doc_id)) AS keep_id, max(length(body)) AS most, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AND length(d.body) = g.most AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality", "keep")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = stored(chat.format_trees(chat.chain(rows), branches=1), "formatted")
    turns = out.withColumn("turns", F.explode(F.array(chat.read_back(F.col("formatted")))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: chat.unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    loss = turns.withColumn("loss", F.array_join(masked, ""))
    return loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(e) AS escaped, length(r) AS role_chars FROM (
    SELECT *,
      replace(replace(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'),
        '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'), '<<SYS>>', '<' || chr(92) || '<SYS>>'),
        '<</SYS>>', '<' || chr(92) || '</SYS>>'), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>') AS e,
      role AS r
    FROM said)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(12 + role_chars + 1 + escaped + 11)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filters": op5_url_filters,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extraction": op10_html_extraction,
}
ORACLE_SQL = {"op3_line_dedup": OP3_SQL, "op5_url_filters": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_chat_formatting": OP8_SQL}
