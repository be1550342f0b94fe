"""Queries on text and records: rule scans, findings, hashes, keywords and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import cosine
from ..session import load
from .catalogue import frame

LINES = "SELECT doc_id, i::INT AS line, t FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS t, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS i FROM documents)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def matches(rules, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT doc_id, line, '{r}' AS rule, '{sev}' AS severity, {quoted(text.advice(r)[0])} AS message, {quoted(text.advice(r)[1])} AS fix FROM l WHERE {where} AND regexp_matches(t, {quoted(p)}, '{'i' if i else 'c'}')" for r, _, sev, p, i in rules)


RULES = matches(text.RULES)


@frame(f"WITH l AS ({LINES}) {RULES}")
def K01_rule_scan(s, d):
    return text.scan(load(s, d, "documents"))


@frame(f"WITH l AS ({LINES}), f AS (SELECT DISTINCT * FROM ({RULES})) SELECT s.severity, count(f.rule) AS n FROM (VALUES ('BLOCKER'), ('CRITICAL'), ('MAJOR'), ('MINOR'), ('INFO')) s(severity) LEFT JOIN f USING (severity) GROUP BY 1")
def A32_by_severity(s, d):
    return text.by_severity(text.dedupe(text.scan(load(s, d, "documents"))))


@frame("SELECT doc_id, sha256(text || coalesce(lang, '') || coalesce(source, '')) AS h FROM documents WHERE text IS NOT NULL")
def K13_content_hash(s, d):
    return load(s, d, "documents").where("text IS NOT NULL").select("doc_id", text.content_hash("text", "lang", "source").alias("h"))


@frame("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 8) AS score FROM embeddings, q WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def K16_similar(s, d):
    e = load(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    scored = e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 8).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@frame("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def K20_stats(s, d):
    return load(s, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@frame("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM pages")
def K22_file_name(s, d):
    return load(s, d, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9_.-]", "_").alias("name"))
