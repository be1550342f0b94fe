"""Record entries: audits of texts and files, tags, similarity, retention, backups and jobs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import memory, text
from ..operators import dml
from ..session import load, scratch
from .catalogue import frame
from .more_ingest import fixed
from .records import LINES, RULES, matches, quoted

# ---- audits ----
PATHS = "CASE length(coalesce(source, '')) % 5 WHEN 0 THEN 'a/x.py' WHEN 1 THEN 'b/y.yaml' WHEN 2 THEN 'c/z.md' WHEN 3 THEN 'd/Dockerfile' ELSE 'e/w.js' END"


@frame(f"WITH l AS ({LINES}), f AS ({RULES}), p AS (SELECT doc_id, {PATHS} AS path FROM documents), t(rule, target) AS (VALUES {', '.join(f'({quoted(r[0])}, {quoted(r[1])})' for r in text.RULES)}) SELECT doc_id, line, rule, path FROM f JOIN p USING (doc_id) JOIN t USING (rule) WHERE target = 'all' OR (target = 'code' AND (path LIKE '%.py' OR path LIKE '%.js')) OR (target = 'code-config' AND path NOT LIKE '%.md')")
def K02_target_gating(s, d):
    docs = load(s, d, "documents")
    found = text.scan(docs).join(docs.select("doc_id", F.expr(PATHS).alias("path")), "doc_id")
    return text.gated(found).select("doc_id", "line", "rule", "path")


@frame(f"WITH l AS ({LINES}) SELECT doc_id, line, rule, severity FROM ({matches(text.DANGERS, 'NOT (trim(t) = $$$$ OR regexp_matches(trim(t), $$^(#|//|<!--|- |[*] |> |`)$$) OR ends_with(trim(t), $$`$$))')})")
def K03_secret_scan(s, d):
    return text.scan(load(s, d, "documents"), text.DANGERS, skip=text.example(F.col("t"))).select("doc_id", "line", "rule", "severity")


FRONT = "CASE length(coalesce(source, '')) % 3 WHEN 0 THEN '---' || chr(10) || 'name: x' || chr(10) || 'description: y' || chr(10) || '---' || chr(10) WHEN 1 THEN '---' || chr(10) || 'name: x' || chr(10) ELSE '' END"


@frame(f"WITH m AS (SELECT doc_id, length(coalesce(source, '')) % 3 AS k, {FRONT} || text AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'skill.structure.missing-frontmatter' AS rule, 'MAJOR' AS severity FROM m WHERE k = 2 UNION ALL SELECT doc_id, unnest(['skill.structure.bad-frontmatter', 'skill.structure.missing-name', 'skill.structure.missing-description']), 'MAJOR' FROM m WHERE k = 1 UNION ALL SELECT doc_id, 'skill.structure.too-long', 'MINOR' FROM m WHERE length(text) - length(replace(text, chr(10), '')) + 1 > 500")
def K04_structure(s, d):
    docs = load(s, d, "documents").where("text IS NOT NULL")
    return text.structure(docs.select("doc_id", F.concat(F.expr(FRONT), "text").alias("text")))


@frame("SELECT n_name AS project, 'package.json' AS file, 1 AS line, 'builtin.supply-chain.node-missing-lockfile' AS rule, 'MAJOR' AS severity FROM nation WHERE n_regionkey > 1 UNION ALL SELECT n_name, 'requirements.txt', unnest([2, 5]), 'builtin.supply-chain.python-unpinned', 'MINOR' FROM nation")
def K05_manifests(s, d):
    n = load(s, d, "nation").select(F.col("n_name").alias("project"), "n_regionkey")
    some = lambda rows, name, body: rows.select("project", F.lit(name).alias("file"), F.lit(body).alias("text"))
    files = some(n, "package.json", "{}").unionByName(some(n.where("n_regionkey <= 1"), "yarn.lock", "")).unionByName(some(n, "requirements.txt", "a==1\nb\n# c\nd>=2\n e \nf @ g"))
    return text.manifests(files)


@frame("SELECT event_id, CASE upper(event_type) WHEN 'ERROR' THEN 'CRITICAL' ELSE 'MAJOR' END AS severity FROM events")
def K06_severity(s, d):
    return load(s, d, "events").select("event_id", text.severity(F.col("event_type")).alias("severity"))


@frame(f"WITH l AS ({LINES}) SELECT DISTINCT doc_id, line, rule, severity FROM ({RULES}) WHERE severity IN ('BLOCKER', 'CRITICAL')")
def K07_finding_dedupe(s, d):
    found = text.scan(load(s, d, "documents"))
    return text.ranked(text.dedupe(found.unionByName(found), allowed=("BLOCKER", "CRITICAL")), "doc_id", "line", "rule").select("doc_id", "line", "rule", "severity")


MESSAGES = "CASE event_type WHEN 'click' THEN 'There is no rate  limit' WHEN 'error' THEN 'Memory leak after a buffer overflow' WHEN 'view' THEN 'an open redirect' WHEN 'signup' THEN 'an infinite loop' ELSE 'all is well' END"
CLASSES = "CASE event_type WHEN 'click' THEN 'rate-limit' WHEN 'error' THEN 'memory-safety' WHEN 'view' THEN 'open-redirect' WHEN 'signup' THEN 'dos' END"


@frame(f"SELECT event_id, {CLASSES} AS noise FROM events")
def K08_noise(s, d):
    return load(s, d, "events").select("event_id", text.noise(F.expr(MESSAGES)).alias("noise"))


@frame(f"SELECT coalesce({CLASSES}, 'kept') AS class, count(*) AS n FROM events GROUP BY 1")
def A34_filter_breakdown(s, d):
    return load(s, d, "events").select(F.coalesce(text.noise(F.expr(MESSAGES)), F.lit("kept")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


KEYS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'typescript:S6606' WHEN '2-HIGH' THEN 'typescript:S3776' WHEN '5-LOW' THEN 'javascript:S3358' ELSE 'python:S1' END"


@frame(f"WITH i AS (SELECT o_orderkey, {KEYS} AS rule FROM orders) SELECT o_orderkey, rule, CASE rule WHEN 'typescript:S6606' THEN 'Prefer nullish coalescing operator' WHEN 'typescript:S3776' THEN 'Cognitive complexity too high' WHEN 'javascript:S3358' THEN 'Nested ternary operation' ELSE 'Unknown Rule' END AS title, rule = 'typescript:S6606' AS auto_fixable, CASE rule WHEN 'typescript:S6606' THEN 'auto-fix' WHEN 'python:S1' THEN 'manual' ELSE 'manual-refactor' END AS action FROM i")
def K09_solutions(s, d):
    return text.solved(load(s, d, "orders").select("o_orderkey", F.expr(KEYS).alias("rule")))


@frame(f"SELECT o_custkey AS file, count(*) AS issues, count(*) FILTER ({KEYS} = 'typescript:S6606') AS fixable, count(*) FILTER ({KEYS} <> 'typescript:S6606') AS manual FROM orders GROUP BY 1")
def A33_issues_by_file(s, d):
    i = text.solved(load(s, d, "orders").select(F.col("o_custkey").alias("file"), F.expr(KEYS).alias("rule")))
    return i.groupBy("file").agg(F.count("*").alias("issues"), F.count_if("auto_fixable").alias("fixable"), F.count_if(~F.col("auto_fixable")).alias("manual"))


@frame(f"WITH l AS ({LINES}), f AS ({RULES}) SELECT threshold, CASE WHEN (SELECT count(*) FROM f WHERE list_position(['BLOCKER', 'CRITICAL', 'MAJOR', 'MINOR', 'INFO'], severity) <= rank) > 0 THEN 2 ELSE 0 END::BIGINT AS code FROM (VALUES ('BLOCKER', 1), ('CRITICAL', 2), ('INFO', 5)) t(threshold, rank)")
def K10_gate(s, d):
    found = text.scan(load(s, d, "documents"))
    return s.createDataFrame([(t, text.gate(found, t)) for t in ("BLOCKER", "CRITICAL", "INFO")], "threshold string, code bigint")


# ---- tags and keywords ----
STOP = ", ".join(map(quoted, sorted(text.STOP)))
WORDS = f"w AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(text.TOKEN)})) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 1 AND w NOT IN ({STOP}) GROUP BY ALL), k AS (SELECT doc_id, w, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c)"


@frame(f"WITH {WORDS} SELECT doc_id, w, n FROM k WHERE r <= 3")
def K12_keywords(s, d):
    return text.keywords(load(s, d, "documents"))


def first_word(words, none):
    return "CASE " + " ".join(f"WHEN contains(text, {quoted(w)}) THEN {quoted(w)}" for w in words) + f" ELSE {quoted(none)} END"


@frame(f"WITH {WORDS}, x AS (SELECT doc_id, text, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), "
       f"y AS (SELECT *, regexp_replace(trim(ls[1]), '^#+\\s*', '') AS a, list_filter(list_transform(list_filter(ls[2:], lambda l: contains(l, ':')), lambda l: trim(l[instr(l, ':') + 1:])), lambda l: l <> '')[1] AS b FROM x) "
       f"SELECT y.doc_id, '2024-05-01' AS tag1_time, CASE WHEN coalesce(a, '') <> '' THEN left(a, 20) ELSE '{text.UNKNOWN}' END AS tag2_topicA, CASE WHEN coalesce(b, '') <> '' THEN left(b, 20) ELSE '{text.UNKNOWN}' END AS tag3_topicB, "
       + ", ".join(f"coalesce((SELECT w FROM k WHERE k.doc_id = y.doc_id AND r = {i}), '{text.UNKNOWN}') AS tag{i + 3}_keyword{n}" for i, n in ((1, "A"), (2, "B"), (3, "C")))
       + f", CASE WHEN regexp_extract(text, {quoted(text.PROJECT[0])}) <> '' THEN regexp_extract(text, {quoted(text.PROJECT[0])}) WHEN regexp_extract(text, {quoted(text.PROJECT[1])}) <> '' THEN regexp_extract(text, {quoted(text.PROJECT[1])}) ELSE '{text.NO_PROJECT}' END AS tag7_project, "
       f"{first_word(text.ACTIONS, text.NO_ACTION)} AS tag8_action, {first_word(text.STATES, text.NO_STATE)} AS tag9_status, {first_word(text.PRIORITIES, text.NO_PRIORITY)} AS tag10_priority FROM y")
def K11_tags(s, d):
    docs = load(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return text.tags(docs, time_col=F.lit("2024-05-01").cast("timestamp")).drop("text")


# ---- records ----
@frame("SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def K14_hash_once(s, d):
    """Two writes of overlapping rows and one of all again: each content is there once, and the last adds nothing."""
    rows = load(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")
    table = dml.Table(s, scratch(s, "once"))
    memory.write_once(table, firsts.where("h < '8'"))
    memory.write_once(table, firsts)
    assert memory.write_once(table, rows).isEmpty()
    return table.read()


@frame("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def K15_recent(s, d):
    e = load(s, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return memory.recent(e.join(F.broadcast(now)), "ts", F.col("now")).select("event_id")  # one row


@frame("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 8) AS score FROM embeddings, q WHERE vec_id <> 0 AND label < 5 AND round(list_cosine_similarity(embedding::DOUBLE[], q), 8) >= 0.1 ORDER BY score DESC, vec_id LIMIT 5")
def K16_filtered(s, d):
    """With a threshold and a filter on a property."""
    e = load(s, d, "embeddings")
    return memory.similar(e, e.where("vec_id = 0").select(F.col("embedding").alias("q")), limit=5, threshold=0.1, where="vec_id <> 0 AND label < 5")


@frame("SELECT a.vec_id FROM embeddings a WHERE a.label > 0 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.label = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.8)")
def K17_similarity_dedupe(s, d):
    e = load(s, d, "embeddings")
    return memory.unlike(e.where("label > 0"), e.where("label = 0"), 0.8).select("vec_id")


@frame("WITH u AS (SELECT user_id, date_diff('day', max(ts)::DATE, (SELECT max(ts)::DATE FROM events)) AS age, count(*) AS used FROM events GROUP BY user_id), r AS (SELECT user_id, round(exp(-age / (used * 0.5)), 8) AS score FROM u) SELECT user_id, score, CASE WHEN score < 0.1 THEN 'delete' WHEN score < 0.3 THEN 'archive' ELSE 'keep' END AS fate FROM r")
def K18_retention(s, d):
    """Each user's memory: its age from the last event, its strength from the number of events."""
    e = load(s, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    u = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("used")).join(F.broadcast(now))  # one row
    score = F.round(memory.retention(F.datediff("now", "last").cast("double"), F.col("used") * 0.5), 8)
    return u.select("user_id", score.alias("score")).withColumn("fate", memory.fate(F.col("score")))


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@frame("SELECT count(*) AS dry, count(*) AS written, count(*) AS restored, count(DISTINCT conv_id) AS conversations FROM conversations")
def K19_backup(s, d):
    c, path = load(s, d, "conversations"), scratch(s, "backup")
    dry, n = memory.backup(c, path, dry_run=True), memory.backup(c, path)
    table = dml.Table(s, scratch(s, "t"))
    back = memory.restore(table, path, SCHEMA, key="conv_id")
    return table.read().agg(F.lit(dry).cast("long").alias("dry"), F.lit(n).cast("long").alias("written"), F.lit(back).cast("long").alias("restored"), F.count_distinct("conv_id").alias("conversations"))


fixed("K21_tally", "success bigint, failed bigint, verify_failed bigint", lambda: [tuple(memory.tally([4, 2, 0, 5, 1], lambda x: 10 // x, lambda x, got: x * got == 10).values())], [(3, 1, 1)])


@frame("SELECT count(*) FILTER (c_nationkey < 5) AS copied, count(*) FILTER (NOT c_nationkey < 5) AS left_here, count(*) FILTER (c_nationkey < 5) AS there FROM customer")
def K23_migrate(s, d):
    a, b = dml.Table(s, scratch(s, "a")), dml.Table(s, scratch(s, "b"))
    a.commit(load(s, d, "customer"))
    assert memory.migrate(a, b, "c_custkey", F.col("c_nationkey") < 5, dry_run=True)["copied"] == 0
    done = memory.migrate(a, b, "c_custkey", F.col("c_nationkey") < 5, delete_source=True)
    return s.createDataFrame([(done["copied"], a.read().count(), b.read().count())], "copied bigint, left_here bigint, there bigint")


@frame("SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 10 THEN 'old' ELSE 'mine' END AS owner FROM supplier")
def K24_restore_skip(s, d):
    """A backup of all restored over some: those that are there stay, the rest come under another owner."""
    rows, path = load(s, d, "supplier"), scratch(s, "backup")
    all_ = rows.select("s_suppkey", "s_name", F.lit("old").alias("owner"))
    memory.backup(all_, path)
    table = dml.Table(s, scratch(s, "t"))
    table.commit(rows.where("s_nationkey < 10").select("s_suppkey", "s_name", F.lit("old").alias("owner")))
    memory.restore(table, path, "s_suppkey bigint, s_name string, owner string", key="s_suppkey", owner=("owner", "mine"))
    return table.read()


@frame("SELECT * FROM (VALUES ('export-20260205T000000'), ('export-20260301T000000')) t(name)")
def K25_timed_export(s, d):
    folder, rows = scratch(s, "exports"), load(s, d, "region")
    for day in (datetime.datetime(2026, 1, 1), datetime.datetime(2026, 2, 5), datetime.datetime(2026, 3, 1)):
        kept = memory.timed_export(rows, folder, day)
    return s.createDataFrame([(n,) for n in kept], "name string")
