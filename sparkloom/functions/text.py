"""Rule scans over lines, findings and keywords."""

from __future__ import annotations

import heapq
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules as (name, target, severity, pattern, case ignored); message and fix are in ADVICE, by the name's second part.
RULES = (
    ("builtin.secrets.generic-assignment", "code-config", "CRITICAL", r"\b(api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key|private[_-]?key|client[_-]?secret)\b\s*[:=]\s*['\"]?[^'\"\s]{8,}", True),
    ("builtin.secrets.private-key", "all", "BLOCKER", r"-----BEGIN (RSA |EC |OPENSSH |DSA |)?PRIVATE KEY-----", False),
    ("builtin.crypto.md5-sha1", "code", "MAJOR", r"\b(md5|sha1)\s*\(|createHash\(\s*['\"](?:md5|sha1)['\"]\s*\)|hashlib\.(?:md5|sha1)\s*\(", True),
    ("builtin.command-injection.shell-exec", "code", "CRITICAL", r"\b(execSync|exec|popen|system|subprocess\.Popen|os\.system|shell_exec|passthru)\s*\(", True),
    ("builtin.code-injection.eval", "code", "CRITICAL", r"\b(eval|Function|setTimeout|setInterval)\s*\(", True),
    ("builtin.sql.string-concat", "code", "MAJOR", r"(SELECT|INSERT|UPDATE|DELETE)\b[^\n]*(\+|\$\{|%s|format\()", True),
    ("builtin.tls.disabled-verify", "code-config", "MAJOR", r"(verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]0['\"])", True),
    ("builtin.ai.prompt-injection-marker", "all", "MAJOR", r"(ignore previous instructions|reveal (the )?system prompt|developer message|BEGIN SYSTEM PROMPT|你现在是|忽略之前的指令)", True),
    ("builtin.auth.jwt-none", "code-config", "CRITICAL", r"(algorithms?\s*[:=]\s*\[[^\]]*['\"]none['\"]|alg\s*[:=]\s*['\"]none['\"])", True),
    ("builtin.auth.hardcoded-jwt-secret", "code-config", "CRITICAL", r"(jwt[_-]?secret|session[_-]?secret|SECRET_KEY)\s*[:=]\s*['\"][^'\"]{8,}['\"]", True),
    ("builtin.nosql.operator-injection", "code", "MAJOR", r"(find(?:One)?|update(?:One|Many)?|delete(?:One|Many)?)\s*\(\s*\{[^}]*req\.(?:body|query|params)|\$where\s*:", True),
    ("builtin.prototype-pollution.merge", "code", "MAJOR", r"(Object\.assign\s*\([^)]*req\.(?:body|query)|(?:merge|defaultsDeep|extend)\s*\([^)]*req\.(?:body|query))", True),
    ("builtin.path-traversal.file-read", "code", "MAJOR", r"(readFile|readFileSync|createReadStream|sendFile|open\s*\(|FileInputStream|Files\.read).*req\.(?:query|params|body)", True),
    ("builtin.xxe.xml-parser", "code", "MAJOR", r"(DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|lxml\.etree|xml2js|libxmljs)", True),
    ("builtin.config.debug-enabled", "code-config", "MAJOR", r"(DEBUG\s*=\s*True|debug\s*[:=]\s*true|NODE_ENV\s*[:=]\s*['\"]development['\"])", True),
    ("builtin.config.cors-wildcard", "code-config", "MAJOR", r"(cors\s*\([^)]*origin\s*[:=]\s*['\"]\*['\"]|Access-Control-Allow-Origin['\"]?\s*[:=]\s*['\"]\*)", True),
    ("builtin.container.privileged-root", "code-config", "MAJOR", r"(privileged\s*:\s*true|USER\s+root|user\s*:\s*['\"]?0['\"]?)", True),
)
# Rules on commands and on secrets in prose, of the same form.
DANGERS = (
    ("skill.danger.rm-root", "dangerous-command", "BLOCKER", r"\brm\s+-rf\s+(?:/|/\*)\b", False),
    ("skill.danger.rm-home", "dangerous-command", "CRITICAL", r"\brm\s+-rf\s+(?:~|\$HOME|/home/)[^\n]*", False),
    ("skill.danger.disk-format", "dangerous-command", "BLOCKER", r"\b(mkfs(?:\.[a-z0-9]+)?|wipefs|sgdisk\s+--zap-all)\b", False),
    ("skill.danger.block-write", "dangerous-command", "BLOCKER", r"(?:dd\s+if=|>\s*)/dev/(?:sd[a-z]|nvme\d+n\d+|mapper/)", False),
    ("skill.danger.remote-shell", "dangerous-command", "CRITICAL", r"\b(?:curl|wget)\b[^\n|;]*(?:\||\$\()\s*(?:sudo\s+)?(?:bash|sh|zsh)\b", False),
    ("skill.danger.chmod-777", "dangerous-command", "MAJOR", r"\bchmod\s+(?:-R\s+)?777\b", False),
    ("skill.danger.fork-bomb", "dangerous-command", "BLOCKER", r":\(\)\s*\{\s*:\|:\s*&\s*\}\s*;\s*:", False),
    ("skill.secret.assignment", "secret", "CRITICAL", r"\b(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key|private[_-]?key|client[_-]?secret)\b\s*[:=]\s*['\"]?[^'\"\s]{8,}", True),
    ("skill.secret.aws-access-key", "secret", "CRITICAL", r"AKIA[0-9A-Z]{16}", False),
    ("skill.secret.github-token", "secret", "CRITICAL", r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{20,}\b", False),
    ("skill.secret.private-key", "secret", "BLOCKER", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |)?PRIVATE KEY-----", False),
)
#: What a finding of a family means, and what to do.
ADVICE = {
    "secrets": ("A credential seems to be written into the text.", "Move it to a secret store and replace it."),
    "crypto": ("A weak hash function is in use.", "Use SHA-256 or a password hash."),
    "command-injection": ("A shell command is run.", "Pass arguments as a list and allow known values only."),
    "code-injection": ("Code is evaluated at run time.", "Use a table of allowed actions."),
    "sql": ("SQL seems to be put together from text.", "Use parameters."),
    "tls": ("Certificates are not checked.", "Check them; trust an authority of your own if needed."),
    "ai": ("The text addresses a language model.", "Treat it as data that cannot be trusted."),
    "auth": ("Tokens can be forged.", "Fix strong algorithms and keep secrets out of the text."),
    "nosql": ("Input reaches a database's operators.", "Check types and fields."),
    "prototype-pollution": ("Input is merged into objects.", "Refuse reserved names."),
    "path-traversal": ("Input reaches a path.", "Resolve it under a fixed folder."),
    "xxe": ("An XML parser is in use.", "Turn external entities off."),
    "config": ("A setting is open to all.", "Close it in production."),
    "container": ("A container runs with all rights.", "Give it a user of its own."),
    "danger": ("A command destroys data or opens the system.", "Ask first, and limit it to a folder."),
    "secret": ("A secret stands in the text.", "Take it out and replace it."),
}
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
# Endings and names of files that hold code or settings.
CODE = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".java", ".go", ".rs", ".php", ".rb", ".cs", ".c", ".cc", ".cpp", ".h", ".hpp", ".sql")
CONFIG = (".json", ".json5", ".yml", ".yaml", ".toml", ".ini", ".conf", ".config", ".env", ".properties")
CONFIG_NAMES = ("Dockerfile", "Makefile")


def advice(rule: str) -> tuple[str, str]:
    return ADVICE[rule.split(".")[1]]


def _pattern(rule) -> str:
    return f"(?i:{rule[3]})" if rule[4] else f"(?:{rule[3]})"


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", skip: Column | None = None) -> DataFrame:
    """(id, line, rule, severity, message, fix) for each line that a rule matches; lines from 1. skip leaves out lines (named t).

    One alternation goes over whole texts first; only those that it finds
    are cut into lines.
    """
    some = docs.where(F.col(text_col).rlike("|".join(map(_pattern, rules))))
    lines = some.select(F.col(id_col), F.posexplode(F.split(text_col, "\r?\n")).alias("p", "t"))
    if skip is not None:
        lines = lines.where(~skip)
    hit = lambda r: F.when(F.col("t").rlike(_pattern(r)), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[2]).alias("severity"), *(F.lit(x).alias(n) for n, x in zip(("message", "fix"), advice(r[0])))))
    found = F.filter(F.array(*map(hit, rules)), lambda x: x.isNotNull())
    return lines.select(id_col, (F.col("p") + 1).alias("line"), F.explode(found).alias("f")).select(id_col, "line", "f.*")


def example(line: Column) -> Column:
    """Whether a line is likely an example: blank, a comment, a list item, a quotation or code in backticks."""
    t = F.trim(line)
    return (t == "") | t.rlike("^(#|//|<!--|- |[*] |> |`)") | t.endswith("`")


def gated(findings: DataFrame, path: str = "path", rules=RULES) -> DataFrame:
    """Findings whose rule is meant for their file's kind."""
    ending, name = F.regexp_extract(path, r"(\.[^./]+)$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    code, config = ending.isin(*CODE), ending.isin(*CONFIG) | name.isin(*CONFIG_NAMES)
    target = F.create_map(*(F.lit(x) for r in rules for x in (r[0], r[1])))[F.col("rule")]
    return findings.where((target == "all") | (target == "code") & code | (target == "config") & config | (target == "code-config") & (code | config))


def structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, severity): a document has a front matter between --- lines with a name and a description, and 500 lines at most."""
    lines = F.split(text_col, "\r?\n")
    head = F.slice(lines, 2, 79)
    end = F.array_position(F.transform(head, F.trim), F.lit("---"))
    front = F.when(end > 0, F.array_join(F.slice(head, 1, F.greatest(end - 1, F.lit(0)).cast("int")), "\n")).otherwise("")
    opened = F.startswith(F.col(text_col), F.lit("---"))
    rules = [("missing-frontmatter", "MAJOR", ~opened), ("bad-frontmatter", "MAJOR", opened & (end == 0))]
    rules += [(f"missing-{k}", "MAJOR", opened & ~front.rlike(f"(?m)^{k}\\s*:\\s*\\S+")) for k in ("name", "description")]
    rules += [("too-long", "MINOR", F.size(lines) > 500)]
    found = F.array(*(F.when(c, F.struct(F.lit(f"skill.structure.{r}").alias("rule"), F.lit(sev).alias("severity"))) for r, sev, c in rules))
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(id_col, "f.*")


def manifests(files: DataFrame) -> DataFrame:
    """(project, file, line, rule, severity) over files(project, file, text): a package manifest without a lock file, and requirements without a version."""
    node = files.where("file = 'package.json'").select("project")
    locks = files.where(F.col("file").isin("package-lock.json", "pnpm-lock.yaml", "yarn.lock")).select("project").distinct()
    bare = node.join(locks, "project", "left_anti").select("project", F.lit("package.json").alias("file"), F.lit(1).alias("line"), F.lit("builtin.supply-chain.node-missing-lockfile").alias("rule"), F.lit("MAJOR").alias("severity"))
    lines = files.where("file = 'requirements.txt'").select("project", "file", F.posexplode(F.split("text", "\r?\n")).alias("p", "t"))
    t = F.trim("t")
    loose = lines.where((t != "") & ~t.startswith("#") & ~t.rlike("[=<>!~]=|@"))
    return bare.unionByName(loose.select("project", "file", (F.col("p") + 1).alias("line"), F.lit("builtin.supply-chain.python-unpinned").alias("rule"), F.lit("MINOR").alias("severity")))


def severity(name: Column) -> Column:
    """Other tools' severities as ours: ERROR is CRITICAL, WARNING and what is unknown MAJOR."""
    s = F.upper(F.coalesce(name, F.lit("")))
    return F.when(s == "ERROR", "CRITICAL").when(s == "WARNING", "MAJOR").when(s.isin(*SEVERITIES), s).otherwise("MAJOR")


# Classes of findings that are noise, and the patterns that tell them, in any case.
NOISE = {
    "dos": (r"\b(denial of service|dos attack|resource exhaustion)\b", r"\b(infinite|unbounded)\s+(loop|recursion)\b", r"\b(redos|regular expression denial of service)\b"),
    "rate-limit": (r"\b(missing|lack of|no)\s+rate\s+limit", r"\brate\s+limiting\s+(missing|required|not implemented)", r"\bunlimited\s+(requests|calls|api)"),
    "resource-leak": (r"\b(resource|memory|file|connection)\s+leak", r"\bunclosed\s+(resource|file|connection|socket)", r"\b(close|cleanup|release)\s+(resource|file|connection)"),
    "open-redirect": (r"\b(open redirect|unvalidated redirect)\b", r"\bredirect\s+(attack|exploit|vulnerability)\b"),
    "memory-safety": (r"\b(buffer|stack|heap)\s+overflow\b", r"\b(out.?of.?bounds|oob)\b", r"\b(use.?after.?free|double.?free|null.?pointer)\b", r"\bmemory\s+(safety|corruption)\b"),
}


def noise(message: Column, classes=tuple(NOISE)) -> Column:
    """The first class in name order that the message belongs to; null for none."""
    return F.coalesce(*(F.when(message.rlike(f"(?i){'|'.join(NOISE[c])}"), F.lit(c)) for c in sorted(classes)))


# Rules of an issue feed with their titles and whether a fix can be automatic.
SOLUTIONS = (
    ("typescript:S3358", "Nested ternary operation", False),
    ("typescript:S6606", "Prefer nullish coalescing operator", True),
    ("typescript:S6749", "Redundant fragment", True),
    ("typescript:S6759", "Props should be marked as read-only", True),
    ("typescript:S3776", "Cognitive complexity too high", False),
    ("typescript:S6571", "Redundant any in union type", True),
    ("javascript:S3358", "Nested ternary operation", False),
)


def solved(issues: DataFrame, rule: str = "rule") -> DataFrame:
    """Issues with title, auto_fixable and action: auto-fix, manual-refactor, or manual where the rule is unknown."""
    known = issues.sparkSession.createDataFrame(SOLUTIONS, "__rule string, title string, auto_fixable boolean")
    out = issues.join(F.broadcast(known), F.col(rule) == F.col("__rule"), "left")  # as many rows as SOLUTIONS
    action = F.when(F.col("auto_fixable"), "auto-fix").when(F.col("auto_fixable").isNotNull(), "manual-refactor").otherwise("manual")
    return out.withColumns({"action": action, "title": F.coalesce("title", F.lit("Unknown Rule")), "auto_fixable": F.coalesce("auto_fixable", F.lit(False))}).drop("__rule")


def dedupe(findings: DataFrame, key=("doc_id", "line", "rule", "message"), allowed=SEVERITIES) -> DataFrame:
    """Findings of the allowed severities, one for each key."""
    return findings.where(F.col("severity").isin(*allowed)).dropDuplicates([k for k in key if k in findings.columns])


def ranked(findings: DataFrame, *then: str) -> DataFrame:
    """Most severe first, then by the given columns."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.orderBy(rank, *then)


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts for every severity, zero where there is none."""
    spark = findings.sparkSession
    all_ = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return all_.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gate(findings: DataFrame, threshold: str = "CRITICAL") -> int:
    """2 if any finding is at least that severe, else 0."""
    bad = SEVERITIES[: SEVERITIES.index(threshold) + 1]
    return 2 if findings.where(F.col("severity").isin(*bad)).limit(1).count() else 0


def content_hash(content: str, *tags: str) -> Column:
    """SHA-256 of the content and the tags' values in key order; null tags are empty."""
    return F.sha2(F.concat(F.col(content), *(F.coalesce(F.col(t), F.lit("")) for t in sorted(tags))), 256)


# Words that are no keywords.
STOP = frozenset("的 了 是 在 和 有 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 什么 能 对 与 或 及 等".split())
TOKEN = "[一-龥a-zA-Z0-9]+"


def keyword_column(text: Column, n: int = 3, stop=STOP) -> Column:
    """The n most frequent words of more than one letter, as array<struct<w, n>>; ties in word order. Counted where the text is: nothing is shuffled."""
    import pandas as pd

    token = re.compile(TOKEN)

    def top(texts):
        out = []
        for t in texts:
            counts = Counter(w for w in token.findall(t or "") if len(w) > 1 and w not in stop)
            best = heapq.nsmallest(n, counts.items(), key=lambda x: (-x[1], x[0]))
            out.append([{"w": w, "n": k} for w, k in best])
        return pd.Series(out)

    top.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(top, "array<struct<w:string,n:bigint>>")(text)


def keywords(docs: DataFrame, n: int = 3, stop=STOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, w, n): each document's keywords."""
    return docs.select(id_col, F.explode(keyword_column(F.col(text_col), n, stop)).alias("k")).select(id_col, "k.w", "k.n")


# Words that tell an action, a state or a priority, the first one found counts.
ACTIONS = "安装 配置 部署 排查 修复 测试 优化 更新 迁移 检查 启动 停止 重启 创建 删除 备份 恢复 同步".split()
STATES = "成功 失败 待处理 进行中 已完成 已取消 错误 正常".split()
PRIORITIES = "P0 P1 P2 P3 高 中 低".split()
# What stands for an unknown topic, project, action, state and priority.
UNKNOWN, NO_PROJECT, NO_ACTION, NO_STATE, NO_PRIORITY = "未分类", "通用", "其他", "待确定", "P1"
# Addresses and host names that tell a project.
PROJECT = (r"\d+\.\d+\.\d+\.\d+", r"[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z]+")


def tags(docs: DataFrame, text_col: str = "text", time_col: Column | None = None) -> DataFrame:
    """docs with ten tags: time, two topics, three keywords, project, action, status and priority."""
    text = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    lines = F.split(text, "\n")
    first = F.regexp_replace(F.trim(F.get(lines, F.lit(0))), r"^#+\s*", "")
    after = F.filter(F.transform(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(":"))), lambda x: F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1))), lambda x: x != "")
    some = lambda c, d: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(d)
    word = lambda words, d: F.coalesce(*(F.when(F.contains(F.col(text_col), F.lit(w)), F.lit(w)) for w in words), F.lit(d))
    project = [F.regexp_extract(F.col(text_col), p, 0) for p in PROJECT]
    keyed = docs.withColumn("__k", keyword_column(F.col(text_col)))
    key = lambda i: F.coalesce(F.get(F.col("__k"), F.lit(i))["w"], F.lit(UNKNOWN))
    return keyed.withColumns(
        {
            "tag1_time": F.date_format(time_col if time_col is not None else F.current_timestamp(), "yyyy-MM-dd"),
            "tag2_topicA": some(F.left(first, F.lit(20)), UNKNOWN),
            "tag3_topicB": some(F.left(F.get(after, F.lit(0)), F.lit(20)), UNKNOWN),
            "tag4_keywordA": key(0),
            "tag5_keywordB": key(1),
            "tag6_keywordC": key(2),
            "tag7_project": some(project[0], some(project[1], F.lit(NO_PROJECT))),
            "tag8_action": word(ACTIONS, NO_ACTION),
            "tag9_status": word(STATES, NO_STATE),
            "tag10_priority": word(PRIORITIES, NO_PRIORITY),
        }
    ).drop("__k")
