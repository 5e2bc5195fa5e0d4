"""Every query of the engine's own operators: name -> (query, SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import deadcode, graph, history, lint, markers, metrics, pysyntax, render, rewrite, search, secrets, symbols, trace, verify
from ..sources import files as S
from ..streaming import streams
from . import fixtures as X
from . import surface

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


docs = S.documents_as_files
_DOCS = f"docs AS ({S.documents_sql()})"
_LINES = f"{_DOCS}, parts AS (SELECT path, lang, string_split(content, chr(10)) AS ls FROM docs), lines AS (SELECT path, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM parts)"
_WORD = r"[\p{L}\p{N}_]"


# --- scans and lines


@query("SELECT lang, count(*) AS files, sum(octet_length(encode(text))) AS bytes FROM documents GROUP BY lang")
def scan_files_by_lang(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {_LINES} SELECT path, CAST(line_no AS INT) AS line_no, line FROM lines")
def lines_explode(spark, sf_dir):
    return T.with_lines(docs(spark, sf_dir).select("path", "content"))


@query(
    f"""WITH {_DOCS}, n AS (SELECT lang, len(string_split(content, chr(10))) AS k, content FROM docs)
    SELECT lang, count(*) AS files, sum(k - CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 1 ELSE 0 END) AS lines, sum(k) AS split_lines FROM n GROUP BY lang"""
)
def line_count_by_lang(spark, sf_dir):
    files = docs(spark, sf_dir).withColumn("k", metrics.split_line_count())
    return files.groupBy("lang").agg(F.count("*").alias("files"), F.sum(T.shown_lines("content")).alias("lines"), F.sum("k").alias("split_lines"))


@query("SELECT '.' || lang AS ext, count(*) AS files, sum(len(string_split(text, chr(10))) - 1) AS newlines FROM documents GROUP BY lang")
def ext_histogram(spark, sf_dir):
    return metrics.by_extension(docs(spark, sf_dir))


@query("SELECT split_part(source || '/' || doc_id || '.' || lang, '/', 2) AS name, source AS folder, '.' || lang AS ext, octet_length(encode(text)) <= 1000000 AS audited, octet_length(encode(text)) <= 52428800 AS searched FROM documents")
def scan_guards(spark, sf_dir):
    files = docs(spark, sf_dir)
    return files.select(T.basename("path").alias("name"), F.substring_index("path", "/", 1).alias("folder"), T.extension("path").alias("ext"), (F.col("size") <= S.AUDIT_BYTES).alias("audited"), (F.col("size") <= S.SEARCH_BYTES).alias("searched"))


@query(f"WITH {_DOCS} SELECT path FROM docs ORDER BY path LIMIT 100")
def scan_max_files(spark, sf_dir):
    return docs(spark, sf_dir).select("path").orderBy("path").limit(100)


@query(X.values([("test_mod.py", True), ("engine.cpp", False), ("panel.ts", False), ("mod.py", False)], "path, test"))
def test_file_predicate(spark, sf_dir):
    return X.code_files(spark, ("test_mod.py", "engine.cpp", "panel.ts", "mod.py")).select("path", S.is_test("path").alias("test"))


@query(X.values([("src/a.py", False), (".git/x.py", True), ("a/node_modules/b.js", True), ("a/.hidden/b.py", True), ("build.py", False)], "path, left_out"))
def scan_pruning(spark, sf_dir):
    paths = ["src/a.py", ".git/x.py", "a/node_modules/b.js", "a/.hidden/b.py", "build.py"]
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", S.pruned("path").alias("left_out"))


@query(
    r"""SELECT l.lang, count(*) AS files, sum(len(d.text)) AS chars FROM documents d
    JOIN (VALUES ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance')) AS l(code, lang) ON d.lang = l.code GROUP BY l.lang"""
)
def language_dimension(spark, sf_dir):
    dim = spark.createDataFrame([("en", "germanic"), ("de", "germanic"), ("fr", "romance"), ("es", "romance")], "code string, family string")
    joined = docs(spark, sf_dir).join(F.broadcast(dim), F.col("lang") == F.col("code"))
    return joined.groupBy(F.col("family").alias("lang")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


# --- search


@query(f"WITH {_LINES} SELECT path, CAST(line_no AS INT) AS line_no, line FROM lines WHERE regexp_matches(line, '[Ll]icen[sc]e')")
def search_regex(spark, sf_dir):
    return search.matching_lines(docs(spark, sf_dir), "[Ll]icen[sc]e")


@query(f"WITH {_LINES} SELECT path, CAST(line_no AS INT) AS line_no, line FROM lines WHERE regexp_matches(line, 'the') AND split_part(path, '/', 2) LIKE '%7%' AND split_part(path, '/', 2) LIKE '%.en%'")
def search_include(spark, sf_dir):
    return search.matching_lines(docs(spark, sf_dir), "the", include="*7*.en")


@query(
    f"""WITH {_LINES}, framed AS (
      SELECT path, line_no, line, string_agg(line, chr(10)) OVER b AS before, string_agg(line, chr(10)) OVER a AS after FROM lines
      WINDOW b AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING))
    SELECT path, CAST(line_no AS INT) AS line_no, line AS match, coalesce(before, '') AS before, coalesce(after, '') AS after FROM framed
    WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)')""".replace("\\\\", "\\")
)
def search_context(spark, sf_dir):
    found = search.search(docs(spark, sf_dir), r"\bthe\b", context=1)
    return found.select("path", "line_no", "match", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"))


@query(
    f"""WITH {_LINES}, hit AS (SELECT * FROM lines WHERE path = 'src3/3.fr' AND line LIKE '%de%')
    SELECT h.path, CAST(h.line_no AS INT) AS line_no, string_agg(CAST(l.line_no AS VARCHAR) || ':' || l.line, chr(10) ORDER BY l.line_no) AS context
    FROM hit h JOIN lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY ALL"""
)
def search_single_file(spark, sf_dir):
    found = search.search_file(docs(spark, sf_dir), "src3/3.fr", "de", context=2)
    shown = F.array_join(F.transform("context", lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["line"])), "\n")
    return found.select("path", "line_no", shown.alias("context"))


@query(f"WITH {_LINES} SELECT 'reference' AS type, path, CAST(line_no AS INT) AS line_no, trim(substr(line, 1, 120)) AS context FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])with([^\\p{{L}}\\p{{N}}_]|$)')".replace("\\\\", "\\"))
def word_refs(spark, sf_dir):
    return search.word_references(docs(spark, sf_dir), "with")


_TOKENS = f"{_LINES}, tok AS (SELECT path, lang, line_no, unnest(regexp_extract_all(line, '{_WORD}+')) AS token FROM lines)"


@query(f"WITH {_TOKENS} SELECT lang, count(*) AS tokens, count(DISTINCT token) AS symbols FROM tok GROUP BY lang")
def token_index_stats(spark, sf_dir):
    return search.tokens(docs(spark, sf_dir), ("path", "lang")).groupBy("lang").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("symbols"))


@query(f"WITH {_TOKENS} SELECT token, count(*) AS n, count(DISTINCT path) AS files FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 50")
def token_top_k(spark, sf_dir):
    counted = search.tokens(docs(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
    return search.top(counted, 50, F.desc("n"), F.asc("token"))


@query(
    f"""WITH {_TOKENS}, defs AS (SELECT DISTINCT path, line_no FROM tok WHERE token = 'and'),
    refs AS (SELECT DISTINCT path, line_no FROM tok WHERE token = 'the')
    SELECT r.path, CAST(r.line_no AS INT) AS line_no FROM refs r ANTI JOIN defs d USING (path, line_no)"""
)
def definition_exclusion(spark, sf_dir):
    occ = trace.occurrences(docs(spark, sf_dir))
    pick = lambda w: occ.where(F.col("symbol") == w).select("path", "line_no")
    return search.excluding_definitions(pick("the"), pick("and"))


# --- symbols over pages: elements of HTML as symbols


_TAGS = r"""parts AS (SELECT page_id, regexp_extract_all(html, '<(\w+)', 1) AS names, split_part(url, '/', 4) AS lang FROM pages),
tags AS (SELECT page_id, lang, unnest(names) AS name FROM parts)"""


def _page_tags(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.split("url", "/")[3].alias("lang"), F.explode(F.regexp_extract_all("html", F.lit(r"<([A-Za-z0-9_]+)"), 1)).alias("name"))
    heading = F.col("name").rlike("^h[1-6]$")
    return pages.withColumn("kind", F.when(heading, "heading").when(F.col("name").isin("a", "img"), "link").otherwise("block"))


_KIND = "CASE WHEN regexp_matches(name, '^h[1-6]$') THEN 'heading' WHEN name IN ('a', 'img') THEN 'link' ELSE 'block' END"


@query(f"WITH {_TAGS} SELECT page_id, lang, name, count(*) AS n FROM tags WHERE name = 'h1' GROUP BY ALL")
def tags_lookup(spark, sf_dir):
    return symbols.lookup(_page_tags(spark, sf_dir), "h1").groupBy("page_id", "lang", "name").agg(F.count("*").alias("n"))


@query(f"WITH {_TAGS} SELECT {_KIND} AS kind, count(*) AS n FROM tags GROUP BY 1")
def tags_by_kind(spark, sf_dir):
    return _page_tags(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_TAGS}, k AS (SELECT *, {_KIND} AS kind FROM tags) SELECT kind, lang, count(*) AS total_tags, count(DISTINCT name) AS total_symbols FROM k GROUP BY GROUPING SETS ((kind), (lang), ())")
def grouping_sets_stats(spark, sf_dir):
    return symbols.index_stats(_page_tags(spark, sf_dir))


# --- markers


_TAG_LIST = "['TODO', 'FIXME', 'HACK', 'XXX', 'BUG', 'OPTIMIZE', 'NOTE', 'REVIEW', 'WORKAROUND']"
_MARKED = f"""m AS (SELECT conv_id, turn, {_TAG_LIST}[CAST((turn + conv_id) % 9 AS INT) + 1] AS tag, role, text AS message FROM conversations)"""


def _marked(spark, sf_dir):
    """Conversations as files whose lines are comments with markers."""
    c = read(spark, sf_dir, "conversations")
    tag = F.element_at(F.array(*(F.lit(t) for t in markers.TAGS)), ((F.col("turn") + F.col("conv_id")) % 9).cast("int") + 1)
    line = F.concat(F.lit("# "), F.lower(tag), F.lit("("), "role", F.lit("): "), "text")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.replace(line, F.lit("\n"), F.lit("\n# ")).alias("line")))), lambda r: r["line"])
    return c.groupBy("conv_id").agg(F.array_join(rows, "\n").alias("content")).select(F.col("conv_id").cast("string").alias("path"), "content")


@query(f"WITH {_MARKED} SELECT CAST(conv_id AS VARCHAR) AS path, tag, role AS author, trim(split_part(message, chr(10), 1)) AS message, count(*) AS n FROM m GROUP BY ALL")
def markers_extract(spark, sf_dir):
    return markers.markers(_marked(spark, sf_dir)).groupBy("path", "tag", "author", "message").agg(F.count("*").alias("n"))


@query(f"WITH {_MARKED} SELECT tag, count(*) AS n, CAST(list_position({_TAG_LIST}, tag) AS INT) AS ord FROM m GROUP BY tag")
def markers_count(spark, sf_dir):
    return markers.by_tag(markers.markers(_marked(spark, sf_dir)))


@query(f"WITH {_MARKED} SELECT CAST(conv_id AS VARCHAR) AS path, tag, count(*) AS n FROM m GROUP BY ALL")
def markers_by_file(spark, sf_dir):
    return markers.by_file(markers.markers(_marked(spark, sf_dir)))


@query(X.values([(1, "TODO", "", "x"), (3, "FIXME", "bob", "y"), (4, "NOTE", "", "next line"), (7, "HACK", "", "z")], "line_no, tag, author, message"))
def markers_fixture(spark, sf_dir):
    files = spark.createDataFrame([("a.py", X.MARKED)], "path string, content string")
    return markers.markers(files).select("line_no", "tag", "author", "message")


# --- audit


def _rule_rows() -> str:
    """The rules as rows; patterns that look around are given to SQL in a form without it."""
    plain = {
        ("high", "github-old"): r"(?i)[a-f0-9]{40}(\s|$|\"|')",
        ("high", "private-key-path"): r"(?i)id_rsa|id_ecdsa|id_ed25519|id_dsa",
        ("low", "password-field"): r"(?i)(password|passwd|pwd)\s*[:=]\s*([^\s'\"*xX]|['\"][^*xX]|['\"]?$)",
        ("low", "secret-field"): r"(?i)(secret)\s*[:=]\s*([^\s'\"*xX]|['\"][^*xX]|['\"]?$)",
        ("low", "api-key-field"): r"(?i)(api[-_]?key|apikey)\s*[:=]\s*([^\s'\"*xX]|['\"][^*xX]|['\"]?$)",
        ("low", "token-field"): r"(?i)(token)\s*[:=]\s*([^\s'\"*xX]|['\"][^*xX]|['\"]?$)",
    }
    rows = [(s, i, name, plain.get((s, name), p), d) for s, rules in secrets.SEVERITIES.items() for i, (name, p, d) in enumerate(rules)]
    return X.values(rows, "severity, ord, rule, pattern, description")


_AUDIT = f"""{_LINES}, rules AS ({_rule_rows()}), hits AS (
  SELECT path, line_no, severity, rule, description, row_number() OVER (PARTITION BY path, line_no, severity ORDER BY ord) AS rn
  FROM lines JOIN rules ON regexp_matches(line, pattern) WHERE NOT (line LIKE '%AKIA%' AND line LIKE '%EXAMPLE%'))"""


@query(f"WITH {_AUDIT} SELECT path, CAST(line_no AS INT) AS line_no, severity, rule, description FROM hits WHERE rn = 1")
def audit_findings(spark, sf_dir):
    return secrets.findings(docs(spark, sf_dir)).select("path", "line_no", "severity", "rule", "description")


@query(
    f"""WITH {_AUDIT}, f AS (SELECT severity FROM hits WHERE rn = 1)
    SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total,
    CASE WHEN count(*) FILTER (severity = 'high') = 0 THEN 'ok' ELSE 'fail' END AS status FROM f"""
)
def audit_by_severity(spark, sf_dir):
    return secrets.summary(secrets.findings(docs(spark, sf_dir)))


@query(f"WITH {_AUDIT} SELECT h.path, CAST(h.line_no AS INT) AS line_no, severity, rule FROM hits h JOIN lines l USING (path, line_no) WHERE rn = 1 AND NOT regexp_matches(l.line, '(?i)TOKEN = .[0-9]')")
def audit_allowlist(spark, sf_dir):
    return secrets.findings(docs(spark, sf_dir), allow=["TOKEN = .[0-9]"]).select("path", "line_no", "severity", "rule")


@query(
    r"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS path, string_split(html, chr(10)) AS ls FROM pages), l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM p)
    SELECT path, CAST(line_no AS INT) AS line_no, 'token-field' AS rule FROM l WHERE regexp_matches(line, '(?i)(token)\s*[:=]\s*([^\s''"*xX]|[''"][^*xX]|[''"]?$)')"""
)
def audit_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return secrets.findings(pages).where("severity = 'low' AND rule = 'token-field'").select("path", "line_no", "rule")


@query(
    f"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS path, string_split(html, chr(10)) AS ls FROM pages), lines AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM p), rules AS ({_rule_rows()}),
    hits AS (SELECT path, line_no, severity, rule, row_number() OVER (PARTITION BY path, line_no, severity ORDER BY ord) AS rn FROM lines JOIN rules ON regexp_matches(line, pattern) WHERE NOT (line LIKE '%AKIA%' AND line LIKE '%EXAMPLE%'))
    SELECT path, CAST(line_no AS INT) AS line_no, severity, rule FROM hits WHERE rn = 1"""
)
def audit_pages_all(spark, sf_dir):
    """Every finding of every rule in the pages."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return secrets.findings(pages).select("path", "line_no", "severity", "rule")


def _secret_lines() -> list[tuple[str, str, str]]:
    """(severity, rule, line): one made-up line for rules, put together so that no secret is spelt out here."""
    h, a = "0123456789abcdef", "A1b2C3d4"
    return [
        ("high", "aws-key", "AKI" + "A" + "Q" * 16),
        ("high", "github-token", "gh" + "p_" + a * 5),
        ("high", "google-api", "AI" + "za" + (a * 5)[:35]),
        ("high", "jwt-token", "ey" + "J" + a * 2 + "." + a * 2 + "." + a * 2),
        ("high", "aws-secret", "aws_" + "secret_access_key " + (a * 5)[:40]),
        ("high", "github-old", "sum " + (h * 3)[:40]),
        ("high", "slack-token", "xo" + "xb-" + "1" * 11 + "-" + "2" * 11 + "-" + a * 3),
        ("high", "slack-webhook", "https://hooks.slack" + ".com/services/" + "wxyz" * 11),
        ("high", "ssh-private-key", "-----BEGIN RSA" + "KEY-----"),
        ("high", "pgp-private-key", "-----BEGIN PGP " + "PRIVATE KEY BLOCK-----"),
        ("high", "generic-secret", "pass" + "word: " + a * 2),
        ("high", "generic-token", "tok" + "en='" + a * 3 + "'"),
        ("high", "private-key-path", "cp id_" + "rsa x"),
        ("high", "pypi-token", "pypi" + "-api-token of " + (a * 3)[:20]),
        ("high", "stripe-test", "sk_" + "test_" + a * 3),
        ("high", "twilio", "S" + "K" + (h * 2)),
        ("high", "npm-token", "np" + "m_" + (a * 5)[:36]),
        ("high", "stripe-live", "sk_" + "live_" + a * 3),
        ("high", "docker-config", '"auths" : auths' + " {"),
        ("high", "heroku-api", "heroku " + h[:8] + "-" + h[:4] + "-" + h[:4] + "-" + h[:4] + "-" + h[:12]),
        ("medium", "basic-auth-url", "https://user:" + "pw@host/x"),
        ("medium", "s3-endpoint", "https://s3" + ".eu.amazonaws.com/bucket"),
        ("medium", "redis-connection", "redis://u:" + "p@host"),
        ("medium", "connection-string", "connstr = '" + "server=db;user=me;x" * 2 + "'"),
        ("medium", "pg-connection", "postgres" + "://u:" + "p@host"),
        ("medium", "mongo-connection", "mongodb" + "+srv://u:" + "p@host"),
        ("medium", "mysql-connection", "mysql" + "://u:" + "p@host"),
        ("medium", "x-api-key-header", "X-Api" + "-Key: " + a * 3),
        ("medium", "aws-config-ref", "cat ~/.aws" + "/credentials"),
        ("medium", "authorization-header", "Bearer " + a * 3),
        ("medium", "ssh-key-path", "cp ~/.ssh" + "/config ."),
        ("low", ".env-ref", "load .en" + "v now"),
        ("low", "password-field", "pass" + "word = open"),
        ("low", "secret-field", "sec" + "ret = open"),
        ("low", "api-key-field", "api" + "-key : open"),
        ("low", "token-field", "tok" + "en = open"),
        ("low", "private-key-path", "the private" + "_key of"),
        ("low", "certificate", "-----BEGIN " + "CERTIFICATE-----"),
    ]


@query(X.values([(i + 1, s, r) for i, (s, r, _) in enumerate(_secret_lines())], "line_no, severity, rule"))
def audit_rules_fixture(spark, sf_dir):
    files = spark.createDataFrame([("all.txt", "\n".join(x for _, _, x in _secret_lines()))], "path string, content string")
    wanted = spark.createDataFrame([(i + 1, s) for i, (s, _, _) in enumerate(_secret_lines())], "line_no int, severity string")
    return secrets.findings(files).join(F.broadcast(wanted), ["line_no", "severity"], "left_semi").select("line_no", "severity", "rule")


# --- history


_CHURN = "log AS (SELECT CAST(l_partkey AS VARCHAR) AS file, l_orderkey AS commit, row_number() OVER (ORDER BY o_orderdate DESC, l_orderkey, l_linenumber) AS seq, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _log(spark, sf_dir):
    """Line items as the file log of orders; the sequence is the order date, newest first."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_partkey").cast("string").alias("file"), (-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("seq"), "o_orderdate")


@query(f"WITH {_CHURN} SELECT file, count(*) AS commits FROM log GROUP BY file HAVING count(*) >= 2 ORDER BY commits DESC, file LIMIT 20")
def churn_top(spark, sf_dir):
    return history.churn(_log(spark, sf_dir), top=20, tie="file")


@query(f"WITH {_CHURN} SELECT file, count(*) AS commits FROM log WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY file HAVING count(*) >= 5")
def churn_since(spark, sf_dir):
    recent = _log(spark, sf_dir).where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return history.churn(recent, top=0, least=5, tie="file")


@query(f"WITH {_CHURN} SELECT file, count(*) AS commits FROM log GROUP BY file HAVING count(*) >= 2 ORDER BY commits DESC, max(o_orderdate) DESC, file LIMIT 20")
def churn_first_seen(spark, sf_dir):
    return history.churn(_log(spark, sf_dir), top=20)


_TYPES = "MAP {'error': 'fix', 'signup': 'feat', 'purchase': 'perf!', 'view': 'docs', 'click': ''}"
_COMMITS = f"""raw AS (SELECT event_id, printf('%07x', event_id) AS hash, event_type AS t, {_TYPES}[event_type] AS typ, user_id FROM events),
c AS (SELECT event_id, hash, t, typ, CASE WHEN typ = '' THEN 'user ' || user_id || ' clicked' ELSE replace(typ, '!', '') || '(u' || user_id || ')' || CASE WHEN typ LIKE '%!' THEN '!' ELSE '' END || ': ' || t || ' event' END AS raw FROM raw),
p AS (SELECT event_id, hash, CASE typ WHEN 'fix' THEN 'Bug Fixes' WHEN 'feat' THEN 'Features' WHEN 'perf!' THEN 'Performance' WHEN 'docs' THEN 'Documentation' ELSE 'Other' END AS category,
 CASE WHEN typ = '' THEN '' ELSE regexp_extract(raw, '\\((u[0-9]+)\\)', 1) END AS scope, typ = 'perf!' AS breaking, CASE WHEN typ = '' THEN raw ELSE t || ' event' END AS subject, raw FROM c)""".replace("\\\\", "\\")


def _commits(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for p in (("error", "fix"), ("signup", "feat"), ("purchase", "perf"), ("view", "docs")) for x in p))[F.col("event_type")]
    message = F.when(F.col("event_type") == "click", F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" clicked"))).otherwise(
        F.concat(kind, F.lit("(u"), F.col("user_id").cast("string"), F.lit(")"), F.when(F.col("event_type") == "purchase", "!").otherwise(""), F.lit(": "), "event_type", F.lit(" event"))
    )
    return history.parse_commits(e.select("event_id", F.concat(F.lpad(F.lower(F.hex("event_id")), 7, "0"), F.lit(" "), message).alias("line")))


@query(f"WITH {_COMMITS} SELECT event_id, hash, category, scope, breaking, subject, raw FROM p")
def changelog_parse(spark, sf_dir):
    return _commits(spark, sf_dir)


@query(f"WITH {_COMMITS} SELECT category, count(*) AS n, count(*) FILTER (breaking) AS breaking, CAST(list_position(['Features', 'Bug Fixes', 'Performance', 'Refactoring', 'Tests', 'Documentation', 'Style', 'Build', 'CI', 'Chores', 'Reverts', 'Other'], category) AS INT) AS ord FROM p GROUP BY category")
def changelog_grouped(spark, sf_dir):
    return history.grouped(_commits(spark, sf_dir))


@query(f"WITH {_COMMITS} SELECT event_id, category, subject FROM p ORDER BY event_id DESC LIMIT 20")
def changelog_limit(spark, sf_dir):
    return search.top(_commits(spark, sf_dir).select("event_id", "category", "subject"), 20, F.desc("event_id"))


@query(
    X.values(
        [
            (0, "a1b2c3d", "Features", "", False, "add search"),
            (1, "b2c3d4e", "Bug Fixes", "core", False, "handle nulls"),
            (2, "c3d4e5f", "Features", "auth,api", True, "drop old tokens"),
            (3, "d4e5f6a", "Random", "", False, "words"),
            (4, "e5f6a7b", "Other", "", False, "plain message"),
            (6, "f6a7b8c", "Documentation", "", False, "explain: twice"),
        ],
        "seq, hash, category, scope, breaking, subject",
    )
)
def changelog_fixture(spark, sf_dir):
    return history.parse_commits(X.lines_of(spark, X.COMMITS)).drop("raw")


@query(X.values([("Features", 2), ("Bug Fixes", 1), ("Documentation", 1), ("Other", 1)], "category, n"))
def changelog_other_dropped(spark, sf_dir):
    return history.grouped(history.parse_commits(X.lines_of(spark, X.COMMITS))).select("category", "n")


# --- lint


def _lint_text(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem")
    place = F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".py:"), F.col("l_linenumber").cast("string"))
    kind = F.col("l_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(place, F.lit(":3: E501 too long "), "l_returnflag"))
        .when(kind == 1, F.concat(place, F.lit(": error: bad type "), "l_linestatus"))
        .when(kind == 2, F.concat(place, F.lit(":7: W0611: unused "), "l_returnflag"))
        .otherwise(F.concat(place, F.lit(": odd "), "l_linestatus"))
    )
    return i.select("l_orderkey", "l_linenumber", text.alias("text"))


_LINT = """x AS (SELECT *, l_orderkey % 4 AS k FROM lineitem), issues AS (SELECT l_orderkey, l_linenumber,
  CASE k WHEN 0 THEN 'ruff' WHEN 1 THEN 'mypy' WHEN 2 THEN 'pylint' ELSE 'generic' END AS parser, 'src/p' || l_partkey || '.py' AS file, CAST(l_linenumber AS INT) AS line,
  CASE k WHEN 0 THEN 3 WHEN 2 THEN 7 END AS col, CASE k WHEN 0 THEN 'E501' WHEN 1 THEN 'error' WHEN 2 THEN 'W0611' END AS severity,
  CASE k WHEN 0 THEN 'too long ' || l_returnflag WHEN 1 THEN 'bad type ' || l_linestatus WHEN 2 THEN 'unused ' || l_returnflag ELSE 'odd ' || l_linestatus END AS message FROM x)"""


@query(f"WITH {_LINT} SELECT * FROM issues")
def lint_parse(spark, sf_dir):
    return lint.parse_lines(_lint_text(spark, sf_dir))


@query(f"WITH {_LINT} SELECT CASE WHEN severity IN ('error', 'E') THEN 'error' WHEN severity IN ('warning', 'W') THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM issues GROUP BY 1")
def lint_severity(spark, sf_dir):
    return lint.by_level(lint.parse_lines(_lint_text(spark, sf_dir)))


@query(
    f"""WITH {_LINT} SELECT l_orderkey, l_linenumber, parser FROM issues
    ORDER BY CASE WHEN severity = 'error' THEN 1 ELSE 3 END, l_orderkey, l_linenumber LIMIT 30"""
)
def lint_shown(spark, sf_dir):
    return lint.shown(lint.parse_lines(_lint_text(spark, sf_dir)), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "parser")


@query(
    X.values(
        [
            (0, "ruff", "src/a.py", 10, 5, "E501", "line too long"),
            (1, "ruff", "src/b.js", 3, 7, "error", "Unexpected token"),
            (2, "tsc", "src/c.ts", 4, 9, "error", "TS2304: Cannot find name"),
            (3, "mypy", "src/d.py", 12, None, "error", "Incompatible types"),
            (4, "pylint", "src/e.py", 7, 1, "C0103", "Invalid name"),
            (5, "generic", "src/f.py", 9, None, None, "something odd"),
        ],
        "seq, parser, file, line, col, severity, message",
    )
)
def lint_fixture(spark, sf_dir):
    return lint.parse_lines(X.lines_of(spark, X.LINT).withColumnRenamed("line", "text"))


@query(X.values([("/app/a.js", 3, 7, "error", "Unexpected x"), ("/app/a.js", 9, 1, "warning", "Unused y"), ("/app/b.js", 1, 2, "error", "Bad z")], "file, line, col, severity, message"))
def lint_eslint_block(spark, sf_dir):
    lines = ["/app/a.js", "  3:7  error  Unexpected x  no-x", "  9:1  warning  Unused y  no-unused-vars", "", "/app/b.js", "  1:2  error  Bad z  rule/z", "", "3 problems"]
    frame = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run string, line_no int, text string")
    return lint.parse_output(frame).select("file", "line", "col", "severity", "message")


@query(X.values([("pytest", 5, 2, 1, 8, 0), ("mypy", 0, 0, 3, 3, 3), ("ruff", 0, 0, 12, 12, 12)], "tool, passed, failed, errors, total, issues"))
def tool_totals_fixture(spark, sf_dir):
    rows = [("pytest", "2 failed, 5 passed, 1 error in 3s"), ("mypy", "Found 3 errors in 2 files (checked 9 source files)"), ("ruff", "Found 12 errors.")]
    return lint.tool_totals(spark.createDataFrame(rows, "tool string, output string")).drop("output")


# --- graphs


_PROJECT_EDGES = [("cli.py", "main.py"), ("main.py", "models.py"), ("main.py", "utils.py"), ("utils.py", "models.py")]


def _project(spark):
    return X.code_files(spark, tuple(X.PROJECT))


@query(X.values(_PROJECT_EDGES, "src, dst"))
def import_edges_fixture(spark, sf_dir):
    return graph.import_graph(_project(spark))


@query(X.values([("panel.ts", "./util"), ("engine.cpp", "engine.h"), ("test_mod.py", "mod"), ("test_mod.py", "top"), ("standalone.py", "sys"), ("standalone.py", "json")], "path, module"))
def import_statements(spark, sf_dir):
    return graph.imports(X.code_files(spark, ("panel.ts", "engine.cpp", "test_mod.py", "standalone.py"))).select("path", "module")


@query(X.values([("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "util.py"), ("src/x.ts", "src/lib/y.ts"), ("c/m.cpp", "c/m.h")], "src, dst"))
def resolve_candidates(spark, sf_dir):
    """The fixed mode: relative and dotted Python modules, and headers with their extension."""
    rows = [("pkg/a.py", "from .b import x\nimport util\n"), ("pkg/b.py", ""), ("util.py", ""), ("src/x.ts", 'import "./lib/y"'), ("src/lib/y.ts", ""), ("c/m.cpp", '#include "m.h"\n'), ("c/m.h", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    files = files.select("path", T.extension("path").alias("ext"), S.language(T.extension("path")).alias("lang"), "content")
    return graph.import_graph(files, mode="fixed")


@query(X.values([("main.py", 2, 1, "cluster"), ("utils.py", 1, 1, "cluster"), ("models.py", 0, 2, "leaf"), ("cli.py", 1, 0, "root"), ("standalone.py", 0, 0, "isolated")], "path, out_degree, in_degree, role"))
def graph_roles_fixture(spark, sf_dir):
    files = _project(spark)
    return graph.degrees(files, graph.import_graph(files))


_PAGE_EDGES = r"""page AS (SELECT page_id, split_part(url, '/', 4) AS node, html FROM pages),
e AS (SELECT node AS src, unnest(regexp_extract_all(html, 'href="/([a-z]+)', 1)) AS dst FROM page),
nodes AS (SELECT DISTINCT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e UNION ALL SELECT node FROM page)),
deg AS (SELECT node, (SELECT count(*) FROM e WHERE src = node) AS out_degree, (SELECT count(*) FROM e WHERE dst = node) AS in_degree FROM nodes),
roles AS (SELECT *, CASE WHEN out_degree = 0 AND in_degree = 0 THEN 'isolated' WHEN out_degree = 0 THEN 'leaf' WHEN in_degree = 0 THEN 'root' WHEN out_degree >= 5 OR in_degree >= 5 THEN 'hub' ELSE 'cluster' END AS role FROM deg)"""


def _page_graph(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.split("url", "/")[3].alias("node"), "html")
    edges = pages.select(F.col("node").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([a-z]+)'), 1)).alias("dst"))
    return pages.select("node").distinct(), edges


@query(f"WITH {_PAGE_EDGES} SELECT node, out_degree, in_degree, role FROM roles")
def graph_degrees(spark, sf_dir):
    return graph.degrees(*_page_graph(spark, sf_dir), node="node")


@query(
    f"""WITH {_PAGE_EDGES} SELECT count(*) AS total_files, sum(out_degree) AS total_edges, count(*) FILTER (role = 'leaf') AS leaf_files, count(*) FILTER (role = 'root') AS root_files,
    count(*) FILTER (role = 'hub') AS hub_files, count(*) FILTER (role = 'cluster') AS cluster_files, round(sum(out_degree) / count(*), 2) AS average_out_degree FROM roles"""
)
def graph_stats(spark, sf_dir):
    return graph.stats(graph.degrees(*_page_graph(spark, sf_dir), node="node"))


_STEPS = "step AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id FROM events), edges AS (SELECT DISTINCT src, dst FROM step WHERE dst IS NOT NULL)"


def _steps(spark, sf_dir):
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("src"), following.alias("dst")).where("dst IS NOT NULL")


@query(f"WITH {_STEPS} SELECT src, dst, count(*) AS n FROM step WHERE dst IS NOT NULL GROUP BY ALL")
def event_transitions(spark, sf_dir):
    return _steps(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {_STEPS} SELECT 'imports' AS direction, dst AS file FROM edges WHERE src = 'click' UNION ALL SELECT 'imported_by', src FROM edges WHERE dst = 'click'")
def graph_neighbors(spark, sf_dir):
    return graph.neighbours(_steps(spark, sf_dir).select("src", "dst").distinct(), "click")


_GEO = """geo AS (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 3) FROM region)"""


def _geography(spark, sf_dir):
    """Customers, nations and regions as a graph; each region also points back at a nation, so there are cycles."""
    node = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    c = read(spark, sf_dir, "customer").select(node("c", F.col("c_custkey")).alias("src"), node("n", F.col("c_nationkey")).alias("dst"))
    n = read(spark, sf_dir, "nation").select(node("n", F.col("n_nationkey")).alias("src"), node("r", F.col("n_regionkey")).alias("dst"))
    r = read(spark, sf_dir, "region").select(node("r", F.col("r_regionkey")).alias("src"), node("n", F.col("r_regionkey") * 3).alias("dst"))
    return c.unionByName(n).unionByName(r).distinct()


@query(
    f"""WITH RECURSIVE {_GEO}, tree AS (
      SELECT src AS root, [src] AS path, src AS node, 0 AS depth, false AS cycle FROM geo WHERE src LIKE 'n%'
      UNION SELECT root, list_append(path, dst), dst, depth + 1, list_contains(path, dst) FROM tree JOIN geo ON node = src WHERE NOT cycle AND depth < 5)
    SELECT root, array_to_string(path, '>') AS chain, node, depth, cycle FROM tree"""
)
def graph_tree(spark, sf_dir):
    edges = _geography(spark, sf_dir)
    roots = edges.where("src LIKE 'n%'").select(F.col("src").alias("root")).distinct()
    return graph.tree(edges, roots).select("root", F.array_join("path", ">").alias("chain"), "node", "depth", "cycle")


@query(f"WITH RECURSIVE {_GEO}, tc AS (SELECT src, dst FROM geo UNION SELECT tc.src, geo.dst FROM tc JOIN geo ON tc.dst = geo.src) SELECT src, dst FROM tc")
def graph_closure(spark, sf_dir):
    return graph.closure(_geography(spark, sf_dir))


@query(f"WITH RECURSIVE {_GEO}, tc AS (SELECT src, dst FROM geo WHERE src != dst UNION SELECT tc.src, geo.dst FROM tc JOIN geo ON tc.dst = geo.src) SELECT src AS node FROM tc WHERE src = dst")
def graph_cycle_nodes(spark, sf_dir):
    return graph.cycle_nodes(_geography(spark, sf_dir))


@query(X.values([("a>b>a",), ("b>c>b",), ("x>y>z>x",)], "cycle"))
def graph_cycles_fixture(spark, sf_dir):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("q", "q"), ("d", "x")]
    return graph.cycles(spark.createDataFrame(edges, "src string, dst string")).select(F.array_join("cycle", ">").alias("cycle"))


@query(
    """WITH p AS (SELECT source || '/' || lang || '/' || doc_id AS path, source, lang FROM documents)
    SELECT DISTINCT 1 AS depth, source AS entry, true AS is_dir FROM p UNION SELECT DISTINCT 2, source || '/' || lang, true FROM p"""
)
def directory_tree(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return graph.path_tree(d, depth=2)


# --- scopes, callers, impact


_SESSION = """s AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""


def _positions(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "event_id", "event_type", F.row_number().over(by).alias("line_no"))


def _spans(positions):
    """Nested scopes: every purchase opens one over the next four events of its user, every signup over eight."""
    opened = positions.where(F.col("event_type").isin("purchase", "signup"))
    size = F.when(F.col("event_type") == "purchase", 4).otherwise(8)
    return opened.select("path", F.concat("event_type", F.lit("@"), F.col("line_no").cast("string")).alias("name"), F.lit("function").alias("kind"), F.col("line_no").alias("start"), (F.col("line_no") + size).alias("end"))


@query(
    f"""WITH {_SESSION}, sc AS (SELECT user_id, event_type || '@' || pos AS name, pos AS a, pos + CASE event_type WHEN 'purchase' THEN 4 ELSE 8 END AS b FROM s WHERE event_type IN ('purchase', 'signup')),
    r AS (SELECT s.event_id, sc.name, row_number() OVER (PARTITION BY s.event_id ORDER BY sc.b - sc.a, sc.a DESC) AS rn FROM s LEFT JOIN sc ON s.user_id = sc.user_id AND s.pos BETWEEN sc.a AND sc.b)
    SELECT event_id, name AS scope FROM r WHERE rn = 1"""
)
def scope_innermost(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return trace.enclosing(p.select("path", "event_id", "line_no"), _spans(p)).select("event_id", "scope")


@query(
    f"""WITH {_SESSION}, sc AS (SELECT user_id, event_type || '@' || pos AS name, pos AS a, pos + CASE event_type WHEN 'purchase' THEN 4 ELSE 8 END AS b FROM s WHERE event_type IN ('purchase', 'signup')),
    r AS (SELECT s.event_id, sc.name, row_number() OVER (PARTITION BY s.event_id ORDER BY sc.a) AS rn FROM s LEFT JOIN sc ON s.user_id = sc.user_id AND s.pos BETWEEN sc.a AND sc.b)
    SELECT event_id, name AS scope FROM r WHERE rn = 1"""
)
def scope_outermost(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return trace.enclosing(p.select("path", "event_id", "line_no"), _spans(p), innermost=False).select("event_id", "scope")


@query(
    f"""WITH RECURSIVE {_GEO}, up AS (SELECT 'r1' AS root, 1 AS depth, src AS caller FROM geo WHERE dst = 'r1' UNION SELECT root, depth + 1, src FROM up JOIN geo ON dst = caller WHERE depth < 3)
    SELECT root, min(depth) AS depth, caller FROM up WHERE caller != root GROUP BY root, caller"""
)
def callers_depth_n(spark, sf_dir):
    calls = _geography(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("symbol"))
    return trace.callers(calls, spark.createDataFrame([("r1",)], "root string"), depth=3).select("root", "depth", "caller")


@query(
    f"""WITH RECURSIVE {_GEO}, down AS (SELECT 'c7' AS root, 0 AS depth, 'c7' AS symbol UNION SELECT root, depth + 1, dst FROM down JOIN geo ON src = symbol WHERE depth < 2),
    least AS (SELECT root, symbol, min(depth) AS depth FROM down GROUP BY root, symbol)
    SELECT root, depth, symbol, string_agg(DISTINCT dst, ',' ORDER BY dst) AS callees FROM least JOIN geo ON src = symbol GROUP BY ALL"""
)
def callees_depth_n(spark, sf_dir):
    calls = _geography(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("symbol"))
    return trace.callees(calls, spark.createDataFrame([("c7",)], "root string"), depth=3)


@query(
    X.values(
        [("class", "Shape", 2), ("function", "area", 3), ("function", "helper", 6), ("function", "fetch", 9), ("variable", "LIMIT", 12), ("class", "Circle", 14)],
        "kind, name, line",
    )
)
def py_tags(spark, sf_dir):
    return pysyntax.tags(pysyntax.facts(X.code_files(spark, ("defs.py",)))).select("kind", "name", "line")


@query(X.values([("async_function", 9)], "type, line"))
def py_definitions(spark, sf_dir):
    return pysyntax.definitions(pysyntax.facts(X.code_files(spark)), "fetch").select("type", "line")


@query(X.values([("mod.py", "call", 14), ("test_mod.py", "call", 4), ("test_mod.py", "import", 1)], "path, type, line"))
def py_references(spark, sf_dir):
    return pysyntax.references(pysyntax.facts(X.code_files(spark, ("mod.py", "test_mod.py"))), "top")


@query(X.values([("middle", "bottom", 5), ("inner", "hidden", 9), ("top", "middle", 10), ("top", "inner", 10), ("run", "top", 14)], "scope, callee, line"))
def py_callees(spark, sf_dir):
    return pysyntax.calls(pysyntax.facts(X.code_files(spark, ("mod.py",)))).select("scope", "callee", "line")


@query(X.values([(1, "middle"), (2, "top"), (3, "run"), (3, "test_it")], "depth, caller"))
def call_trace_fixture(spark, sf_dir):
    calls = pysyntax.calls(pysyntax.facts(X.code_files(spark, ("mod.py", "test_mod.py")))).select(F.col("scope").alias("caller"), F.col("callee").alias("symbol"))
    return trace.callers(calls, spark.createDataFrame([("bottom",)], "root string"), depth=3).select("depth", "caller")


@query(X.values([("definition", "mod.py", 7, "function"), ("reference", "mod.py", 14, "call"), ("reference", "test_mod.py", 1, "import"), ("reference", "test_mod.py", 4, "call"), ("test", "test_mod.py", 1, "import"), ("test", "test_mod.py", 4, "call")], "section, path, line, type"))
def impact_fixture(spark, sf_dir):
    facts = pysyntax.facts(X.code_files(spark, ("mod.py", "test_mod.py")))
    return trace.impact(pysyntax.definitions(facts, "top").select("path", "type", "line"), pysyntax.references(facts, "top"))


@query(X.values([("add", 5, 7), ("start", 8, 10)], "name, start_line, end_line"))
def cpp_scopes_fixture(spark, sf_dir):
    return trace.cpp_scopes(trace.cpp_blocks(X.code_files(spark, ("engine.cpp",)))).select("name", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query(X.values([("add", "helper", 6), ("start", "ready", 9), ("start", "add", 9)], "scope, callee, line"))
def cpp_callees_fixture(spark, sf_dir):
    return trace.cpp_calls(trace.cpp_blocks(X.code_files(spark, ("engine.cpp",)))).select("scope", "callee", "line")


@query(X.values([("Engine", "class", 3), ("MAX_ITEMS", "macro", 2), ("add", "function", 5), ("Engine", "method", 8)], "name, kind, line"))
def cpp_tags_fixture(spark, sf_dir):
    return symbols.cpp_tags(X.code_files(spark, ("engine.cpp",))).select("name", "kind", "line")


@query(X.values([("Panel", "class", 3), ("Props", "interface", 8), ("helper", "function", 5), ("run", "variable", 2), ("text", "variable", 10), ("ghost", "function", 6), ("Fake", "class", 10)], "name, kind, line"))
def ts_tags_fixture(spark, sf_dir):
    """Tags come from the text as it is, so what comments and strings hold counts too."""
    return symbols.ts_tags(X.code_files(spark, ("panel.ts",))).select("name", "kind", "line").distinct()


_SCANNED = ("a.py", "env/a.py", "target/a.rs", "venv/b.ts", "src/c.hpp", "src/d.jsx", "src/e.go", ".idea/f.py", ".ruff_cache/g.py", "docs/h.md", "src/I.PY")


@query(
    X.values(
        [(s, p) for s, ps in (("impact", ("a.py", "target/a.rs", "src/c.hpp", "src/d.jsx", "src/e.go", "src/I.PY")), ("impact js", ("src/d.jsx",)), ("dead", ("a.py", "env/a.py", "src/d.jsx", "src/I.PY")), ("health", ("a.py", "src/c.hpp", "src/d.jsx", "src/I.PY"))) for p in ps],
        "scan, path",
    )
)
def scan_variants_fixture(spark, sf_dir):
    """Which paths each scan keeps: own extensions and own folders left out; hidden folders in none."""
    paths = spark.createDataFrame([(p,) for p in _SCANNED], "path string")
    kept = [paths.where(S.in_scan("path", *args)).select(F.lit(" ".join(args)).alias("scan"), "path") for args in (("impact",), ("impact", "js"), ("dead",), ("health",))]
    return metrics.union(kept)


@query(
    X.values(
        [("m.py", "import", "np", 1), ("m.py", "import", "os", 2), ("m.py", "class", "A", 3), ("m.py", "function", "go", 4), ("m.py", "variable", "x", 5), ("m.py", "variable", "late", 6), ("e.cpp", "macro", "MAX", 1), ("e.cpp", "class", "Engine", 2)],
        "path, type, name, line",
    )
)
def all_definitions_fixture(spark, sf_dir):
    """Imports by the name they bind, async functions as functions, one name of each assignment."""
    rows = [("m.py", "py", "import numpy as np\nimport os.path\nclass A:\n    async def go(self): pass\nx = y = 1\nA.z = late = later = 2\n"), ("e.cpp", "cpp", "#define MAX 3\nclass Engine {\n};\n")]
    return trace.all_definitions_in(spark.createDataFrame(rows, "path string, lang string, content string"))


@query(X.values([("  m.py:1:4  definition\n  m.py:4:6  reference",)], "report"))
def refactor_listing(spark, sf_dir):
    rows = [("m.py", "def greet(x):\n    return x\n\nprint(greet(1), 'greet')\n")]
    files = spark.createDataFrame(rows, "path string, content string").withColumn("lang", F.lit("py"))
    return render.refactor_text(pysyntax.rename_spans(pysyntax.facts(files), "greet"))


@query(X.values([("fmt:\n  ✅ ruff         (check)\n  ❌ prettier     check exited 2\n\n  ❌ Some formatters failed",)], "report"))
def formatters_text(spark, sf_dir):
    runs = spark.createDataFrame([(1, "ruff", "ok", 0, True), (2, "prettier", "fail", 2, True)], "seq int, tool string, status string, exit_code int, check boolean")
    return render.formatters_text(runs)


@query(
    X.values(
        [("# Snapshot: demo\n**Date:** 2024-01-02 03:04:05\n**Tool:** snapshot v1\n\n## Git\n- **Branch:** main\n- **Commit:** abc1234\n- **Message:** first\n- **Dirty files:** 1\n- Changes:\n  - ` M a.py`\n- Recent commits:\n  - `abc1234 first`\n\n## Files\n- **Total files:** 4\n- **Total lines:** 8\n- By extension:\n  - `.py`: 3\n  - `.md`: 1\n\n## Directory Tree\ndemo/\n  a.py\n  src/\n    deep/\n      c.py\n    z.py\n  top.md\n",)],
        "report",
    )
)
def snapshot_fixture(spark, sf_dir):
    """Workspace, counts and tree as one report; the tree goes two folders down."""
    scanned = spark.createDataFrame([("a.py", ".py", 1), ("src/z.py", ".py", 2), ("src/deep/c.py", ".py", 0), ("top.md", ".md", 5)], "path string, ext string, lines int")
    own = spark.createDataFrame([("main", "abc1234", "first", 1, [" M a.py"], ["abc1234 first"])], "branch string, commit string, subject string, n_changed int, changed array<string>, recent array<string>")
    return render.snapshot_text(metrics.snapshot(scanned, own), render.tree_text(scanned, "demo"), "demo", "2024-01-02 03:04:05", "1")


@query(X.values([("middle", 10), ("inner", 10)], "callee, line"))
def outside_nested_fixture(spark, sf_dir):
    """Calls of top that are not those of the function nested in it."""
    facts = pysyntax.facts(X.code_files(spark, ("mod.py",)))
    calls = pysyntax.calls(facts).select("path", "callee", "line")
    return trace.outside_nested(calls, pysyntax.scopes(facts), "top").select("callee", "line")


@query(X.values([("m.py", "--- a/m.py\n+++ b/m.py\n@@ -1,5 +1,5 @@\n one\n-two\n+2\n three\n four\n five")], "path, diff"))
def diff_fixture(spark, sf_dir):
    files = spark.createDataFrame([("m.py", "one\ntwo\nthree\nfour\nfive\nsix"), ("same.py", "x")], "path string, content string")
    return rewrite.unified_diff(files, rewrite.renamed(files, "two", "2"))


@query(X.values([("class", "Engine", 3), ("macro", "MAX_ITEMS", 2), ("method", "start", 8)], "type, name, line"))
def cpp_definitions_fixture(spark, sf_dir):
    found = symbols.cpp_definitions(X.code_files(spark, ("engine.cpp",)))
    return found.where(F.col("type").isin("class", "macro", "method")).select("type", "name", "line")


@query(X.values([("arrow_function", "run", 2), ("class", "Panel", 3), ("function", "helper", 5), ("interface", "Props", 8), ("variable", "text", 10)], "type, name, line"))
def ts_definitions_fixture(spark, sf_dir):
    return symbols.ts_definitions(X.code_files(spark, ("panel.ts",))).select("type", "name", "line")


@query(X.values([(1, "x"), (2, "helper"), (3, "Panel"), (5, "helper")], "line_no, symbol"))
def infer_symbol(spark, sf_dir):
    rows = [("p.ts", "const x = 1\nconst y = helper(x)\nclass Panel {\n\n  helper(v)\n")]
    found = symbols.infer(spark.createDataFrame(rows, "path string, content string"))
    return found.where("line_no IN (1, 2, 3, 5)").select("line_no", "symbol")


@query(
    f"""WITH {_DOCS}, parts AS (SELECT path, string_split(content, chr(10)) AS ls FROM docs), l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM parts),
    m AS (SELECT path, line_no, nullif(regexp_extract(line, '^([A-Z][a-z]*) ', 1), '') AS word FROM l)
    SELECT path, CAST(line_no AS INT) AS line_no, last_value(word IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM m"""
)
def carry_forward(spark, sf_dir):
    """The upward search of infer() over all documents: the nearest line above that opens with a capitalised word."""
    lines = T.with_lines(docs(spark, sf_dir).select("path", "content"))
    word = F.nullif(F.regexp_extract("line", "^([A-Z][a-z]*) ", 1), F.lit(""))
    by = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("path", "line_no", F.last(word, ignorenulls=True).over(by).alias("above"))


@query("SELECT p_partkey AS name, count(l_partkey) AS refs FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey HAVING count(l_partkey) < 25")
def dead_symbols(spark, sf_dir):
    defs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.lit("part").alias("kind"))
    refs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"))
    return deadcode.unused(defs, refs, least=25, keys=("name",)).select("name", F.col("references").alias("refs"))


@query(X.values([("Runner", "class", 0), ("run", "function", 0)], "name, kind, refs"))
def dead_code_fixture(spark, sf_dir):
    return deadcode.unused_python(pysyntax.facts(X.code_files(spark, ("mod.py",)))).select("name", "kind", F.col("references").alias("refs"))


@query(X.values([("Panel", "class", 0), ("run", "function", 0)], "name, kind, refs"))
def dead_typescript_fixture(spark, sf_dir):
    return deadcode.unused_typescript(X.code_files(spark, ("panel.ts",))).select("name", "kind", F.col("references").alias("refs"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_first(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return T.first_by(items, ["l_orderkey"], [F.col("l_partkey"), F.col("l_linenumber")])


@query(X.values([("mod.py", "middle", 5), ("mod.py", "", 1)], "path, caller, line"))
def token_calls_fixture(spark, sf_dir):
    files = X.code_files(spark, ("mod.py",))
    found = trace.token_calls(files, pysyntax.scopes(pysyntax.facts(files)))
    where_used = found.where("symbol = 'bottom'").select("path", "caller", "line")
    # the line of the definition belongs to the function itself, so only its caller is left, and the module for def
    return where_used.unionByName(found.where("symbol = 'def' AND line = 1").select("path", F.lit("").alias("caller"), "line"))


@query(X.values([("definition", "panel.ts", 5, "function"), ("reference", "defs.py", 10, "call"), ("reference", "engine.cpp", 6, "reference"), ("reference", "panel.ts", 2, "reference"), ("definition", "defs.py", 6, "function")], "section, path, line, type"))
def impact_languages(spark, sf_dir):
    files = X.code_files(spark, ("defs.py", "engine.cpp", "panel.ts"))
    return trace.impact(trace.definitions_in(files, "helper").select("path", "type", "line"), trace.references_in(files, "helper"))


@query(X.values([("t.ts", 1, 9, "import"), ("t.ts", 2, 6, "definition"), ("t.ts", 2, 14, "reference"), ("t.ts", 3, 0, "reference")], "path, line, col, kind"))
def refactor_typescript(spark, sf_dir):
    text = "import { foo } from './foo';\nconst foo = a(foo, b.foo, $foo, 'foo');\nfoo(); // foo\n"
    files = spark.createDataFrame([("t.ts", text)], "path string, content string").withColumn("lang", F.lit("ts"))
    return rewrite.typescript_spans(files, "foo")


@query(X.values([("## Features\n- add search (a1b2c3d)\n- **auth,api**: drop old tokens (breaking) (c3d4e5f)\n## Bug Fixes\n- **core**: handle nulls (b2c3d4e)\n## Documentation\n- explain: twice (f6a7b8c)\n## Other\n- plain message (e5f6a7b)",)], "report"))
def changelog_text(spark, sf_dir):
    return render.changelog_text(history.parse_commits(X.lines_of(spark, X.COMMITS)))


@query(X.values([("E src/b.js:3:7 Unexpected token\nE src/c.ts:4:9 TS2304: Cannot find name\nE src/d.py:12 Incompatible types\nE src/a.py:10:5 line too long\nC src/e.py:7:1 Invalid name\n? src/f.py:9 something odd",)], "report"))
def lint_text(spark, sf_dir):
    return render.lint_text(lint.parse_lines(X.lines_of(spark, X.LINT).withColumnRenamed("line", "text")), "seq")


@query(X.values([("a.py:1 [TODO] x\na.py:3 [FIXME] (bob) y\na.py:4 [NOTE] next line\na.py:7 [HACK] z",)], "report"))
def markers_text(spark, sf_dir):
    return render.markers_text(markers.markers(spark.createDataFrame([("a.py", X.MARKED)], "path string, content string")))


@query(f"WITH {_CHURN}, top AS (SELECT file, count(*) AS commits FROM log GROUP BY file ORDER BY commits DESC, file LIMIT 5) SELECT string_agg(lpad(commits::VARCHAR, 5, ' ') || ' ' || repeat('█', least(commits, 40)::INT) || ' ' || file, chr(10) ORDER BY commits DESC, file) AS report FROM top")
def churn_text(spark, sf_dir):
    return render.churn_text(history.churn(_log(spark, sf_dir), top=5, tie="file"))


@query(X.values([("definition (1)\n  mod.py:7 function\nreference (3)\n  mod.py:14 call\n  test_mod.py:1 import\n  … 1 more\ntest (2)\n  test_mod.py:1 import\n  test_mod.py:4 call",)], "report"))
def impact_text(spark, sf_dir):
    return render.impact_text(trace.numbered(impact_fixture(spark, sf_dir), 2))


@query(X.values([("LIMIT: defs.py:12\nMAX_ITEMS: engine.cpp:2",)], "report"))
def index_text(spark, sf_dir):
    return render.index_text(trace.tags_in(X.code_files(spark, ("defs.py", "engine.cpp"))).where("name IN ('LIMIT', 'MAX_ITEMS')"))


@query(X.values([(2, "py", 7)], "files, lang, defs"))
def sql_surface(spark, sf_dir):
    """The same facts through SQL: views over a file set and the table function for syntax trees."""
    surface.register(X.code_files(spark, ("mod.py", "test_mod.py")), "fx_")
    return spark.sql(
        "SELECT count(DISTINCT f.path) AS files, f.lang, count_if(p.fact = 'def') AS defs FROM fx_files f, LATERAL py_facts(f.content) p GROUP BY f.lang"
    )


# --- verification


@query(f"WITH {_DOCS} SELECT path, len(string_split(content, chr(10))) - CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines, length(content) AS bytes, substr(sha256(content), 1, 12) AS checksum FROM docs")
def verify_summary(spark, sf_dir):
    return verify.summary(docs(spark, sf_dir))


_COUNT = "(length(lower(content)) - length(replace(lower(content), '{0}', ''))) // length('{0}')"
_FIRST = "CASE WHEN position('{0}' IN lower(content)) > 0 THEN len(string_split(substr(lower(content), 1, position('{0}' IN lower(content))), chr(10))) END"


@query(f"WITH {_DOCS} SELECT path, {_COUNT.format('the ')} > 0 AS ok, {_FIRST.format('the ')} AS line, {_COUNT.format('the ')} AS count FROM docs")
def verify_contains(spark, sf_dir):
    return verify.contains(docs(spark, sf_dir), "The ")


@query(f"WITH {_DOCS} SELECT path, {_COUNT.format('license')} = 0 AS ok, {_FIRST.format('license')} AS line, {_COUNT.format('license')} AS count FROM docs")
def verify_not_contains(spark, sf_dir):
    return verify.contains(docs(spark, sf_dir), "license", should=False)


@query(f"WITH {_DOCS} SELECT path, coalesce(contains(string_split(content, chr(10))[2], 'the'), false) AS ok, substr(string_split(content, chr(10))[2], 1, 200) AS actual FROM docs")
def verify_line(spark, sf_dir):
    return verify.line_check(docs(spark, sf_dir), 2, "the")


@query(f"WITH {_DOCS} SELECT path, {_COUNT.format('worthless')} = 0 AND {_COUNT.format('the ')} > 0 AS ok, {_COUNT.format('worthless')} AS old_count, {_COUNT.format('the ')} AS new_count, {_FIRST.format('worthless')} AS old_line, {_FIRST.format('the ')} AS new_line FROM docs")
def verify_replace(spark, sf_dir):
    return verify.replaced(docs(spark, sf_dir), "worthless", "the ")


@query(f"WITH {_LINES} SELECT path, CAST(line_no AS INT) AS line_no, line, line_no = 3 AS is_target FROM lines WHERE line_no BETWEEN 2 AND 6")
def verify_context(spark, sf_dir):
    return verify.context(docs(spark, sf_dir), 3, 2)


# --- rewriting and hash-anchored edits


_HASH = """hx AS (SELECT path, line_no, line, sha256(rtrim(replace(line, chr(13), ''), chr(10))) AS h FROM lines),
k AS (SELECT path, line_no, line, CAST(CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) % 676 AS INT) AS n FROM hx),
hashed AS (SELECT path, line_no, line, chr(97 + n // 26) || chr(97 + n % 26) AS hash FROM k)"""


@query(f"WITH {_LINES}, {_HASH} SELECT path, CAST(line_no AS INT) AS line_no, hash, line_no || hash || '|' || line AS shown FROM hashed")
def line_hashes(spark, sf_dir):
    return rewrite.hashed_lines(docs(spark, sf_dir))


@query(f"WITH {_LINES}, {_HASH} SELECT path, CAST(line_no AS INT) AS anchor_line, 'zz' AS expected, hash AS actual FROM hashed WHERE line_no = 2 AND hash != 'zz'")
def anchor_mismatch(spark, sf_dir):
    files = docs(spark, sf_dir)
    edits = T.with_lines(files.select("path", "content")).where("line_no = 2").select("path", F.lit("delete").alias("kind"), F.lit("at").alias("cursor"), F.col("line_no").alias("anchor_line"), F.lit("zz").alias("anchor_hash"))
    return rewrite.mismatches(files, edits)


@query(
    f"""WITH {_LINES}, {_HASH} SELECT path, CAST(line_no AS INT) AS line_no, CASE WHEN line_no = 3 THEN '*' ELSE ' ' END AS mark, line_no || hash || '|' || line AS shown, false AS gap
    FROM hashed WHERE line_no BETWEEN 1 AND 5 AND path IN (SELECT path FROM lines WHERE line_no = 3)"""
)
def anchor_report(spark, sf_dir):
    files = docs(spark, sf_dir)
    wrong = T.with_lines(files.select("path", "content")).where("line_no = 3").select("path", F.col("line_no").alias("anchor_line"))
    return rewrite.mismatch_report(files, wrong)


@query(
    f"""WITH {_LINES}, e AS (SELECT path, line_no, CASE WHEN line_no = 2 THEN 'one' || chr(10) || 'two' WHEN line_no = 3 THEN 'pre' || chr(10) || line ELSE line END AS t FROM lines)
    SELECT path, 'top' || chr(10) || string_agg(t, chr(10) ORDER BY line_no) || chr(10) || 'bottom' AS content FROM e GROUP BY path"""
)
def hashline_apply(spark, sf_dir):
    """In every document: line 2 replaced by two lines, a line before line 3, one before the first and one at the end.

    Text before line 1 leaves the only line of an empty document in place; text at BOF takes it (hashline_edges).
    """
    files = docs(spark, sf_dir)
    rows = F.array(
        *(
            F.struct(F.lit(k).alias("kind"), F.lit(c).alias("cursor"), F.lit(a).cast("int").alias("anchor_line"), F.lit(t).cast("string").alias("text"), F.lit(i).alias("idx"))
            for i, (k, c, a, t) in enumerate([("insert", "before", 2, "one"), ("insert", "before", 2, "two"), ("delete", "at", 2, None), ("insert", "before", 3, "pre"), ("insert", "before", 1, "top"), ("insert", "eof", None, "bottom")])
        )
    )
    return rewrite.apply_edits(files, files.select("path", F.explode(rows).alias("e")).select("path", "e.*"))


@query(X.values([("empty", "top\nbottom"), ("full", "top\none\ntwo\nbottom"), ("newline", "top\n\n\nbottom")], "path, content"))
def hashline_edges(spark, sf_dir):
    """Text at BOF and EOF: the only line of an empty file goes; a file without content is no file."""
    files = spark.createDataFrame([("empty", ""), ("full", "one\ntwo"), ("newline", "\n"), ("none", None)], "path string, content string")
    edits = [(p, "insert", c, None, t, i) for p in ("empty", "full", "newline", "none") for i, (c, t) in enumerate([("bof", "top"), ("eof", "bottom")])]
    return rewrite.apply_edits(files, spark.createDataFrame(edits, "path string, kind string, cursor string, anchor_line int, text string, idx int"))


@query(X.values([("a.txt", "new\nbeta\nGAMMA\ndelta\nend")], "path, content"))
def hashline_sections(spark, sf_dir):
    """Two sections: the second edits what the first has left."""
    files = spark.createDataFrame([("a.txt", "alpha\nbeta\ngamma\ndelta")], "path string, content string")
    hashes = {r["line_no"]: r["hash"] for r in rewrite.hashed_lines(files).collect()}
    text = f"@@ a.txt\n= 1{hashes[1]}..1{hashes[1]}\n~new\n@@ a.txt\n= 3{hashes[3]}..3{hashes[3]}\n~GAMMA\n+ EOF\n~end\n"
    return rewrite.apply_sections(files, "a.txt", text)


@query(f"WITH {_DOCS} SELECT path, regexp_replace(content, '\\bworthless\\b', 'precious$1', 'g') AS content FROM docs WHERE regexp_matches(content, '\\bworthless\\b')".replace("\\\\", "\\"))
def rename_word(spark, sf_dir):
    return rewrite.renamed(docs(spark, sf_dir), "worthless", "precious$1").where("changed").select("path", "content")


@query(f"WITH {_LINES} SELECT path, count(*) AS occurrences FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])and([^\\p{{L}}\\p{{N}}_]|$)') GROUP BY path".replace("\\\\", "\\"))
def rename_counts(spark, sf_dir):
    return rewrite.rename_counts(docs(spark, sf_dir), "and")


@query(
    f"""WITH {_LINES}, r AS (SELECT path, line_no, line, regexp_replace(line, '\\bblend\\b', 'X', 'g') AS new, len(regexp_extract_all(line, '\\bblend\\b')) AS n FROM lines WHERE path IN (SELECT path FROM lines WHERE regexp_matches(line, '\\bblend\\b')))
    SELECT path, string_agg(new, chr(10) ORDER BY line_no) AS content, sum(n) AS spans FROM r GROUP BY path""".replace("\\\\", "\\")
)
def refactor_spans(spark, sf_dir):
    files = docs(spark, sf_dir)
    return rewrite.apply_spans(files, rewrite.word_spans(files, "blend"), 5, "X")


@query(f"WITH {_DOCS} SELECT path, CASE WHEN position(' the ' IN content) > 0 THEN 'replaced' ELSE 'not found' END AS status, CASE WHEN position(' the ' IN content) > 0 THEN substr(content, 1, position(' the ' IN content) - 1) || ' THE ' || substr(content, position(' the ' IN content) + 5) ELSE content END AS content FROM docs")
def replace_first(spark, sf_dir):
    return rewrite.replaced_first(docs(spark, sf_dir), " the ", " THE ")


@query(f"WITH {_DOCS}, s AS (SELECT position(' the ' IN content) > 0 AS ok FROM docs) SELECT count(*) AS calls, count(*) FILTER (ok) AS direct, 0 AS salvaged, count(*) FILTER (NOT ok) AS failed, CAST(floor(100.0 * count(*) FILTER (ok) / count(*) + 0.5) AS BIGINT) AS rate FROM s")
def edit_statistics(spark, sf_dir):
    return rewrite.edit_stats(rewrite.edited_or_salvaged(docs(spark, sf_dir), " the ", " THE "))


@query(X.values([("m.py", "def hello(x):\n    return x\n\nprint(hello(1), 'greet')\n", 2)], "path, content, spans"))
def refactor_python(spark, sf_dir):
    rows = [("m.py", "def greet(x):\n    return x\n\nprint(greet(1), 'greet')\n")]
    files = spark.createDataFrame(rows, "path string, content string").withColumn("lang", F.lit("py"))
    return rewrite.apply_spans(files, pysyntax.rename_spans(pysyntax.facts(files), "greet"), 5, "hello")


@query(None)
def hashline_diff(spark, sf_dir):
    files = docs(spark, sf_dir).select("path", "content")
    return rewrite.unified_diff(files, rewrite.renamed(files, "worthless", "precious"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows_stream(spark, sf_dir):
    """Hourly counts from a stream over the events table, run until it has read all that is there."""
    events = streams.table_stream(spark, sf_dir, "events.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    counted = streams.drained(streams.windowed_counts(events), f"event_windows_{uuid.uuid4().hex}", mode="complete")
    return counted.select(F.date_format("start", "yyyy-MM-dd HH:00").alias("hour"), "event_type", "n")


# --- metrics and reports


@query(
    """SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'lines', sum(len(string_split(text, chr(10)))) FROM documents
    UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events"""
)
def report_union(spark, sf_dir):
    d = docs(spark, sf_dir)
    parts = [metrics.metric(d, "documents", F.count("*")), metrics.metric(d, "lines", F.sum(metrics.split_line_count()))]
    return metrics.union([*parts, metrics.metric(read(spark, sf_dir, "pages"), "pages", F.count("*")), metrics.metric(read(spark, sf_dir, "events"), "events", F.count("*"))])


@query(
    f"""WITH {_DOCS} SELECT lang, count(*) AS files, sum(len(string_split(content, chr(10))) - CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 1 ELSE 0 END) AS lines,
    0 AS exit_code FROM docs GROUP BY lang"""
)
def health_summary(spark, sf_dir):
    return metrics.by_language(docs(spark, sf_dir)).withColumn("exit_code", metrics.exit_code(F.col("lines") > 0))


@query("SELECT o_orderpriority AS tool, count(*) AS tools, bool_and(o_orderstatus != 'P') AS ok FROM orders GROUP BY 1")
def all_ok(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tool"), F.when(F.col("o_orderstatus") != "P", "ok").otherwise("fail").alias("status"))
    return runs.groupBy("tool").agg(F.count("*").alias("tools"), F.bool_and(F.col("status") == "ok").alias("ok"))


@query(X.values([(3, False, 130.5, "2m 10s")], "tools, ok, elapsed, took"))
def gate_fixture(spark, sf_dir):
    runs = spark.createDataFrame([("ruff", "ok", 0.5), ("mypy", "fail", 10.0), ("pytest", "ok", 120.0)], "tool string, status string, elapsed double")
    return metrics.gate(runs).withColumn("took", metrics.duration(F.col("elapsed")))


@query("""SELECT '{"lang":"' || lang || '","files":' || count(*) || '}' AS document FROM documents GROUP BY lang""")
def json_documents(spark, sf_dir):
    return metrics.as_json(docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files")))


@query("SELECT lang, repeat('█', least(count(*), 40)::INT) AS bar FROM documents GROUP BY lang")
def bars(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")).select("lang", markers.bar().alias("bar"))


@query("SELECT p_name AS value, CASE WHEN length(p_name || p_type || p_brand || p_name || p_type || p_brand) > 80 THEN substr(p_name || p_type || p_brand || p_name || p_type || p_brand, 1, 40) || '...' || right(p_name || p_type || p_brand || p_name || p_type || p_brand, 37) ELSE p_name || p_type || p_brand || p_name || p_type || p_brand END AS short FROM part")
def truncation(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("value"), T.shortened(F.concat("p_name", "p_type", "p_brand", "p_name", "p_type", "p_brand")).alias("short"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
