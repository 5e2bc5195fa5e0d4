"""File sets as DataFrames: path, ext, lang, size, content.

Scans are ``binaryFile`` reads: file size and path filters apply before a byte is read. Every scan has the
same columns; they differ in which folders and extensions they leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, decoded, extension

# Folders that scans leave out, extensions of sources and of languages, binary extensions.
EXCLUDED = (
    ".git", "__pycache__", "node_modules", ".venv", "venv", ".env", "build", "dist", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".eggs", ".idea", ".vscode", "target", ".next", ".nuxt",
)
IMPACT_EXCLUDED = ("__pycache__", "node_modules", "build", "dist", ".git", ".eggs", "env", "venv")
HEALTH_EXCLUDED = (".git", "__pycache__", "node_modules", "build", "dist", ".eggs", "env", "venv", ".ruff_cache", ".mypy_cache")
SOURCE_EXTS = (
    ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".hxx", ".hh",
    ".rs", ".go", ".java", ".kt", ".swift",
)
LANGUAGE_EXTS = {
    "all": SOURCE_EXTS,
    "py": (".py",),
    "python": (".py",),
    "ts": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
    "js": (".js", ".jsx", ".mjs", ".cjs"),
    "cpp": (".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".hxx", ".hh"),
    "c": (".c", ".h"),
}
BINARY_EXTS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".zip", ".gz", ".bz2", ".xz",
    ".tar", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".pyc", ".pyo",
    ".pyd", ".o", ".obj", ".lib", ".dll", ".so", ".dylib", ".exe", ".msi", ".deb", ".rpm", ".lock", ".sum", ".sig",
)
HEALTH_EXTS = LANGUAGE_EXTS["py"] + LANGUAGE_EXTS["cpp"] + LANGUAGE_EXTS["ts"]
#: Scans of whole folders that read sources: extensions, and the folders that each leaves out beside hidden ones.
SCANS = {
    "impact": (SOURCE_EXTS, IMPACT_EXCLUDED),
    "dead": (LANGUAGE_EXTS["py"] + LANGUAGE_EXTS["ts"], EXCLUDED),
    "health": (HEALTH_EXTS, HEALTH_EXCLUDED),
}
#: Languages of the impact scan; js there means all of ts, and an unknown language has no files.
IMPACT_LANGUAGES = {"all": SOURCE_EXTS, "py": LANGUAGE_EXTS["py"], "cpp": LANGUAGE_EXTS["cpp"], "ts": LANGUAGE_EXTS["ts"], "js": LANGUAGE_EXTS["ts"]}
AUDIT_BYTES = 1_000_000
SEARCH_BYTES = 50 * 1024 * 1024


def language(ext: Column | str) -> Column:
    """py, cpp, ts, or other for the rest."""
    ext = F.lower(F.col(ext) if isinstance(ext, str) else ext)
    return F.when(ext.isin(*LANGUAGE_EXTS["py"]), "py").when(ext.isin(*LANGUAGE_EXTS["cpp"]), "cpp").when(ext.isin(*LANGUAGE_EXTS["ts"]), "ts").otherwise("other")


def in_language(lang: str, ext: Column | str = "ext", unknown: str = "all") -> Column:
    """Whether an extension belongs to a language; an unknown language means ``unknown``."""
    ext = F.col(ext) if isinstance(ext, str) else ext
    return ext.isin(*LANGUAGE_EXTS.get(lang, LANGUAGE_EXTS[unknown]))


def pruned(path: Column | str, excluded=EXCLUDED, hidden: bool = True) -> Column:
    """Whether a folder of a relative path is one that scans leave out (hidden folders too, if so asked)."""
    path = F.col(path) if isinstance(path, str) else path
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    bad = lambda x: (x.isin(*excluded) | x.startswith(".")) if hidden else x.isin(*excluded)
    return F.exists(folders, bad)


def read_files(spark: SparkSession, root: str, glob: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path relative to root, size, raw) of all files below root; the size limit filters before reading."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(F.substring(bare, len(root.rstrip("/")) + 2, 1 << 30).alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))


def as_files(raw: DataFrame) -> DataFrame:
    """(path, ext, lang, size, content) from (path, size, raw)."""
    return raw.select("path", extension("path").alias("ext"), "size", decoded("raw").alias("content")).select("path", "ext", language("ext").alias("lang"), "size", "content")


def scan_sources(spark: SparkSession, root: str, lang: str = "all", most_files: int = 0) -> DataFrame:
    """Source files of a language, without excluded and hidden folders; the first ``most_files`` by path, 0: all."""
    raw = read_files(spark, root)
    chosen = raw.where(in_language(lang, extension("path")) & ~pruned("path"))
    if most_files:
        chosen = chosen.orderBy("path").limit(most_files)
    return as_files(chosen)


def in_scan(path: Column | str, scan: str, lang: str = "all") -> Column:
    """Whether a relative path belongs to one of SCANS; only the impact scan knows languages."""
    exts, excluded = SCANS[scan]
    if scan == "impact":
        exts = IMPACT_LANGUAGES.get(lang, ())
    return extension(path).isin(*exts) & ~pruned(path, excluded)


def scan(spark: SparkSession, root: str, which: str, lang: str = "all") -> DataFrame:
    """The files of one of SCANS."""
    return as_files(read_files(spark, root).where(in_scan("path", which, lang)))


def scan_audit(spark: SparkSession, root: str) -> DataFrame:
    """All files of at most 1,000,000 bytes whose extension is not binary."""
    raw = read_files(spark, root, most_bytes=AUDIT_BYTES)
    return as_files(raw.where(~extension("path").isin(*BINARY_EXTS) & ~pruned("path")))


def scan_search(spark: SparkSession, root: str) -> DataFrame:
    """All files up to 50 MiB; folders go whose path contains a version-control or cache name anywhere."""
    raw = read_files(spark, root, most_bytes=SEARCH_BYTES)
    folder = F.regexp_replace("path", "[^/]*$", "")
    return as_files(raw.where(~(folder.contains(".git") | folder.contains("__pycache__") | folder.contains("node_modules"))))


def scan_all(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, size, newlines, lines) of every file, binary ones too, counted in bytes; lines include an unfinished last one."""
    raw = read_files(spark, root).where(~pruned("path"))
    unfinished = F.expr("size > 0 AND substring(raw, -1, 1) != X'0A'").cast("int")
    counted = raw.withColumn("newlines", F.expr("octet_length(raw) - octet_length(replace(cast(raw AS string), '\n', ''))"))
    return counted.select("path", extension("path").alias("ext"), "size", "newlines", (F.col("newlines") + unfinished).alias("lines"))


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files: path source/doc_id.lang, ext, lang, size, content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return docs.select(path.alias("path"), F.concat(F.lit("."), "lang").alias("ext"), "lang", F.octet_length("text").alias("size"), F.col("text").alias("content"))


def documents_sql() -> str:
    return "SELECT source || '/' || doc_id || '.' || lang AS path, '.' || lang AS ext, lang, octet_length(encode(text)) AS size, text AS content FROM documents"


def included(path: Column | str, pattern: str) -> Column:
    """Include filter: every part between stars must be in the file name; without a star the name must end so."""
    name = basename(path)
    if "*" not in pattern:
        return name.endswith(pattern)
    parts = [p for p in pattern.split("*") if p]
    out = F.lit(True)
    for p in parts:
        out = out & name.contains(p)
    return out


def is_test(path: Column | str) -> Column:
    """Whether a path looks like a test."""
    path = F.col(path) if isinstance(path, str) else path
    name = basename(path)
    ends = [name.endswith(x) for x in ("_test.py", "_test.cpp", ".test.ts", ".test.tsx", ".test.js", ".test.jsx")]
    out = name.startswith("test_") | name.contains("_test.") | path.contains("/test_") | name.contains(".spec.")
    for e in ends:
        out = out | e
    return out
