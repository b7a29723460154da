"""Rules on files and lines: forbidden paths, quotas of prose, line lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

MOST_WORDS, MOST_SECONDS = 500, 20.5
# Paths that must not be shipped.
PATHS = [
    (r"^Reading/", "raw audiobook source"),
    (r"^samples/", "alignment sample (real audio/text)"),
    (r"(?i)\.(wav|m4a|m4b|flac)$", "uncompressed / full audio"),
    (r"(^|/)book12\.txt$", "fetched author prose"),
    (r"\.chapters\.json$", "fetched chapter prose/markers"),
]
# Patterns of lines in pages and scripts, and in Python files, and the pragma that lets a line pass.
PAGE_LINES = [(r"\.(inner|outer)HTML\s*\+?=(?!=)", "assigns an HTML string to .innerHTML/.outerHTML (use el()/clear())"), (r"\.insertAdjacentHTML\s*\(", "insertAdjacentHTML() builds DOM from a string (use el()/clear())"), (r"\bdocument\.write\s*\(", "document write sink injects an HTML string")]
PYTHON_LINES = [(r"\.eval\s*\(", "parenthesised eval-mode call — use model.train(False) for inference mode")]
PAGE_FILES, PYTHON_FILES = (".html", ".htm", ".js"), (".py",)
PRAGMA = r"(#|//)\s*safe-pattern-ok"


def forbidden_paths(files: DataFrame, rules=PATHS) -> DataFrame:
    """(path, why) of every rule that a path breaks. Rules are a handful of literals inside the plan."""
    hits = F.array(*[F.when(F.col("path").rlike(p), F.lit(why)) for p, why in rules])
    return files.select("path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("why"))


def lint_lines(files: DataFrame, key: str, text: str, rules=PAGE_LINES, pragma: str = PRAGMA) -> DataFrame:
    """(key, line_no, why, line) of every rule that a line breaks; lines are numbered from 1."""
    own = files.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "_line")).where(~F.col("_line").rlike(pragma))
    hits = F.array(*[F.when(F.col("_line").rlike(p), F.lit(why)) for p, why in rules])
    return own.select(key, (F.col("_n") + 1).cast("long").alias("line_no"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("why"), F.trim("_line").alias("line"))


def prose_quota(files: DataFrame, key: str, text: str = "text", seconds: str | None = None) -> DataFrame:
    """Words of prose per file and whether they, or its seconds, are too many. A list of links (half of its lines or
    more are URLs) is no prose; unmeasured seconds are a violation."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.trimmed), lambda x: x != "")
    links = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("http"))))
    is_prose = (F.size(lines) == 0) | (links / F.size(lines) < 0.5)
    own = files.select(key, F.when(is_prose, T.prose_words(F.col(text))).otherwise(F.lit(0).cast("long")).alias("n_words"), *([seconds] if seconds else []))
    broken = F.col("n_words") > MOST_WORDS
    if seconds:
        broken = broken | F.col(seconds).isNull() | (F.col(seconds) > MOST_SECONDS)
    return own.withColumn("violation", broken)


def lint_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``lint_lines`` of files by their extension: pages and scripts by one set of rules, Python files by another."""
    ends = lambda kinds: F.col(path).rlike("(" + "|".join(k.replace(".", r"\.") for k in kinds) + ")$")
    return lint_lines(files.where(ends(PAGE_FILES)), path, text).unionByName(lint_lines(files.where(ends(PYTHON_FILES)), path, text, PYTHON_LINES))


def player_prose(tables: dict[str, DataFrame], key: str = "doc_key") -> DataFrame:
    """Words of prose of each player document: those of its segments' texts and its chapters' titles."""
    words = tables["segments"].select(key, T.prose_words(F.col("text")).alias("_n")).unionByName(tables["chapters"].select(key, T.prose_words(F.col("title")).alias("_n")))
    n = words.groupBy(key).agg(F.sum("_n").alias("n_words"))
    return tables["docs"].select(key).join(n, key, "left").select(key, F.coalesce("n_words", F.lit(0)).alias("n_words"))
