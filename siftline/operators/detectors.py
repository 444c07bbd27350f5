"""Pattern detectors: text to rows, and file-level rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import holders, numbered

# Fixed lists.
SKIPPED_DIRS = ("vendor", "node_modules", "dist", "build", ".git", "tests")
LANGUAGES = {".py": "python", ".java": "java", ".go": "go", ".js": "javascript", ".ts": "typescript", ".md": "markdown"}


def eligible_files(files: DataFrame, extensions: tuple[str, ...], max_size: int, path: str = "path", size: str = "size") -> DataFrame:
    """Files with a wanted extension, small enough, outside skipped folders."""
    parts = F.split(F.lower(path), "/")
    return files.where(F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)).isin(*extensions) & (F.col(size) <= max_size) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRS))))


def path_admitted(path: Column, ignore: list[str], include: list[str]) -> Column:
    """Included by any pattern, or ignored by none."""
    any_of = lambda patterns: F.regexp_like(path, F.lit("|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)
    return any_of(include) | ~any_of(ignore)


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line), one row per line."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def matching_lines(files: DataFrame, rules: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """(key, line_no, rule) of every line that a rule's pattern matches."""
    table = lines(files.where(F.regexp_like(text, F.lit("|".join(f"(?:{p})" for p in rules.values())))), key, text)
    hits = F.array_compact(F.array(*[F.when(F.regexp_like("line", F.lit(p)), F.lit(name)) for name, p in rules.items()]))
    return table.select(key, "line_no", F.explode(hits).alias("rule"))


def loc_share(files: DataFrame, language: str = "language", loc: str = "loc", least: float = 5.0) -> DataFrame:
    """Lines and percentage of each language, those of ``least`` percent or more."""
    sums = files.groupBy(language).agg(F.sum(loc).alias("loc"))
    total = sums.agg(F.sum("loc").alias("total"))
    share = F.round(100 * F.col("loc") / F.col("total"), 2)
    return sums.crossJoin(F.broadcast(total)).select(language, "loc", share.alias("percent")).where(F.col("percent") >= least)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page, n_links, n_scripts, title) found in raw HTML."""
    return pages.select(
        key, F.regexp_count(html, F.lit("<a ")).cast("bigint").alias("n_links"), F.regexp_count(html, F.lit("<script")).cast("bigint").alias("n_scripts"), F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title")
    )


def text_joins(texts: DataFrame, patterns: DataFrame, key: str, text: str = "text", pattern: str = "needle") -> DataFrame:
    """(key, columns of the pattern) for each text and each pattern that stands in it, from a library of any size.

    Texts are read once for each slice of the library and never shuffled; hits meet their patterns by number.
    """
    library = numbered(patterns, pattern)
    named = patterns.join(library, pattern).select("phrase_id", *patterns.columns)
    return holders(texts, library, key, text, pattern).join(named, "phrase_id").select(key, *patterns.columns)


def project_structure(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(language, files, loc) of a project; the language is the extension."""
    rows = files.select(F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)).alias("language"), F.size(F.split(text, "\n")).alias("loc"))
    return rows.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").cast("bigint").alias("loc"))


def static_defence(files: DataFrame, patterns: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """(key, found): names of the defences whose pattern stands in a text, in their order."""
    hits = F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(name)) for name, p in patterns.items()])
    return files.select(key, F.array_compact(hits).alias("found"))
