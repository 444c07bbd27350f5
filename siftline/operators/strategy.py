"""Audit priorities, task types, severity adjustment, convergence and termination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import lookup

# Fixed values that scores depend on.
PRIORITY_WEIGHTS = {"attack_surface": 0.35, "tech_risk": 0.25, "complexity": 0.20, "history_risk": 0.20}
ENTRY_RISK = {"http": 0.8, "rpc": 0.7, "grpc": 0.7, "mq": 0.6, "websocket": 0.75, "cli": 0.5, "cron": 0.4, "file": 0.6}
METHOD_RISK = {"POST": 0.9, "PUT": 0.85, "PATCH": 0.8, "DELETE": 0.85, "GET": 0.6, "HEAD": 0.3, "OPTIONS": 0.2}
FRAMEWORK_RISK = {"struts": 0.9, "django": 0.6, "flask": 0.55, "spring": 0.65, "express": 0.55, "fastapi": 0.5, "gin": 0.5, "echo": 0.5, "rails": 0.65, "laravel": 0.6, "aspnet": 0.55, "ktor": 0.45, "fiber": 0.45}
RISKY_PATHS = ("auth", "login", "password", "credential", "token", "session", "payment", "checkout", "transfer", "admin", "config", "secret", "api", "upload", "download", "import", "export", "query")
SKIPPED_PATHS = ("test", "spec", "mock", "fixture", "example", "sample", "docs", "readme", "changelog", "license", "__pycache__", "node_modules", "vendor")
FILE_TASKS = (
    ("auth_check", ("auth", "login", "password", "token")),
    ("crypto_audit", ("crypto", "encrypt", "cipher", "key")),
    ("config_review", ("config", "settings", "env")),
    ("api_security", ("api", "route", "controller", "handler")),
)
STOP_CONFIDENCE, STOP_GAP, STABLE_ROUNDS, TOKEN_LIMIT = 0.85, 0.35, 2, 50_000


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of the words."""
    return F.regexp_like(F.lower(text), F.lit("|".join(words)))


def _clamped(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def attack_surface_score() -> Column:
    """From columns entry_point_type, http_method, auth_required, n_params and file_path."""
    entry = F.when(F.col("entry_point_type").isNotNull(), lookup(F.lower("entry_point_type"), ENTRY_RISK, 0.5) * 0.4).otherwise(0.0)
    method = F.when(F.col("http_method").isNotNull(), lookup(F.upper("http_method"), METHOD_RISK, 0.5) * 0.3).otherwise(0.0)
    auth = F.when(F.coalesce("auth_required", F.lit(False)), -0.05).otherwise(0.15)
    params = F.when(F.col("n_params") > 5, 0.1).when(F.col("n_params") > 0, F.col("n_params") / 5 * 0.05).otherwise(0.0)
    return _clamped(entry + method + auth + params + F.when(has_any(F.col("file_path"), RISKY_PATHS), 0.05).otherwise(0.0))


def tech_risk_score() -> Column:
    """From columns framework and language."""
    base = F.when(F.col("framework").isNotNull(), (lookup(F.lower("framework"), FRAMEWORK_RISK, 0.5) + 0.4) / 2).otherwise(0.4)
    language = F.lower("language")
    return _clamped(base + F.when(language.isin("php", "perl"), 0.15).when(language.isin("rust", "go"), -0.05).otherwise(0.0))


def priority(complexity: Column, history: Column) -> Column:
    """Weighted audit priority; test and generated code is skipped by :func:`skipped`."""
    parts = {"attack_surface": attack_surface_score(), "tech_risk": tech_risk_score(), "complexity": complexity, "history_risk": history}
    return F.round(sum(v * PRIORITY_WEIGHTS[k] for k, v in parts.items()), 6)


def skipped(path: Column) -> Column:
    return has_any(path, SKIPPED_PATHS)


def file_task(path: Column) -> Column:
    """Task type of a file target: authentication, crypto, configuration, API, else a plain scan."""
    out = F.lit("file_scan")
    for name, words in reversed(FILE_TASKS):
        out = F.when(has_any(path, words), name).otherwise(out)
    return out


def vulnerability_type(default: str = "xss") -> Column:
    """From rule id, then CWE: ordered tests, first hit wins."""
    r, c = F.lower(F.coalesce("rule_id", F.lit(""))), F.coalesce("cwe", F.lit(""))
    has = lambda x, w: F.contains(x, F.lit(w))
    return (
        F.when(has(r, "xss") | has(r, "cross-site"), "xss")
        .when(has(r, "sqli") | (has(r, "injection") & has(r, "sql")), "sqli")
        .when(has(r, "rce") | (has(r, "command") & has(r, "injection")), "cmdi")
        .when(has(r, "path") | has(r, "traversal"), "path_traversal")
        .when(has(c, "79"), "xss")
        .when(has(c, "89"), "sqli")
        .when(has(c, "78"), "cmdi")
        .when(has(c, "22"), "path_traversal")
        .otherwise(default)
    )


def adjusted_severity() -> Column:
    """Severity after exploitability: info if impossible, one level down if unlikely; null where nothing changes."""
    down = F.element_at(F.create_map(*[F.lit(x) for p in (("critical", "high"), ("high", "medium"), ("medium", "low"), ("low", "info"), ("info", "info")) for x in p]), F.col("severity"))
    new = F.when(F.col("exploitability") == "not_exploitable", "info").when(F.col("exploitability") == "unlikely", down).otherwise(F.col("severity"))
    return F.when(new != F.col("severity"), new)


def convergence(least_rounds: int = 2, most_rounds: int = 5) -> Column:
    """Why a debate ends, in order of precedence; null if it goes on.

    From columns n, confidence, decisive, gap, stable_rounds, stalled and tokens_used.
    """
    return (
        F.when(F.col("n") < least_rounds, F.lit(None).cast("string"))
        .when(F.col("n") >= most_rounds, "max_rounds")
        .when(F.col("confidence") >= STOP_CONFIDENCE, "high_confidence")
        .when(F.col("decisive"), "decisive_verdict")
        .when(F.col("gap") >= STOP_GAP, "strength_gap")
        .when(F.col("stable_rounds") >= STABLE_ROUNDS, "strategy_stable")
        .when(F.col("stalled"), "no_progress")
        .when(F.col("tokens_used") >= TOKEN_LIMIT, "cost_limit")
    )


def heuristic_verdict(attack: Column, defence: Column) -> Column:
    """Verdict from the strengths of both sides."""
    gap = attack - defence
    return F.when(gap >= 0.4, "confirmed").when(gap <= -0.4, "false_positive").when(gap >= 0.2, "likely").otherwise("needs_review")


def fitness(used: Column, wins: Column, confidence: Column, bonus: Column) -> Column:
    """0.6 of the win rate, 0.2 of the confidence, 0.2 of simplicity or depth; 0.5 if never used."""
    return F.round(F.when(used > 0, 0.6 * (wins / used) + 0.2 * confidence + 0.2 * bonus).otherwise(0.5), 6)


def sanitizer_effect(df: DataFrame, relevant: DataFrame, key: str = "id") -> DataFrame:
    """Best effect among sanitizers whose category counts for the vulnerability type."""
    good = df.join(F.broadcast(relevant), ["vuln_type", "category"], "left_semi")
    best = good.groupBy(key).agg(F.bool_or(F.col("effect") == "full").alias("full"), F.bool_or(F.col("effect") == "partial").alias("partial"))
    return df.select(key).distinct().join(best, key, "left").select(key, F.when(F.col("full"), "full").when(F.col("partial"), "partial").otherwise("ineffective").alias("effect"))


def rule_packs(wanted: Column, packs: Column, protected: Column) -> Column:
    """Packs to leave out: all but the wanted and the protected ones."""
    return F.array_sort(F.array_except(F.array_except(packs, wanted), protected))


def project_type(flags: DataFrame) -> DataFrame:
    """One row: web, api, cli, library or unknown, from existence over all files."""
    has = flags.agg(*[F.bool_or(c).alias(c) for c in ("html", "routes", "main", "package")])
    return has.select(F.when(F.col("html") & F.col("routes"), "web").when(F.col("routes"), "api").when(F.col("main"), "cli").when(F.col("package"), "library").otherwise("unknown").alias("project_type"))
