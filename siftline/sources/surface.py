"""Entry points and configuration risks of source files, by patterns over whole texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import route_path, running_total
from ..operators.graph import _cut
from . import rule_yaml

_Q = "[\"'`]"
_NAME = "[^\"'`]+"


@dataclass(frozen=True)
class Detector:
    """Kind, framework, file endings, and a pattern with the groups of method, route and handler (0: none)."""

    kind: str
    framework: str
    files: str
    pattern: str
    method: int = 0
    route: int = 0
    handler: int = 0


# Fixed: what each framework's declarations look like.
DETECTORS = (
    Detector("http", "gin", r"\.go$", rf"\b\w+\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\(\s*{_Q}({_NAME}){_Q}\s*,\s*(\w+)", 1, 2, 3),
    Detector("http", "net/http", r"\.go$", rf"\bHandleFunc\s*\(\s*{_Q}({_NAME}){_Q}\s*,\s*(\w+)", 0, 1, 2),
    Detector("http", "spring", r"\.java$", rf"@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?{_Q}({_NAME}){_Q}[^)]*\)[^;{{(]*?\s(\w+)\s*\(", 1, 2, 3),
    Detector("http", "flask", r"\.py$", rf"@\w+\.(route)\s*\(\s*{_Q}({_NAME}){_Q}[^\n]*\)\s*\n(?:@[^\n]*+\n)*+\s*(?:async\s+)?def\s+(\w+)", 1, 2, 3),
    Detector("http", "fastapi", r"\.py$", rf"@\w+\.(get|post|put|delete|patch)\s*\(\s*{_Q}({_NAME}){_Q}[^\n]*\)\s*\n(?:@[^\n]*+\n)*+\s*(?:async\s+)?def\s+(\w+)", 1, 2, 3),
    Detector("rpc", "dubbo", r"\.java$", r"@(?:DubboService|Service)\s*\([^)]*\)[^{;]*?\b(?:class|interface)\s+(\w+)", 0, 1, 1),
    Detector("rpc", "grpc", r"\.proto$", r"\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?(\w+)\s*\)\s*returns", 0, 1, 2),
    Detector("rpc", "thrift", r"\.thrift$", r"(?m)^\s+[\w<>,]+\s+(\w+)\s*\([^)]*\)", 0, 1, 1),
    Detector("mq", "kafka", r"\.java$", rf"@KafkaListener\s*\([^)]*?topics\s*=\s*{_Q}({_NAME}){_Q}[^)]*\)[^{{;(]*?\s(\w+)\s*\(", 0, 1, 2),
    Detector("mq", "kafka", r"\.py$", rf"\.subscribe\s*\(\s*\[\s*{_Q}({_NAME}){_Q}", 0, 1),
    Detector("mq", "rabbitmq", r"\.java$", rf"@RabbitListener\s*\([^)]*?queues\s*=\s*{_Q}({_NAME}){_Q}[^)]*\)[^{{;(]*?\s(\w+)\s*\(", 0, 1, 2),
    Detector("mq", "rabbitmq", r"\.py$", rf"basic_consume\s*\([^)]*?queue\s*=\s*{_Q}({_NAME}){_Q}", 0, 1),
    Detector("mq", "redis", r"\.py$", rf"pubsub\.subscribe\s*\(\s*{_Q}({_NAME}){_Q}", 0, 1),
    Detector("cron", "spring", r"\.java$", rf"@Scheduled\s*\(\s*(?:cron\s*=\s*{_Q}|fixedRate\s*=\s*)([^\"')]+)[^)]*\)[^{{;(]*?\s(\w+)\s*\(", 0, 1, 2),
    Detector("cron", "celery", r"\.py$", r"@(?:app|celery)\.task\b[^\n]*\n\s*def\s+(\w+)", 0, 1, 1),
    Detector("cron", "cron", r"\.go$", rf"AddFunc\s*\(\s*{_Q}({_NAME}){_Q}\s*,\s*(\w+)", 0, 1, 2),
)
# Fixed rules of container files: id, risk, pattern.
CONTAINER_RULES = (
    ("DF001", "high", r"(?im)^\s*USER\s+root\s*$"),
    ("DF002", "medium", r"(?im)^\s*ADD\s+https?://"),
    ("DF003", "low", r"(?im)^\s*(?:RUN\s+)?apt-get\s+update\s*(?:&&\s*apt-get\s+install)?(?![\s\S]*?rm\s+-rf\s+/var/lib/apt/lists)"),
    ("DF004", "medium", r"(?im)^\s*EXPOSE\s+(?:22|23|21)\b"),
    ("DF005", "high", r"(?im)^\s*ENV\s+.*(?:PASSWORD|SECRET|TOKEN|KEY|CREDENTIAL)\s*="),
    ("DF006", "high", r"(?im)^\s*ARG\s+.*(?:PASSWORD|SECRET|TOKEN|KEY)\s*=\s*['\"][^'\"]+['\"]"),
    ("DF007", "high", r"(?im)^\s*RUN\s+.*(?:curl|wget)\s+.*\|\s*(?:sh|bash|zsh)"),
    ("DF008", "low", r"(?im)^\s*(?:FROM|RUN)\s+.*:latest\b"),
    ("DF009", "info", r"(?im)^\s*COPY\s+.*\.\s+.*\.\s*$"),
    ("DF010", "medium", r"(?im)^\s*RUN\s+.*chmod\s+(?:-R\s+)?(?:777|a\+rwx)"),
    ("DF011", "info", r"(?im)^\s*RUN\s+.*(?:apt|yum|apk|dnf)\s+(?:install|update|upgrade)\s*(?!.*--no-cache|.*--no-install-recommends)"),
    ("DF012", "info", r"(?im)^\s*HEALTHCHECK\s+NONE"),
)
#: Values of an event that whoever triggers a workflow writes freely, as the platform's hardening guide lists them.
FREE_VALUES = (
    *(f"github.event.{part}" for part in ("issue.title", "issue.body", "pull_request.title", "pull_request.body", "comment.body", "review.body", "review_comment.body")),
    *(f"github.event.{part}" for part in ("discussion.title", "discussion.body", "head_commit.message", "head_commit.author.name", "head_commit.author.email")),
    *(f"github.event.pull_request.head.{part}" for part in ("ref", "label", "repo.default_branch")),
    "github.head_ref",
)
#: Ends of the names of settings whose literal value is a credential.
CREDENTIAL_NAMES = ("passphrase", "password", "passwd", "private_key", "secret", "token", "api_key", "apikey")
# Rules of workflow files: a step that expands a free value, a literal credential, a checkout of foreign code with the target's rights, an action that moves.
WORKFLOW_RULES = (
    ("plain_secret", "high", rf"(?im)^[ \t-]*+[\w.-]*?(?:{'|'.join(CREDENTIAL_NAMES)})[ \t]*:[ \t]*([\"'])(?!\$)[^\"'\n]{{8,}}\1"),
    ("untrusted_input", "high", r"\$\{\{[^}\n]*?\b(?:" + "|".join(v.replace(".", r"\.") for v in FREE_VALUES) + r")\b"),
    ("target_checkout", "high", r"(?s)pull_request_target.*actions/checkout"),
    ("unpinned_action", "low", r"uses:\s*[^@\s]+@(?:main|master|latest)\b"),
)
# Rules of build files, by the names of this package: file ending, rule, risk, pattern.
_MAVEN, _GRADLE, _PIP = r"(^|/)pom\.xml$", r"\.gradle(\.kts)?$", r"(^|/)(requirements[^/]*\.txt|setup\.py|pyproject\.toml)$"
BUILD_RULES = (
    (_MAVEN, "plain_repository", "medium", r"<url>\s*http://"),
    (_MAVEN, "snapshot_version", "low", r"<version>[^<]*-SNAPSHOT</version>"),
    (_MAVEN, "stored_password", "high", r"(?i)<[\w.-]*(?:password|passphrase|secret)[\w.-]*>[^<$]+</"),
    (_GRADLE, "plain_repository", "medium", r"url\s*[(=]?\s*['\"]http://"),
    (_GRADLE, "stored_password", "high", r"(?i)\b(?:storePassword|keyPassword|password)\s*[(=]?\s*['\"][^'\"$]+['\"]"),
    (_GRADLE, "debuggable_release", "medium", r"(?s)\brelease\s*\{[^}]*\bdebuggable\s*=?\s*true"),
    (_GRADLE, "moving_version", "low", r"['\"][\w.-]+:[\w.-]+:[\w.]*\+['\"]"),
    (_PIP, "plain_repository", "medium", r"(?m)^\s*(?:-i|--index-url|--extra-index-url)[ =]http://"),
    (_PIP, "unpinned_requirement", "low", r"(?m)^[A-Za-z][\w.-]*(?:\[[^\]]*\])?[ \t]*$"),
    (_PIP, "stored_password", "high", r"(?i)://[^/\s:@]+:[^/\s:@$]+@"),
)
CONTAINER_FILES = r"(^|/)[^/]*[Dd]ockerfile[^/]*$"
WORKFLOW_FILES = r"(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)\.gitlab-ci\.yml$"


def located(content: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """Array of (line, g1, g2, …): the line where each match begins and its groups.

    Lines are counted once along the text between and in the matches.
    """
    newlines = lambda x: F.coalesce(F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))), F.lit(0))
    wanted = list(dict.fromkeys(groups))
    hits = [F.regexp_extract_all(content, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in dict.fromkeys((0, *groups))]
    parts = F.arrays_zip(F.split(content, pattern, -1).alias("gap"), *hits)
    before = running_total(F.transform(parts, lambda x: newlines(x["gap"]) + newlines(x["g0"])))
    rows = F.zip_with(parts, before, lambda x, n: F.when(x["g0"].isNotNull(), F.struct((n + newlines(x["gap"]) + 1).cast("int").alias("line"), *[x[f"g{g}"].alias(f"g{g}") for g in wanted])))
    return F.array_compact(rows)


def _entry(d: Detector, prefix: Column) -> Callable[[Column], Column]:
    """Row of one match of a detector."""

    def row(x: Column) -> Column:
        part = lambda g: x[f"g{g}"] if g else F.lit(None).cast("string")
        method = F.upper(part(d.method)) if d.method else F.lit("ANY" if d.kind == "http" else None).cast("string")
        route = F.concat(prefix, part(d.route)) if d.framework == "spring" and d.kind == "http" else part(d.route)
        return F.struct(
            x["line"].alias("line"), F.lit(d.kind).alias("kind"), F.lit(d.framework).alias("framework"), method.alias("method"), (route_path(route) if d.kind == "http" else route).alias("route"), part(d.handler).alias("handler")
        )

    return row


def _risk(rule: str, risk: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["line"].alias("line"), F.lit(rule).alias("rule"), F.lit(risk).alias("risk"))


def entry_points(files: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """(path, line, kind, framework, method, route, handler) of every declaration; ``files`` has path and content.

    Spring routes stand below their class's mapping. A file is matched against
    the detectors of its ending only.
    """
    prefix = F.regexp_extract("content", rf"@RequestMapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?{_Q}({_NAME}){_Q}[^)]*\)[^;{{(]*\bclass\b", 1)
    found = []
    for d in detectors:
        wanted = F.regexp_like("path", F.lit(d.files)) & F.regexp_like("content", F.lit(d.pattern))
        rows = F.transform(located(F.col("content"), d.pattern, tuple(g for g in (d.method, d.route, d.handler) if g)), _entry(d, prefix))
        found.append(F.when(wanted, rows).otherwise(F.array().cast("array<struct<line:int,kind:string,framework:string,method:string,route:string,handler:string>>")))
    out = files.select("path", F.explode(F.concat(*found)).alias("e")).select("path", "e.*")
    return out.withColumn("method", F.when(F.col("method") == "ROUTE", "ANY").otherwise(F.col("method")))


def cascade(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Entry points by the best means for each file: ``parsed`` ones of a syntax tree, else those of patterns, else the file itself if its name is an entry's."""
    first = _cut(parsed.select("path", "line", "kind", "framework", "method", "route", "handler").withColumn("tier", F.lit("syntax")))
    rest = files.join(first.select("path").distinct(), "path", "left_anti")
    second = entry_points(rest).withColumn("tier", F.lit("pattern"))
    rest = rest.join(second.select("path").distinct(), "path", "left_anti")
    null = lambda name: F.lit(None).cast("string").alias(name)
    third = rest.where(F.regexp_like("path", F.lit(r"(^|/)(main|app|server|index|manage)\.[a-z]+$"))).select("path", F.lit(1).alias("line"), F.lit("file").alias("kind"), null("framework"), null("method"), null("route"), null("handler"), F.lit("file").alias("tier"))
    return first.unionByName(second).unionByName(third)


def syntax_entry_points(structure: DataFrame) -> DataFrame:
    """Entry points of decorated Python functions (rows of ``structure.python_structure``)."""
    rx = r"\.(route|get|post|put|delete|patch)\(['\"]([^'\"]+)['\"]"
    rows = structure.where((F.col("kind") == "function") & F.regexp_like("detail", F.lit(rx)))
    method = F.upper(F.regexp_extract("detail", rx, 1))
    return rows.select("path", "line", F.lit("http").alias("kind"), F.lit("python").alias("framework"), F.when(method == "ROUTE", "ANY").otherwise(method).alias("method"), route_path(F.regexp_extract("detail", rx, 2)).alias("route"), F.col("name").alias("handler"))


def config_files(files: DataFrame) -> DataFrame:
    """Container and workflow files with their kind."""
    kind = F.when(F.regexp_like("path", F.lit(CONTAINER_FILES)), "container").when(F.regexp_like("path", F.lit(WORKFLOW_FILES)), "workflow")
    return files.withColumn("kind", kind).where("kind is not null")


def config_risks(files: DataFrame) -> DataFrame:
    """(path, line, rule, risk) of every match of a rule in the container and workflow files."""
    found = []
    for kind, rules in (("container", CONTAINER_RULES), ("workflow", WORKFLOW_RULES)):
        for rule, risk, pattern in rules:
            rows = F.transform(located(F.col("content"), pattern), _risk(rule, risk))
            found.append(F.when((F.col("kind") == kind) & F.regexp_like("content", F.lit(pattern)), rows).otherwise(F.array().cast("array<struct<line:int,rule:string,risk:string>>")))
    return config_files(files).select("path", F.explode(F.concat(*found)).alias("r")).select("path", "r.*")


def build_risks(files: DataFrame) -> DataFrame:
    """(path, line, rule, risk) of every match of a rule in the Maven, Gradle and Python build files."""
    found = []
    for ending, rule, risk, pattern in BUILD_RULES:
        rows = F.transform(located(F.col("content"), pattern), _risk(rule, risk))
        wanted = F.regexp_like("path", F.lit(ending)) & F.regexp_like("content", F.lit(pattern))
        found.append(F.when(wanted, rows).otherwise(F.array().cast("array<struct<line:int,rule:string,risk:string>>")))
    return files.select("path", F.explode(F.concat(*found)).alias("r")).select("path", "r.*")


def rule_files(files: DataFrame) -> DataFrame:
    """(path, rule_id, severity, languages) of the rules with an id in YAML files; files that are refused have none."""
    found = rule_yaml.rules(rule_yaml.yaml_values(files)).where("rule_id is not null")
    return found.select("path", "rule_id", F.coalesce("severity", F.lit("")).alias("severity"), "languages")


def flow_markers(bodies: DataFrame, patterns: dict[str, tuple[tuple[str, str], ...]]) -> DataFrame:
    """(key columns, marker, name): for each kind of marker the first pattern, in order, that a function's body matches."""
    parts = []
    for marker, table in patterns.items():
        hit = F.lit(None).cast("string")
        for name, rx in reversed(table):
            hit = F.when(F.regexp_like("body", F.lit(rx)), name).otherwise(hit)
        parts.append(F.when(hit.isNotNull(), F.struct(F.lit(marker).alias("marker"), hit.alias("name"))))
    keys = [c for c in bodies.columns if c != "body"]
    return bodies.select(*keys, F.explode(F.array_compact(F.array(*parts))).alias("m")).select(*keys, "m.*")
