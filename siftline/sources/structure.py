"""Code structure: functions, calls, imports and routes of source files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import _cut

# Fixed patterns: framework, pattern with groups for method and path.
ROUTES = (
    ("gin", r"\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\(\s*\"([^\"]+)\""),
    ("flask", r"@\w+\.(route)\(\s*['\"]([^'\"]+)['\"]"),
    ("fastapi", r"@\w+\.(get|post|put|delete|patch|head|options)\(\s*['\"]([^'\"]+)['\"]"),
    ("express", r"\b(?:app|router)\.(get|post|put|delete|patch|all)\(\s*['\"]([^'\"]+)['\"]"),
    ("spring", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)\""),
)


#: Join of sides that both grow with the files. What a parser gives is larger than Spark's estimate, which follows the size of the table it
#: reads, so without a hint a side of millions of rows may be taken for a small one and go through the driver; a sort spills, a hash map does not.
SPREAD = "merge"


def python_structure(files: DataFrame) -> DataFrame:
    """(path, kind, name, owner, line, detail) of Python sources: functions, classes, calls, imports.

    ``owner`` is the enclosing function or class; a file that does not parse
    gives one row of kind ``error``.
    """

    def walk(tree: ast.AST) -> Iterator[tuple]:
        stack = [(tree, "")]
        while stack:
            node, owner = stack.pop()
            for child in reversed(list(ast.iter_child_nodes(node))):
                inside = owner
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    kind = "class" if isinstance(child, ast.ClassDef) else "function"
                    inside = f"{owner}.{child.name}" if owner else child.name
                    yield kind, inside, owner, child.lineno, ",".join(ast.unparse(d) for d in child.decorator_list)
                elif isinstance(child, ast.Call):
                    yield "call", ast.unparse(child.func), owner, child.lineno, ""
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield "import", a.name, owner, child.lineno, a.asname or ""
                elif isinstance(child, ast.ImportFrom):
                    for a in child.names:
                        yield "import", f"{'.' * child.level}{child.module or ''}.{a.name}", owner, child.lineno, a.asname or ""
                stack.append((child, inside))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    out += [(path, *row) for row in walk(ast.parse(content or ""))]
                except (SyntaxError, ValueError, RecursionError) as error:
                    out.append((path, "error", type(error).__name__, "", 0, ""))
            yield pd.DataFrame(out, columns=["path", "kind", "name", "owner", "line", "detail"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, name string, owner string, line int, detail string")


def symbols(structure: DataFrame) -> DataFrame:
    """(id, path, name, short, full, is_entry) of functions; ``full`` is qualified by the module: a Python file's path, a Java package, a Go folder."""
    packages = structure.where("kind = 'package'").groupBy("path").agg(F.min("name").alias("package")).hint(SPREAD)
    rows = structure.where("kind = 'function'").join(packages, "path", "left")
    entry = F.regexp_like("detail", F.lit(r"route|\.(get|post|put|delete|patch)\(|command|Mapping\("))
    return rows.select(F.concat_ws(":", "path", "name").alias("id"), "path", "name", F.substring_index("name", ".", -1).alias("short"), F.concat_ws(".", F.nullif(_module(), F.lit("")), "name").alias("full"), entry.alias("is_entry")).distinct()


def _module() -> Column:
    """Module of a row with ``path`` and, for Java, ``package``."""
    python = F.replace(F.regexp_replace("path", r"(^|/)__init__\.py$|\.py$", ""), F.lit("/"), F.lit("."))
    return F.when(F.endswith("path", F.lit(".java")), F.coalesce("package", F.lit(""))).when(F.endswith("path", F.lit(".go")), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).otherwise(python)


def bindings(structure: DataFrame) -> DataFrame:
    """(path, module, local, target) of imports: what a name of a file stands for; ``local`` is * where all names of the target come in.

    Leading dots climb from the file's own package; a Java or Go file sees its whole package.
    """
    packages = structure.where("kind = 'package'").groupBy("path").agg(F.min("name").alias("package")).hint(SPREAD)
    rows = structure.where("kind = 'import'").join(packages, "path", "left").withColumn("module", _module())
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    parts = F.split("module", r"\.")
    up = dots - F.when(F.endswith("path", F.lit("__init__.py")), 1).otherwise(0)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), ".")
    plain = F.regexp_replace("name", r"^\.*", "")
    whole = F.when(dots > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(plain, F.lit("")))).when(F.endswith("path", F.lit(".go")), F.substring_index("name", "/", -1)).otherwise(F.col("name"))
    rows = rows.withColumn("whole", whole)
    last = F.substring_index("whole", ".", -1)
    star = (last == "*") | (F.col("detail") == ".")
    target = F.when(last == "*", F.regexp_replace("whole", r"\.\*$", "")).otherwise(F.col("whole"))
    # an import may be read as a name of a module or as a module by its whole name; only one of the two can be called
    local = F.when(star, F.array(F.lit("*"))).when(F.col("detail") != "", F.array("detail")).otherwise(F.array_distinct(F.array(last, F.col("whole"))))
    own = packages.withColumn("module", _module()).select("path", "module", F.lit("*").alias("local"), F.col("module").alias("target"))
    return rows.select("path", "module", F.explode(local).alias("local"), target.alias("target")).unionByName(own).distinct()


def resolved_names(names: DataFrame, functions: DataFrame, aliases: DataFrame, max_depth: int = 10) -> DataFrame:
    """(full, dst): the function that each qualified name leads to, through names passed on by other modules.

    ``functions`` has full and id; ``aliases`` alias and target: a name that
    begins with an alias stands for one that begins with its target. Names are
    followed together, one join a step; a name once tried is not tried again, so
    cycles end, and a step that brings nothing new is the last.
    """
    frontier = _cut(names.select(F.col("full").alias("origin"), F.col("full").alias("now")).distinct())
    seen, found = frontier, None
    heads = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(F.array_join(F.slice("parts", F.lit(1), k), ".").alias("alias"), F.array_join(F.slice("parts", k + 1, F.size("parts")), ".").alias("rest")))
    for _ in range(max_depth):
        hits = frontier.join(functions.select(F.col("full").alias("now"), F.col("id").alias("dst")).hint(SPREAD), "now").select(F.col("origin").alias("full"), "dst")
        found = hits if found is None else found.unionByName(hits)
        left = frontier.join(hits.select(F.col("full").alias("origin")).distinct(), "origin", "left_anti")
        step = left.withColumn("parts", F.split("now", r"\.")).select("origin", F.explode(heads).alias("h")).select("origin", "h.*").join(aliases.hint(SPREAD), "alias")
        step = step.select("origin", F.concat_ws(".", "target", F.nullif("rest", F.lit(""))).alias("now")).distinct()
        frontier = _cut(step.join(seen, ["origin", "now"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found.distinct()


def call_graph(structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, path, name, is_entry) and edges (src, dst).

    A call goes by the first of these that leads to a function: its qualified
    name, as it stands or through the import that binds its head; a function of
    its own file, for a plain name or one of self or this; an imported name, by
    itself or with all of a module; the only function of that short name.
    Imported names are followed through modules that pass them on.
    """
    structure = _cut(structure)
    functions = _cut(symbols(structure))
    bound = _cut(bindings(structure))
    calls = structure.where("kind = 'call' and owner <> ''").select("path", F.concat_ws(":", "path", "owner").alias("src"), F.col("name").alias("callee")).distinct()
    calls = calls.join(functions.select(F.col("id").alias("src")).hint(SPREAD), "src", "left_semi").withColumn("short", F.substring_index("callee", ".", -1))
    calls = _cut(calls)
    dotted = F.contains("callee", F.lit("."))
    named = calls.where(dotted & ~F.col("callee").rlike(r"^(self|this|cls)\.[^.]*$"))
    parts = F.split("callee", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), ".").alias("local"), F.array_join(F.slice(parts, k + 1, F.size(parts)), ".").alias("rest")))
    by_head = named.select("src", "callee", "path", F.explode(heads).alias("h")).select("src", "callee", "path", "h.*")
    plain = calls.where(~dotted)
    wildcard = bound.where("local = '*'").select("path", "target").hint(SPREAD)
    tried = named.select("src", "callee", F.lit(1).alias("rank"), F.col("callee").alias("full"))
    tried = tried.unionByName(by_head.join(bound.hint(SPREAD), ["path", "local"]).select("src", "callee", F.lit(1).alias("rank"), F.concat_ws(".", "target", "rest").alias("full")))
    tried = tried.unionByName(named.join(wildcard, "path").select("src", "callee", F.lit(1).alias("rank"), F.concat_ws(".", "target", "callee").alias("full")))
    tried = tried.unionByName(plain.join(bound.hint(SPREAD), (plain["path"] == bound["path"]) & (plain["short"] == bound["local"])).select("src", "callee", F.lit(3).alias("rank"), F.col("target").alias("full")))
    tried = tried.unionByName(plain.join(wildcard, "path").select("src", "callee", F.lit(3).alias("rank"), F.concat_ws(".", "target", "short").alias("full")))
    passed = bound.select(F.when(F.col("local") == "*", F.col("module")).otherwise(F.concat_ws(".", F.nullif("module", F.lit("")), "local")).alias("alias"), "target").where("alias <> target").distinct()
    found = tried.join(resolved_names(tried.select("full"), functions, passed), "full").select("src", "callee", "rank", "dst")
    own = calls.join(functions.select("path", "short", F.col("id").alias("dst")).hint(SPREAD), ["path", "short"]).where(~F.contains("callee", F.lit(".")) | F.col("callee").rlike(r"^(self|this|cls)\.[^.]*$"))
    found = found.unionByName(own.select("src", "callee", F.lit(2).alias("rank"), "dst"))
    unique = functions.groupBy("short").agg(F.min("id").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n").hint(SPREAD)
    found = found.unionByName(calls.join(unique, "short").select("src", "callee", F.lit(4).alias("rank"), "dst"))
    found = _cut(found)
    best = found.groupBy("src", "callee").agg(F.min("rank").alias("rank"))
    edges = found.join(best.hint(SPREAD), ["src", "callee", "rank"]).select("src", "dst").distinct()
    return functions.select("id", "path", "name", "is_entry"), edges


def routes(files: DataFrame) -> DataFrame:
    """(path, line, framework, method, route) of every line that declares an HTTP route."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("k", "text"))
    found = F.lit(None).cast("struct<framework:string,method:string,route:string>")
    for name, pattern in reversed(ROUTES):
        hit = F.struct(F.lit(name).alias("framework"), F.upper(F.regexp_extract("text", pattern, 1)).alias("method"), F.regexp_extract("text", pattern, 2).alias("route"))
        found = F.when(F.regexp_like("text", F.lit(pattern)), hit).otherwise(found)
    rows = lines.withColumn("f", found).where("f is not null")
    method = F.when(F.col("f.method").isin("ROUTE", "REQUEST", "ALL"), "ANY").otherwise(F.col("f.method"))
    from ..functions.text import route_path

    return rows.select("path", (F.col("k") + 1).alias("line"), "f.framework", method.alias("method"), route_path(F.col("f.route")).alias("route"))
