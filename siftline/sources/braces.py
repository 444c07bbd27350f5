"""Declarations, calls, imports and annotations of Java and Go files.

A lexer drops comments and keeps strings whole; one pass over the tokens with a
stack of open braces tells which declaration each token stands in. Nothing
recurses, so deep and long files parse in time that follows their length, and a
file that ends too early gives what was read. Rows are those of
``structure.python_structure``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import route_path
from ..operators.graph import _cut

SCHEMA = "path string, kind string, name string, owner string, line int, detail string"
_TOKENS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<text>\"\"\".*?(?:\"\"\"|\Z)|"(?:[^"\\\n]|\\.)*"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*'?)
    |(?P<note>@[A-Za-z_$][\w$.]*)|(?P<name>[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>:=|->|.)""",
    re.S | re.X,
)
_JAVA_BLOCKS = frozenset("if for while switch catch synchronized try return throw else do assert super this case yield".split())
_GO_BLOCKS = frozenset("if for switch select return func go defer range case else chan map struct interface".split())
_TYPES = frozenset(("class", "interface", "enum", "record"))
_CLOSES = {"(": ")", "[": "]", "<": ">"}


class Tokens:
    """Tokens of a source text, comments dropped; marks of one character are their own kind."""

    def __init__(self, source: str):
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.lines: list[int] = []
        line = 1
        for m in _TOKENS.finditer(source):
            kind, text = m.lastgroup, m.group()
            if kind != "skip":
                self.kinds.append(kind)
                self.texts.append(text)
                self.lines.append(line)
            line += text.count("\n")

    def __len__(self) -> int:
        return len(self.texts)

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def kind(self, i: int) -> str:
        return self.kinds[i] if 0 <= i < len(self.kinds) else ""

    def skip(self, i: int) -> int:
        """The place behind the bracket that closes the one at ``i``."""
        open_, depth = self.text(i), 0
        close = _CLOSES[open_]
        while i < len(self):
            if self.kinds[i] == "mark":
                depth += (self.texts[i] == open_) - (self.texts[i] == close)
                if not depth:
                    return i + 1
                if open_ == "<" and self.texts[i] in ";{}":
                    return i
            i += 1
        return i

    def dotted(self, i: int) -> str:
        """The qualified name that ends at ``i``."""
        parts = [self.text(i)]
        while self.text(i - 1) == "." and self.kind(i - 2) == "name":
            parts.append(self.text(i - 2))
            i -= 2
        return ".".join(reversed(parts))

    def arguments(self, i: int) -> str:
        """The first two arguments of the call whose bracket is at ``i``, as far as they are single tokens or dotted names."""
        out, i = [], i + 1
        while len(out) < 2 and self.kind(i) in ("text", "name", "number"):
            begin = i
            while self.text(i + 1) == "." and self.kind(i + 2) == "name":
                i += 2
            out.append("".join(self.texts[begin : i + 1]))
            if self.text(i + 1) != ",":
                break
            i += 2
        return ",".join(out)


def _within(owner: str, name: str) -> str:
    return f"{owner}.{name}" if owner else name


def _call(t: Tokens, i: int, owner: str, blocks: frozenset) -> tuple | None:
    """The row of a call whose name is at ``i``."""
    if t.text(i + 1) != "(" or t.texts[i] in blocks:
        return None
    return "call", t.dotted(i), owner, t.lines[i], t.arguments(i + 1)


def java(source: str) -> Iterator[tuple]:
    """Rows (kind, name, owner, line, detail) of a Java file; annotations are the detail of what they stand on."""
    t, i = Tokens(source), 0
    scopes = [""]  # the declaration that each open brace stands in
    types: list[bool] = [True]
    notes: list[str] = []
    fresh = True
    while i < len(t):
        word, kind = t.texts[i], t.kinds[i]
        if kind == "mark" and word in "{};":
            if word == "{":
                scopes.append(scopes[-1])
                types.append(False)
            elif word == "}" and len(scopes) > 1:
                scopes.pop()
                types.pop()
            notes, fresh = [], True
        elif kind == "note" and word != "@interface":
            end = t.skip(i + 1) if t.text(i + 1) == "(" else i + 1
            if types[-1]:
                notes.append("".join(t.texts[i:end]))
            i = end - 1
        elif fresh and word in ("import", "package") and len(scopes) == 1:
            end = i + 1
            while end < len(t) and t.texts[end] != ";":
                end += 1
            yield word, "".join(x for x in t.texts[i + 1 : end] if x != "static"), "", t.lines[i], ""
            i = end - 1
        elif (word in _TYPES or word == "@interface") and types[-1] and t.kind(i + 1) == "name" and t.text(i - 1) != ".":
            name, line = t.texts[i + 1], t.lines[i]
            yield "class", _within(scopes[-1], name), scopes[-1], line, ",".join(notes)
            i += 2
            while i < len(t) and t.texts[i] not in "{;":
                i = t.skip(i) if t.texts[i] in "(<" else i + 1
            if t.text(i) == "{":
                scopes.append(_within(scopes[-1], name))
                types.append(True)
            notes, fresh = [], True
        elif kind == "name" and t.text(i + 1) == "(" and types[-1] and len(scopes) > 1 and t.text(i - 1) not in (".", "=", "new"):
            end = t.skip(i + 1)
            while end < len(t) and t.texts[end] not in "{;=":
                end += 1
            body = t.text(end) == "{"
            yield "function", _within(scopes[-1], word), scopes[-1], t.lines[i], ",".join(notes)
            if body:
                scopes.append(_within(scopes[-1], word))
                types.append(False)
            i, notes, fresh = end, [], True
        elif kind == "name":
            if row := _call(t, i, scopes[-1], _JAVA_BLOCKS):
                yield row
            fresh = False
        i += 1


def go(source: str) -> Iterator[tuple]:
    """Rows of a Go file; a method is named by its receiver's type, a group of routes by its variable."""
    t, i = Tokens(source), 0
    scopes = [""]  # the declaration that each open brace stands in
    while i < len(t):
        word, kind = t.texts[i], t.kinds[i]
        if kind == "mark" and word == "{":
            scopes.append(scopes[-1])
        elif kind == "mark" and word == "}":
            if len(scopes) > 1:
                scopes.pop()
        elif word == "package" and len(scopes) == 1:
            yield "package", t.text(i + 1), "", t.lines[i], ""
            i += 1
        elif word == "import" and len(scopes) == 1:
            end = t.skip(i + 1) if t.text(i + 1) == "(" else i + 3 if t.kind(i + 1) == "name" or t.text(i + 1) == "." else i + 2
            for k in range(i + 1, min(end, len(t))):
                if t.kinds[k] == "text":
                    alias = t.texts[k - 1] if t.kinds[k - 1] == "name" and k - 1 > i or t.texts[k - 1] == "." else ""
                    yield "import", t.texts[k].strip('"`'), "", t.lines[k], alias
            i = end - 1
        elif word == "type" and len(scopes) == 1 and t.text(i + 1) != "(":
            end = i + 2
            if t.text(end) == "[" and t.kind(end + 1) == "name" and t.kind(end + 2) in ("name", "mark") and t.text(end + 2) != "]":
                end = t.skip(end)
            if t.text(end) in ("struct", "interface"):
                yield "class", t.text(i + 1), "", t.lines[i], ""
                if t.text(end + 1) == "{":
                    scopes.append(t.text(i + 1))
                    end += 1
                i = end
        elif word == "func" and len(scopes) == 1:
            k, receiver = i + 1, ""
            if t.text(k) == "(":
                end = t.skip(k)
                names = [x for x, n in zip(t.texts[k:end], t.kinds[k:end], strict=True) if n == "name"]
                receiver = names[1] if len(names) > 1 else names[0] if names else ""
                k = end
            name = t.text(k)
            full = f"{receiver}.{name}" if receiver else name
            yield "function", full, receiver, t.lines[i], ""
            k += 1
            k = t.skip(k) if t.text(k) == "[" else k
            k = t.skip(k) if t.text(k) == "(" else k
            # results; an interface or struct in them has braces of its own
            while k < len(t) and t.texts[k] != "{":
                if t.texts[k] == "(":
                    k = t.skip(k)
                elif t.texts[k] in ("interface", "struct") and t.text(k + 1) == "{":
                    while k < len(t) and t.texts[k] != "}":
                        k += 1
                    k += 1
                elif t.lines[k] != t.lines[k - 1] and t.texts[k] in ("func", "type", "var", "const"):
                    break
                else:
                    k += 1
            if t.text(k) == "{":
                scopes.append(full)
                i = k
            else:
                i = k - 1
        elif kind == "name":
            if row := _call(t, i, scopes[-1], _GO_BLOCKS):
                yield row
                if word == "Group" and t.text(i - 1) == "." and t.text(i - 3) in (":=", "="):
                    yield "group", t.text(i - 4), scopes[-1], t.lines[i], f"{t.text(i - 2)},{row[4].split(',')[0]}"
        i += 1


LANGUAGES = {".java": java, ".go": go}


#: Rows in a batch that a parser gives back, about.
ROWS = 1 << 14


def brace_structure(files: DataFrame) -> DataFrame:
    """(path, kind, name, owner, line, detail) of the Java and Go files among ``files`` (path, content); null contents have no rows.

    Files are dealt to as many tasks as a shuffle has, since a small table of many
    files is read by one; rows go back in batches, not file by file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "kind", "name", "owner", "line", "detail"]
        types = pa.schema([(n, pa.int32() if n == "line" else pa.string()) for n in names])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(*(batch.column(j).to_pylist() for j in range(2)), strict=True):
                parse = next(f for ending, f in LANGUAGES.items() if path.endswith(ending))
                for row in parse(content or ""):
                    rows.append((path, *row))
                    if len(rows) == ROWS:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    wanted = F.endswith("path", F.lit(".java")) | F.endswith("path", F.lit(".go"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.where(wanted).select("path", "content").repartition(tasks, "path", "content").mapInArrow(run, SCHEMA)


_STRING = r"\"([^\"]*)\""
# Fixed: annotations and calls that declare an entry: kind, framework, pattern of the annotation.
_LISTENERS = (("mq", "kafka", "KafkaListener"), ("mq", "rabbitmq", "RabbitListener"), ("cron", "spring", "Scheduled"))
_GO_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def brace_entry_points(structure: DataFrame) -> DataFrame:
    """(path, line, kind, framework, method, route, handler) of Spring and Dubbo annotations and of Go routes and cron jobs.

    A class's mapping stands before those of its methods, a group's path before
    those of its routes.
    """
    null = F.lit(None).cast("string")
    # only rows that the rules below look at are kept
    routed = F.endswith("path", F.lit(".go")) & F.startswith("detail", F.lit('"'))
    structure = _cut(structure.where((F.col("kind").isin("class", "group")) | ((F.col("kind") == "function") & (F.col("detail") != "")) | ((F.col("kind") == "call") & routed)))
    classes = structure.where("kind = 'class'").select("path", F.col("name").alias("owner"), F.regexp_extract("detail", rf"@RequestMapping\([^)]*?{_STRING}", 1).alias("prefix"), F.regexp_like("detail", F.lit("@DubboService|@Service\\(")).alias("dubbo"), "line")
    methods = structure.where("kind = 'function' and detail <> ''").join(classes.drop("line"), ["path", "owner"])
    handler = F.substring_index("name", ".", -1).alias("handler")
    verb = F.regexp_extract("detail", r"@(Get|Post|Put|Delete|Patch|Request)Mapping", 1)
    route = F.concat("prefix", F.regexp_extract("detail", rf"Mapping\([^)]*?{_STRING}", 1))
    out = methods.where(verb != "").select("path", "line", F.lit("http").alias("kind"), F.lit("spring").alias("framework"), F.when(verb == "Request", "ANY").otherwise(F.upper(verb)).alias("method"), route_path(route).alias("route"), handler)
    for kind, framework, name in _LISTENERS:
        value = F.regexp_extract("detail", rf"@{name}\([^)]*?(?:{_STRING}|=\s*(\w+))", 0)
        value = F.regexp_replace(F.regexp_extract(value, r"[^\"=(]+\"?$", 0), '"', "")
        out = out.unionByName(methods.where(F.contains("detail", F.lit(f"@{name}("))).select("path", "line", F.lit(kind).alias("kind"), F.lit(framework).alias("framework"), null.alias("method"), value.alias("route"), handler))
    services = structure.where("kind = 'class'").join(classes.where("dubbo").select("path", F.col("owner").alias("name"), "line"), ["path", "name", "line"])
    out = out.unionByName(services.select("path", "line", F.lit("rpc").alias("kind"), F.lit("dubbo").alias("framework"), null.alias("method"), F.substring_index("name", ".", -1).alias("route"), handler))
    calls = structure.where("kind = 'call'").select("path", "line", F.substring_index("name", ".", 1).alias("base"), F.substring_index("name", ".", -1).alias("verb"), F.regexp_extract("detail", rf"^{_STRING}", 1).alias("value"), F.regexp_extract("detail", r"^\"[^\"]*\",([\w.]+)", 1).alias("handler"))
    calls = calls.where(F.endswith("path", F.lit(".go")) & (F.col("value") != ""))
    groups = structure.where("kind = 'group'").select("path", F.col("name").alias("base"), F.regexp_extract("detail", _STRING, 1).alias("prefix")).groupBy("path", "base").agg(F.min("prefix").alias("prefix"))
    routes = calls.where(F.col("verb").isin(*_GO_METHODS, "HandleFunc", "AddFunc")).join(groups, ["path", "base"], "left")
    job, plain = F.col("verb") == "AddFunc", F.col("verb") == "HandleFunc"
    return out.unionByName(
        routes.select(
            "path",
            "line",
            F.when(job, "cron").otherwise("http").alias("kind"),
            F.when(job, "cron").when(plain, "net/http").otherwise("gin").alias("framework"),
            F.when(job, null).when(plain, "ANY").otherwise(F.col("verb")).alias("method"),
            F.when(job, F.col("value")).otherwise(route_path(F.concat(F.coalesce("prefix", F.lit("")), F.col("value")))).alias("route"),
            F.nullif(F.substring_index("handler", ".", -1), F.lit("")).alias("handler"),
        )
    )
