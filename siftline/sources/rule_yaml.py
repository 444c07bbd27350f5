"""Rule files in YAML: every value with its place, and one row per rule.

The reader knows block maps and lists, block, quoted and plain scalars over
several lines, flow lists of scalars and comments. A file with anchors, aliases,
tags, flow maps or several documents is refused whole, with the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTED = r"""\"(?:[^"\\]|\\.)*+"|'(?:[^']|'')*+'"""
# possessive throughout: runs of spaces take linear time
_KEY = re.compile(rf"""({_QUOTED}|(?:[^\s"'\[\]{{}}#&*!|>%@`,?:-]|-(?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)\#|[ \t]++(?=[^\s#:]|:\S))*+)[ \t]*+:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])(?:([+-])?([1-9])?|([1-9])([+-]))\s*(?:\s#.*)?$")
_ITEM = re.compile(rf"""\s*+({_QUOTED}|[^\s,\[\]{{}}"'&*!|>%@`#](?:[^\s,\[\]{{}}#]|(?<=\S)\#|\s++(?=[^\s,\[\]{{}}#]))*+)\s*+(,|\])""")
_END = re.compile(r"\s*+\]")
#: What closes a scalar in one of its lines.
_CLOSING = {
    "[": re.compile(rf"""(?:[^\]"'#]|{_QUOTED}|(?<=\S)\#)*+\]\s*+(?:(?<=\s)#.*)?$"""),
    '"': re.compile(r"""(?:[^"\\]|\\.)*+"\s*+(?:(?<=\s)#.*)?$"""),
    "'": re.compile(r"""(?:[^']|'')*+'\s*+(?:(?<=\s)#.*)?$"""),
}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "/": "/", "\\": "\\", '"': '"', " ": " "}


class Refused(ValueError):
    """What the reader does not read."""


def values(text: str) -> Iterator[tuple[str, str | None]]:
    """(pointer, value) of every scalar, in order; the steps of a pointer are keys and places, after slashes."""
    lines = text.split("\n")
    open_: list[list] = []  # indent, is list, pointer, keys or number of items
    pending: tuple[str, int, int] | None = ("", 0, 0)  # pointer, least indent of a list, of anything else
    at = 0
    begun = False
    while at < len(lines):
        raw = lines[at].rstrip("\r")
        body = raw.lstrip(" ")
        at += 1
        if not body.strip() or body.startswith("#"):
            continue
        if body.startswith("\t"):
            raise Refused("tab in the indent")
        if re.match(r"(---|\.\.\.)(\s|$)", raw):
            ends = raw.startswith("...") and not any(r.strip() and not r.startswith("#") for r in lines[at:])
            if not ends and (begun or raw.strip() != "---"):
                raise Refused("several documents")
            begun = True
            continue
        begun = True
        indent = len(raw) - len(body)
        while True:
            is_list = body == "-" or body.startswith("- ")
            key = None if is_list else _KEY.match(body)
            if pending and indent < (pending[1] if is_list else pending[2]):
                yield pending[0], None
                pending = None
            if pending and (is_list or key):
                open_.append([indent, is_list, pending[0], 0 if is_list else set()])
                pending = None
            elif not pending:
                while open_ and (open_[-1][0] > indent or (open_[-1][0] == indent and open_[-1][1] != is_list)):
                    open_.pop()
                if not open_ or open_[-1][0] != indent or not (is_list or key):
                    raise Refused(f"line {at} stands in no map or list")
            if is_list:
                pointer = f"{open_[-1][2]}/{open_[-1][3]}"
                open_[-1][3] += 1
                rest = body[1:].lstrip(" ")
                pending, least = (pointer, indent + 1, indent + 1), indent
                if not rest or rest.startswith("#"):
                    break
                indent, body = indent + len(body) - len(rest), rest
                if body == "-" or body.startswith("- ") or _KEY.match(body):
                    continue
            elif key:
                name = _scalar(key[1])
                if name == "<<" or name in open_[-1][3]:
                    raise Refused(f"key {name} of line {at}")
                open_[-1][3].add(name)
                pointer, least = f"{open_[-1][2]}/{name.replace('~', '~0').replace('/', '~1')}", indent
                body = body[key.end() :].strip()
                if not body or body.startswith("#"):
                    pending = (pointer, indent, indent + 1)
                    break
            else:
                pointer, least = pending[0], pending[2] - 1
            pending = None
            block = _BLOCK.match(body)
            if block:
                value, at = _block(lines, at, least, block[1] == "|", block[2] or block[5] or "", block[3] or block[4])
                yield pointer, value
            else:
                whole, at = _whole(lines, at, least, body)
                yield from _flow(pointer, whole) if whole.startswith("[") else [(pointer, _scalar(whole))]
            break
    if pending and pending[0]:
        yield pending[0], None


def _block(lines: list[str], at: int, least: int, literal: bool, chomp: str, given: str | None) -> tuple[str, int]:
    """The text of a block scalar, and the line after it."""
    end = at
    while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip(" ")) > least):
        end += 1
    rows = [r.rstrip("\r") for r in lines[at:end]]
    if end == len(lines) and rows and not rows[-1]:
        rows.pop()  # what follows the last line break is no line
    depth = max(least, 0) + int(given) if given else next((len(r) - len(r.lstrip(" ")) for r in rows if r.strip()), 0)
    rows = [r[depth:] for r in rows]
    used = len(rows)
    while used and not rows[used - 1].strip():
        used -= 1
    text = "\n".join(rows[:used]) if literal else _folded(rows[:used])
    blank = len(rows) - used
    ending = "" if chomp == "-" else "\n" * (used > 0) + "\n" * (blank if chomp == "+" else 0)
    return text + ending, end


def _folded(rows: list[str]) -> str:
    """Lines joined by spaces; blank lines are breaks, deeper lines keep theirs."""
    out, blanks, deep = "", 0, False
    for k, row in enumerate(rows):
        if not row:
            blanks += 1
            continue
        more = row[0] in " \t"
        if k > blanks or out:
            out += "\n" * (blanks + (1 if more or deep else 0)) if blanks or more or deep else " "
        else:
            out += "\n" * blanks
        out, blanks, deep = out + row, 0, more
    return out


def _whole(lines: list[str], at: int, least: int, body: str) -> tuple[str, int]:
    """A flow list, quoted or plain scalar with the lines that it goes on over."""
    closing = _CLOSING.get(body[0])
    plain = lambda row: re.split(r"\s#", row, maxsplit=1)[0].rstrip()
    out = [body if closing else plain(body)]
    closed, blanks = closing and closing.match(body, 1), 0
    while not closed:
        row = lines[at].rstrip("\r") if at < len(lines) else None
        if row is not None and not row.strip():
            blanks, at = blanks + 1, at + 1
            continue
        if row is None or len(row) - len(row.lstrip(" ")) <= least or (not closing and row.lstrip().startswith("#")):
            if closing:
                raise Refused(f"what begins before line {at + 1} has no end")
            break
        row = row.strip()
        if not closing and _KEY.match(row):
            raise Refused(f"line {at + 1} is a key inside a scalar")
        tail = out[-1][len(out[-1].rstrip("\\")) :]
        if body[0] == '"' and len(tail) % 2:
            out[-1] = out[-1][:-1]  # an escaped line break
            out.append("\n" * blanks)
        else:
            out.append("\n" * blanks or " ")
        out.append(row if closing else plain(row))
        closed = closing and closing.match(row)
        blanks, at = 0, at + 1
    return "".join(out), at


def _flow(pointer: str, text: str) -> Iterator[tuple[str, str | None]]:
    at, n = 1, 0
    while not _END.match(text, at):
        item = _ITEM.match(text, at)
        if not item:
            raise Refused(f"a flow list at {pointer}")
        yield f"{pointer}/{n}", _scalar(item[1])
        n, at = n + 1, item.end() - (item[2] == "]")


def _scalar(text: str) -> str | None:
    quote = text[0]
    if quote == '"':
        inner = text[1 : re.match(r'"(?:[^"\\]|\\.)*"', text, re.S).end() - 1]
        return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _escaped(m[3]), inner, flags=re.S)
    if quote == "'":
        return text[1 : re.match(r"'(?:[^']|'')*'", text, re.S).end() - 1].replace("''", "'")
    if quote in "&*!%@`{":
        raise Refused("an anchor, alias, tag or flow map")
    return None if text in ("~", "null") else text


def _escaped(char: str) -> str:
    if char not in _ESCAPES:
        raise Refused(f"escape {char}")
    return _ESCAPES[char]


def yaml_values(files: DataFrame) -> DataFrame:
    """(path, pointer, value, refused) of YAML ``files`` (path, content): a row per scalar, or one with the reason.

    Null contents and empty files have no rows; a file is read whole in one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                try:
                    rows = [(path, pointer, value, None) for pointer, value in values(content or "")]
                except Refused as why:
                    rows = [(path, None, None, str(why))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "pointer", "value", "refused"])

    return files.select("path", "content").mapInArrow(run, "path string, pointer string, value string, refused string")


def rules(found: DataFrame) -> DataFrame:
    """One row per rule of :func:`yaml_values`: path, place, rule_id, severity, languages, n_patterns, validity.

    Rules are the items of ``rules`` at the top or in the items of a list, a map
    with an id at the top, or the items with an id of a list. ``invalid_structure``
    has no id; ``valid`` has metavariables, alternatives, context or a call;
    ``literal_only`` has none of them.
    """
    top = r"^((?:/\d+)?/rules/\d+|/\d+(?=/)|)(/.*)$"
    rows = found.where("pointer is not null").select("path", F.regexp_extract("pointer", top, 1).alias("place"), F.regexp_extract("pointer", top, 2).alias("rest"), "value")
    at = lambda name: F.max(F.when(F.col("rest") == f"/{name}", F.col("value")))
    under = lambda rx: F.regexp_like("rest", F.lit(rx))
    language = F.when(under(r"^/languages/\d+$"), F.struct(F.regexp_extract("rest", r"(\d+)$", 1).cast("int").alias("n"), F.col("value").alias("v")))
    items = F.countDistinct(F.when(under(r"^/(patterns|pattern-either)/\d+"), F.regexp_extract("rest", r"^(/[a-z-]+/\d+)", 1)))
    single = F.count_if(under("^/(pattern|pattern-regex|pattern-inside)$"))
    meta = F.bool_or(F.coalesce(F.regexp_like("value", F.lit(r"\$[A-Z_][A-Z0-9_]*")), F.lit(False)))
    call = F.bool_or(F.coalesce(under("^/pattern$") & F.regexp_like("value", F.lit(r"\w\s*\([^)]*\)")) & ~F.regexp_like(F.trim("value"), F.lit("""^["'].*["']$""")), F.lit(False)))
    context = F.bool_or(under("^/(patterns|pattern-either|pattern-inside)(/|$)"))
    grouped = rows.groupBy("path", "place").agg(
        at("id").alias("rule_id"), at("severity").alias("severity"), F.array_join(F.transform(F.array_sort(F.collect_list(language)), lambda x: x["v"]), ",").alias("languages"),
        (items + single).cast("bigint").alias("n_patterns"), (meta | call | context).alias("_structure"), F.bool_or(F.col("rest") == "/id").alias("_named"),
    )
    wanted = grouped.where(F.col("_named") | F.col("place").contains("/rules/"))
    validity = F.when(F.col("rule_id").isNull(), "invalid_structure").when(F.col("_structure"), "valid").otherwise("literal_only")
    return wanted.select("path", "place", "rule_id", "severity", "languages", "n_patterns", validity.alias("validity"))
