"""Secrets by regex rules behind a trigram inverted index.

Each rule's regex is parsed on the driver into a Boolean trigram query: every
clause lists alternatives, each a set of trigrams that a match must contain.
The index is a table of postings, keyed by trigram: the documents that hold it,
for every trigram that any rule asks for. The postings of an alternative are
intersected, alternatives united, clauses intersected; what is left are the
rule's candidates, and only their texts are fetched and run through its regex.
Rules without mandatory trigrams scan every text, once, while the index is
built; the documents they may match are a posting list like any other.
DataFrame functions only.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from re import _constants as rc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import count_kind, joined, match_spans, none


@dataclass(frozen=True)
class Rule:
    """A regex (ASCII, Java and Python alike), the least length of a match, and of its ``group`` if that is set."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = True
    #: Characters that must not stand before a match: a match begins where a run of them does, so no run is tried from within.
    edge: str = ""

    @property
    def regex(self) -> str:
        """The pattern with its edge, for Java and Python."""
        return f"(?<!{self.edge}){self.pattern}" if self.edge else self.pattern


#: Fixed rules; kinds in the order of ties.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("repo", r"ghp_[A-Za-z0-9]+", 40, base=False),
    Rule("chat", r"xoxb-[A-Za-z0-9-]+", 20, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, base=False, edge="[A-Za-z0-9_-]"),
)
#: Candidates that may travel to every executor; more are joined by id and text hash.
SHIPPED_ROWS = 50_000
#: Exact sets beyond this size are split into clauses.
_SET = 64

Clause = frozenset  # of alternatives, each a frozenset of trigrams


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every match of ``pattern``, lower-cased, meets; none if it has no mandatory trigram."""
    clauses: list[Clause] = []

    def flush(exact: set[str]) -> set[str]:
        # a string that holds another one asks for nothing more; trigrams side by side, and the last, ask for all letters
        least = [x for x in exact if not any(y != x and y in x for y in exact)]
        options = [frozenset(x[k : k + 3] for k in [*range(0, len(x) - 2, 3), *([len(x) - 3] if len(x) > 2 else [])]) for x in least]
        if options and all(options):
            clauses.append(frozenset(options))
        return {""}

    def strings(item) -> set[str] | None:
        """All strings an item can match if they are few, else None."""
        op, arg = item
        if op is rc.LITERAL:
            return {chr(arg).lower()}
        if op is rc.IN:
            out: set[str] = set()
            for kind, value in arg:
                if kind is rc.LITERAL:
                    out.add(chr(value).lower())
                elif kind is rc.RANGE and value[1] - value[0] < 8:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out
        if op is rc.SUBPATTERN:
            return sequence(arg[-1])
        if op is rc.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 2:
            one = sequence(arg[2])
            if one is None:
                return None
            out, run = set(), {""}
            for k in range(arg[1] + 1):
                if k >= arg[0]:
                    out |= run
                run = {a + b for a in run for b in one}
            return out
        return None

    def sequence(items) -> set[str] | None:
        out = {""}
        for item in items:
            more = strings(item)
            if more is None:
                return None
            out = {a + b for a in out for b in more}
            if len(out) > _SET:
                return None
        return out

    exact = {""}
    for item in sre.parse(pattern):
        more = strings(item)
        if more is None:
            exact = flush(exact)
            if item[0] is rc.MAX_REPEAT and item[1][0] > 0 and (inner := sequence(item[1][2])):
                flush(inner)
        elif len(exact) * len(more) > _SET:
            flush(exact)
            exact = more
        else:
            exact = {a + b for a in exact for b in more}
    flush(exact)
    return clauses


def _accept(rule: Rule):
    """Whether a match is long enough; a group's length is what follows the match's fixed head."""

    def check(hit: Column) -> Column:
        part = F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit
        return F.length(part) >= rule.least

    return check


def _full_scan(rule: Rule) -> str:
    """Name of the posting list of a rule that no trigram stands for."""
    return f"rule {rule.kind}"


def _tag(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, grams: list[str], rules: tuple[Rule, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, id, tag): the documents that hold each wanted trigram in their lower-cased text, and those that each of ``rules`` may match.

    ``tag`` is a hash of the text, so rows of one id are told apart by it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = docs.select(F.col(id_col).alias("id"), _tag(text).alias("tag"), text.alias("text"), F.lower(text).alias("low"))
    held = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    # a run of the least length is enough to tell that a rule may match
    scans = [F.when(F.regexp_like("text", F.lit(f"(?:{r.pattern.rstrip('+')}){{{max(r.least, 1)}}}" if _run(r) else r.pattern)), F.lit(_full_scan(r))) for r in rules]
    return low.select(F.explode(F.array_compact(F.array(*held, *scans))).alias("trigram"), "id", "tag")


def _run(rule: Rule) -> bool:
    """Whether the pattern is one class, repeated."""
    items = list(sre.parse(rule.pattern))
    return not rule.group and len(items) == 1 and items[0][0] is rc.MAX_REPEAT and items[0][1][0] == 1 and rule.pattern.endswith("+")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, tag, rules): the documents of ``index`` that meet a rule's query, with the positions of those rules."""
    queries = [trigram_query(r.pattern) or [frozenset([frozenset([_full_scan(r)])])] for r in rules]
    lists: dict[str, list[int]] = {}
    needs, places = [], []
    for k, query in enumerate(queries):
        for c, clause in enumerate(query):
            for option in sorted(clause, key=sorted):
                for gram in option:
                    lists.setdefault(gram, []).append(len(needs))
                needs.append(len(option))
                places.append(k * 1000 + c)
    # the postings of an option's trigrams meet by document; those in all of its lists stay
    options = F.create_map(*[x for g, own in sorted(lists.items()) for x in (F.lit(g), F.array(*map(F.lit, own)))])
    need, place = (F.array(*map(F.lit, x)) for x in (needs, places))
    # repeated rows may count more than once, which only adds candidates
    met = index.select("id", "tag", F.explode(options[F.col("trigram")]).alias("option")).groupBy("id", "tag", "option").agg(F.count("*").alias("n"))
    met = met.where(F.col("n") >= F.get(need, F.col("option"))).select("id", "tag", F.get(place, F.col("option")).alias("clause"))
    held = met.groupBy("id", "tag").agg(F.collect_set("clause").alias("clauses"))
    whole = [F.when(F.size(F.array_except(F.array(*[F.lit(k * 1000 + c) for c in range(len(q))]), "clauses")) == 0, F.lit(k)) for k, q in enumerate(queries)]
    return held.select("id", "tag", F.array_compact(F.array(*whole)).alias("rules")).where(F.size("rules") > 0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``base`` (spans of the base rules) and ``spans`` (those of all rules).

    Null texts count as empty and have no span; repeated rows each get their
    own spans; rows with a null id are told apart by their text; an empty table
    gives an empty result. Columns of ``docs`` named ``base`` or ``spans`` are
    replaced, all others kept whatever their names. Offsets are code points, end
    exclusive. Any number of rules and trigrams may be asked for.
    """
    scratch = Scratch(docs.sparkSession)
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})
    scanned = tuple(r for r in rules if not trigram_query(r.pattern))
    # a segment of the index for each part of the documents, its lists one after the other, so that no list is in one task
    index = scratch.table(postings(docs, grams, scanned, id_col, text_col).sortWithinPartitions("trigram", "tag"), "postings")
    chosen = scratch.table(candidates(index, rules), "candidates")
    few = chosen.count() <= SHIPPED_ROWS
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_siftline_id"), _tag(text).alias("_siftline_tag"), text.alias("_siftline_text"))
    same = texts["_siftline_id"].eqNullSafe(chosen["id"]) & (texts["_siftline_tag"] == chosen["tag"])
    fetched = texts.join(F.broadcast(chosen) if few else chosen, same).select("id", "tag", "rules", "_siftline_text")
    found = [F.when(F.array_contains("rules", k), match_spans(F.col("_siftline_text"), r.regex, r.kind, k, _accept(r))).otherwise(none()) for k, r in enumerate(rules)]
    base = [c for c, r in zip(found, rules) if r.base]
    extra = [c for c, r in zip(found, rules) if not r.base]
    verified = fetched.select("id", "tag", F.array_sort(F.concat(none(), *base)).alias("base"), F.concat(none(), *extra).alias("extra")).where((F.size("base") > 0) | (F.size("extra") > 0))
    verified = scratch.table(verified.groupBy("id", "tag").agg(F.first("base").alias("base"), F.first("extra").alias("extra")), "verified")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_siftline_id"), _tag(text).alias("_siftline_tag"))
    same = row["_siftline_id"].eqNullSafe(verified["id"]) & (row["_siftline_tag"] == verified["tag"])
    few = (verified.agg(F.sum(F.size("base") + F.size("extra"))).first()[0] or 0) <= SHIPPED_ROWS
    out = row.join(F.broadcast(verified) if few else verified, same, "left")
    plain = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("base", "spans")]
    every = F.array_sort(F.concat(F.coalesce("base", none()), F.coalesce("extra", none())))
    return out.select(*plain, F.coalesce("base", none()).alias("base"), every.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and joined spans of :func:`find_secrets`."""
    counts = [count_kind(F.col("base"), r.kind).alias(f"n_{r.kind}") for r in rules if r.base]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
