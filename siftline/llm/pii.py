"""Personal data by seed patterns and bootstrapped contextual extraction.

Seeds are spans of four fixed kinds. Words around a seed (the one to the left,
the two to the left, the one to the right) are lexical patterns; other
identifier-shaped tokens are unlabelled instances with such patterns of their
own. Both make a bipartite graph of distinct (pattern, instance) edges. Every
round scores the patterns by the share of labelled instances among theirs, then
the unlabelled instances by their best pattern; those of high confidence join
the labelled ones and induce further patterns in the next round. A score never
counts the instance it is given to. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, cut
from .spans import OTHER, SPAN, count_kind, joined, match_spans, none, redact, uncovered

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. \x01 and \x02 stand for masked separators, see base_spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x02-]))[A-Za-z0-9._%+\x02-]++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: An identifier is a token with a digit, an at sign or an underscore inside.
IDENTIFIER = r"(?<![\p{L}\p{N}_.@+-])(?=[\p{L}.+-]*[0-9@_])[\p{L}\p{N}_.@+-]*[\p{L}\p{N}_]"
#: Distinct labelled instances a pattern needs, and the score that patterns and instances need.
MIN_SEEDS = 5
MIN_SCORE = 0.9
SMOOTHING = 0.5
ROUNDS = 4
#: Rows and spans that may travel to every executor; more are joined by row.
SHIPPED_ROWS = 50_000
_PATTERNS = ("left", "left2", "right")


def _luhn(hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    turned = F.split(F.reverse(digits), "")
    doubled = F.transform(turned, lambda c, i: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v))
    return F.length(digits).between(12, 19) & (total % 10 == 0)


def _octets(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def base_spans(text: Column) -> Column:
    """Seed spans of a non-null text.

    A dot between label characters and a single separator between digits are
    first masked by one control character each, so that a whole domain or card
    number is a run of one character class.
    """
    digits = F.regexp_like(text, F.lit("[0-9]"))
    dotted = F.regexp_replace(F.translate(text, "\x02", "\x03"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x02")
    spaced = F.regexp_replace(F.translate(text, "\x01", "\x03"), r"(?<=[0-9])[ -](?=[0-9])", "\x01")
    length = lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))
    yes = lambda m: F.lit(True)
    dots = lambda m: F.translate(m, "\x02", ".")
    plain = lambda m: F.translate(m, "\x01", "")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), match_spans(dotted, EMAIL, "email", 0, yes, dots, True)).otherwise(none()),
        F.when(digits & F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), match_spans(text, IP, "ip", 1, _octets, None, True)).otherwise(none()),
        F.when(digits, match_spans(spaced, CARD, "card", 2, _luhn, plain, True)).otherwise(none()),
        F.when(F.contains(text, F.lit("+")), match_spans(text, PHONE, "phone", 3, lambda m: length(m).between(9, 15), None, True)).otherwise(none()),
    )


def _identifiers(text: Column) -> Column:
    """Instances that may be labelled: identifiers of four characters or more."""
    enough = lambda m: F.length(m) >= 4
    return F.when(F.regexp_like(text, F.lit("[0-9@_]")), match_spans(text, IDENTIFIER, "?", OTHER, enough, None, True)).otherwise(none())


def _edges(found: DataFrame, *keep: str) -> DataFrame:
    """(pattern, value) and ``keep`` of the occurrences in column ``s``: a row for each pattern around it."""
    around = F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), F.col(f"s.{k}")) for k in _PATTERNS]))
    return found.select(*keep, F.lower("s.value").alias("value"), F.explode(around).alias("pattern"))


def bootstrap(seeds: DataFrame, unknown: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, pattern, score) of the unlabelled instances that the rounds label, by their best pattern.

    ``seeds`` holds (pattern, value, kind), ``unknown`` (pattern, value); repeats
    count once. A value that is a seed of some kind anywhere has that kind from
    the start. A pattern's score for a kind is labelled / (all + SMOOTHING) over
    its distinct instances, and it needs MIN_SEEDS labelled ones. An unlabelled
    instance is not among the labelled ones of its patterns, so it gains nothing
    from itself; once labelled, it is not scored again. Ties of kinds go to the
    first by name.
    """
    seeds = seeds.select("pattern", "value", "kind").distinct()
    unknown = unknown.select("pattern", "value").distinct()
    edges = cut(seeds.select("pattern", "value").union(unknown).distinct())
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS)
    labelled = cut(seeds.groupBy("value").agg(F.min("kind").alias("kind")))
    sizes = cut(sizes)
    found = None
    for _ in range(rounds):
        known = edges.join(labelled, "value")
        support = known.groupBy("pattern", "kind").agg(F.count("*").alias("labelled")).where(F.col("labelled") >= MIN_SEEDS)
        scores = support.join(sizes, "pattern").select("pattern", "kind", (F.col("labelled") / (F.col("n") + SMOOTHING)).alias("score"))
        sure = cut(scores.where(F.col("score") >= MIN_SCORE))
        gained = edges.join(sure, "pattern").join(labelled.select("value"), "value", "left_anti")
        best = gained.groupBy("value").agg(F.max(F.struct("score", "kind", "pattern")).alias("m"))
        new = cut(best.select("value", "m.kind", "m.pattern", "m.score"))
        if new.isEmpty():
            break
        labelled = cut(labelled.union(new.select("value", "kind")))
        found = new if found is None else found.union(new)
    return found if found is not None else edges.where(F.lit(False)).select("value", F.lit("").alias("kind"), "pattern", F.lit(0.0).alias("score"))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (array of start, rank, kind, end, left, left2, right, value) and ``base`` (the seeds among them).

    Labelled instances are spans wherever they stand in one of the contexts of
    their graph or not: the label is of the value. Null texts count as empty and
    have no span; repeated rows each get their own spans; an empty table gives
    an empty result. Columns of ``docs`` named ``spans`` or ``base`` are
    replaced, all others kept whatever their names. Offsets are code points, end
    exclusive.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.drop("spans", "base")
    found = plain.select(F.struct(*plain.columns).alias("row"), base_spans(text).alias("base"), _identifiers(text).alias("ids"))
    # a seed covers the identifiers that overlap it
    free = uncovered(F.col("ids"), F.col("base"))
    # texts stay where they are: only values and rows' numbers travel
    table = scratch.table(found.withColumn("ids", free).withColumn("n", F.monotonically_increasing_id()), "spans")
    seeds = _edges(table.select(F.explode("base").alias("s")), "s.kind")
    other = table.where(F.size("ids") > 0).select("n", F.explode("ids").alias("s"))
    labels = bootstrap(seeds, _edges(other)).select(F.col("value").alias("name"), F.col("kind").alias("label"))
    labelled = other.withColumn("name", F.lower("s.value")).join(labels, "name")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("label")).cast("int") - 1
    fields = [F.col("s.start"), rank.alias("rank"), F.col("label").alias("kind"), F.col("s.end"), F.col("s.left"), F.col("s.left2"), F.col("s.right"), F.col("s.value")]
    added = scratch.table(labelled.groupBy("n").agg(F.collect_list(F.struct(*fields)).cast(SPAN).alias("added")), "added")
    few = added.count() <= SHIPPED_ROWS and (added.agg(F.sum(F.size("added"))).first()[0] or 0) <= SHIPPED_ROWS
    out = table.join(F.broadcast(added) if few else added, "n", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", none()))))
    return out.select("row.*", "base", "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined spans of :func:`find_pii`."""
    base = joined(F.col("base"))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets.

    Null texts stay null, repeated rows stay, an empty table gives an empty
    result; no other column changes, whatever its name.
    """
    row = docs.select(F.struct(*docs.columns).alias("_siftline_row"), F.col(text_col).cast("string").alias("_siftline_text"))
    found = find_pii(row, "_siftline_text")
    clean = F.when(F.size("spans") > 0, redact(F.col("_siftline_text"), F.col("spans"))).otherwise(F.col("_siftline_text"))
    return found.select(F.col("_siftline_row").withField(f"`{text_col}`", clean).alias("row")).select("row.*")
