"""Quality rules judged per document and per host.

Every text is measured by expressions alone. Each rule's failures are counted by
host; a beta prior fitted to all hosts by moments shrinks the rates of hosts of
few documents towards the common rate; the verdict on a host joins back to its
documents. DataFrame functions only.

Words in repeated three-word windows are found by sorting window hashes with
their positions; equal neighbours are candidates, and only candidates are
compared as words. Time is n log n in the words of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: A host goes where a shrunk rate of one rule exceeds this.
REJECT_RATE = 0.5
#: Hosts of at least one in so many documents travel to every executor: so many at most.
SHIPPED_HOSTS = 10_000
#: Failure of each rule, by the measures of :func:`measure`; the first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
BASE = ("short", "repetitive")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _same_as_neighbour(values: Column, key) -> Column:
    """Elements of a sorted array whose ``key`` is that of the element before or after."""
    same = lambda v, j: F.coalesce(key(v) == key(F.get(values, j)), F.lit(False))
    return F.filter(values, lambda v, j: same(v, j - 1) | same(v, j + 1))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the measures of each text as longs.

    n_words; word_chars (code points in words); n_symbols; n_lines (lines with a
    word); n_dup_lines (those equal to an earlier line); n_repeat_words (words in
    three-word windows found twice or more). Null texts are empty; texts without
    words have zeros. Columns of the measures' names, or ``text_col``, do not
    come back.
    """
    kept = [c for c in docs.columns if c not in MEASURES and c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("row"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CHAR))
    rows = rows.select("row", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"), F.regexp_count("text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"))
    words, at = F.col("words"), lambda i: F.get("words", i)
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    rows = rows.select(
        "row",
        "words",
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform(heads, lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2))).alias("hashes"),
        F.length(F.bin(F.size("words").cast("bigint"))).alias("bits"),
    )
    # equal windows have equal hashes: where all hashes differ, nothing is sorted
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.transform("hashes", lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("bigint")))
    rows = rows.withColumn("placed", F.sort_array(F.when(repeats, placed).otherwise(F.array().cast("array<bigint>")))).drop("hashes")
    top = lambda k: F.call_function("shiftright", k, F.col("bits"))
    position = lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1).cast("int")
    rows = rows.withColumn("maybe", _same_as_neighbour(F.col("placed"), top)).drop("placed")
    window = lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2))
    rows = rows.withColumn("maybe", F.sort_array(F.transform("maybe", lambda k: F.struct(window(position(k)).alias("window"), position(k).alias("at"))))).drop("words")
    rows = rows.withColumn("found", F.sort_array(F.transform(_same_as_neighbour(F.col("maybe"), lambda x: x.getField("window")), lambda x: x.getField("at")))).drop("maybe")
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("words"))
    covered = F.aggregate("found", none, lambda acc, i: F.struct((i + 3).alias("end"), (acc["words"] + i + 3 - F.greatest(acc["end"], i)).alias("words")), lambda acc: acc["words"])
    rows = rows.withColumn("n_repeat_words", covered)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], *MEASURES)


@dataclass(frozen=True)
class Prior:
    """Beta prior of one rule: ``mean`` and ``strength`` in documents; no strength means that hosts do not differ."""

    mean: float
    strength: float | None

    def rate(self, failed: Column, n: Column) -> Column:
        if self.strength is None:
            return F.lit(self.mean)
        return (failed + F.lit(self.mean * self.strength)) / (n + F.lit(self.strength))


def fit_prior(k: int, n: float, n2: float, failed: float, f2n: float) -> Prior:
    """Moment estimate from ``k`` hosts of ``n`` documents in all, ``n2`` the sum of squared counts, ``f2n`` that of failures squared by count."""
    mean = failed / n if n else 0.0
    binomial = mean * (1.0 - mean)
    over = binomial * (n - n2 / n - (k - 1.0)) if n else 0.0
    spread = (f2n - n * mean * mean - binomial * (k - 1.0)) / over if over > 0.0 else 0.0
    if spread <= 0.0:
        return Prior(mean, None)
    return Prior(mean, (1.0 - spread) / spread if spread < 1.0 else 0.0)


def host_rates(measured: DataFrame, host_col: str) -> tuple[DataFrame, dict[str, Prior]]:
    """(host, n, one shrunk rate per rule, host_rule) for each host, and the priors.

    host_rule is the first rule whose rate exceeds REJECT_RATE, else null. One
    row of totals reaches the driver; hosts stay a table. Null is a host.
    """
    scratch = Scratch(measured.sparkSession)
    failed = {rule: F.count_if(F.expr(test)).alias(f"failed_{rule}") for rule, test in RULES.items()}
    hosts = scratch.table(measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *failed.values()), "hosts")
    count = F.col("n").cast("double")
    totals = [F.count("*").alias("k"), F.sum(count).alias("n"), F.sum(count * count).alias("n2")]
    for rule in RULES:
        f = F.col(f"failed_{rule}").cast("double")
        totals += [F.sum(f).alias(f"f_{rule}"), F.sum(f * f / count).alias(f"f2n_{rule}")]
    row = hosts.agg(*totals).first()
    priors = {rule: fit_prior(row["k"], row["n"] or 0.0, row["n2"] or 0.0, row[f"f_{rule}"] or 0.0, row[f"f2n_{rule}"] or 0.0) for rule in RULES}
    rates = {rule: prior.rate(F.col(f"failed_{rule}"), count) for rule, prior in priors.items()}
    verdict = F.coalesce(*[F.when(rate > REJECT_RATE, F.lit(rule)) for rule, rate in rates.items()])
    return hosts.select("host", "n", *[rate.alias(f"rate_{rule}") for rule, rate in rates.items()], verdict.alias("host_rule")), priors


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures, base_failed, host_rule and kept of every document.

    base_failed: a base rule (fewer than 50 words, more than half of them in
    repeated windows) fails. kept: base_failed is false and the host passes.
    Other rules count against the host alone. Null and empty texts fail; null is
    a host of its own; repeated rows are documents each; a very long text costs
    n log n in its words; an empty table gives an empty one; columns other than
    the three named are not read, so their names cannot clash.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    measured = scratch.table(measure(own), "measures")
    hosts, _ = host_rates(measured, "host")
    # nulls get a name of their own, so that joins are plain equalities
    named = lambda df: df.withColumn("host", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("null")))
    hosts = scratch.table(named(hosts).select("host", "n", "host_rule"), "verdicts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * SHIPPED_HOSTS >= total
    rows, common = named(measured), hosts.where(frequent).drop("n")
    judged = rows.join(F.broadcast(common), "host")
    scarce = hosts.where(~frequent).select("host", "host_rule")
    if scarce.take(1):
        judged = judged.unionByName(rows.join(F.broadcast(common), "host", "left_anti").join(scarce, "host"))
    base = F.expr(" or ".join(f"({RULES[r]})" for r in BASE))
    judged = judged.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("host_rule").isNull())
    return judged.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "host_rule", "kept")
