"""Threat-intelligence store: search, joins, enrichment and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from .phrases import holders, numbered


def search(docs: DataFrame, query: str, text: str = "description", key: str = "cve_id") -> DataFrame:
    """Rows whose words hold all words of ``query``; if there is none, rows that contain it as text."""
    words = sorted({w for w in query.lower().split() if w})
    # words are cut once a row, however many the query has
    has_all = F.size(F.array_intersect(terms(F.col(text)), F.array(*map(F.lit, words)))) == len(words) if words else F.lit(True)
    tagged = docs.withColumn("_exact", has_all).where(F.col("_exact") | F.contains(F.lower(text), F.lit(query.lower())))
    best = tagged.agg(F.bool_or("_exact").alias("_any"))
    return tagged.crossJoin(F.broadcast(best)).where(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def ranked(df: DataFrame, *order: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def pocs_of(cves: DataFrame, pocs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cve_id, poc_id, title, stars, verified) of CVEs that have one."""
    return mapping.join(pocs, "poc_id").join(cves.select("cve_id"), "cve_id", "left_semi").select("cve_id", "poc_id", "title", "stars", "verified")


def enrich(cves: DataFrame, kev: DataFrame) -> DataFrame:
    """CVEs with the exploited flag of a catalogue (cve_id, ransomware)."""
    known = kev.select("cve_id", F.lit(True).alias("_known"), "ransomware")
    return cves.join(known, "cve_id", "left").withColumn("kev", F.coalesce("_known", F.lit(False)) | F.col("kev")).withColumn("ransomware", F.coalesce("ransomware", F.lit(False))).drop("_known")


def statistics(cves: DataFrame) -> DataFrame:
    """One row of totals: a single pass."""
    return cves.agg(F.count("*").alias("cves"), F.count_if("kev").alias("kev"), F.count_if("has_poc").alias("with_poc"), F.count_if(F.col("cvss") >= 9.0).alias("critical_cvss"), F.round(F.avg("cvss"), 6).alias("mean_cvss"))


def staleness(last_sync: Column, as_of: Column, days: int = 7) -> Column:
    return F.when(last_sync.isNull(), "first_sync").when(F.datediff(as_of, last_sync) >= days, "update").otherwise("ok")


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(input_seq, cve_id) of dependencies inside an advisory's range.

    Versions and ranges meet once per distinct pair of a package, by
    :func:`versions_in_ranges`; rows of a dependency or an advisory meet the
    pairs afterwards. Versions or ranges that do not parse meet nothing; rows
    without a package neither; repeated rows are listed each.
    """
    return deps.join(_advised(deps, advisories), [*PACKAGE, "version"]).select("input_seq", "cve_id")


def exposure(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, cve_id, versions, first): how many rows :func:`vulnerable` has of an advisory in a package, and the least input_seq.

    Dependencies of one version are counted before they meet advisories, so no row of a pair is made.
    """
    counted = deps.groupBy(*PACKAGE, "version").agg(F.count("*").alias("n"), F.min("input_seq").alias("first"))
    met = counted.join(_advised(counted, advisories), [*PACKAGE, "version"])
    return met.groupBy(*PACKAGE, "cve_id").agg(F.sum("n").alias("versions"), F.min("first").alias("first"))


def _advised(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, version, cve_id): advisories of each distinct version; they meet before rows of dependencies do, which so are shuffled once."""
    pairs = versions_in_ranges(deps.select(*PACKAGE, "version"), advisories.select(*PACKAGE, "spec"))
    return pairs.join(advisories, [*PACKAGE, "spec"]).select(*PACKAGE, "version", "cve_id")


PACKAGE = ["ecosystem", "name"]
#: Bins of one node of the grid, and nodes: versions fall into GRID * GRID bins.
GRID = 16


def versions_in_ranges(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct (ecosystem, name, version, spec) of versions inside a range of their package.

    Versions are cut into bins at quantiles of all distinct ones. A version has
    two keys, its bin and the bin's node; a range has a key for every node and
    every bin that it covers whole, some 46 at most, where all versions are in
    it, and one for the bins of its ends, where versions are compared. So a
    package of many versions and many ranges is no product: what meets and is
    not kept shares the bin of an end.
    """
    from ..functions.versions import in_range, range_bounds, version_key, version_place

    seen = versions.distinct().withColumn("_place", version_place(version_key(F.col("version")))).where("_place is not null")
    steps = [k / GRID**2 for k in range(1, GRID**2)]
    cuts = seen.agg(F.percentile_approx("_place", _doubles(steps), 10_000).alias("cuts")).first()["cuts"] or []
    inner, outer = _doubles(cuts), _doubles(cuts[GRID - 1 :: GRID])

    def bin_of(place: Column) -> Column:
        # a value bound by a lambda is computed once, not at every cut
        node = lambda p: F.size(F.filter(outer, lambda c: c <= p))
        inside = lambda p, n: n * GRID + F.size(F.filter(F.slice(inner, n * GRID + 1, GRID - 1), lambda c: c <= p))
        return _bound(place, lambda p: _bound(node(p), lambda n: inside(p, n)))

    def node_of(index: Column) -> Column:
        return F.floor(index / GRID).cast("int")

    def keys_of(first: Column, last: Column) -> Column:
        begin, end = F.coalesce(first + 1, F.lit(0)), F.coalesce(last - 1, F.lit(GRID**2 - 1))
        covered = lambda n: (n * GRID >= begin) & (n * GRID + GRID - 1 <= end)
        nodes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(GRID - 1)), covered), lambda n: F.struct((-1 - n).alias("node"), F.lit(True).alias("sure")))
        loose = F.filter(F.sequence(F.lit(0), F.lit(GRID**2 - 1)), lambda b: (b >= begin) & (b <= end) & ~covered(node_of(b)))
        tested = F.array_distinct(F.array_compact(F.array(first, last)))
        return F.concat(nodes, F.transform(loose, lambda b: F.struct(b.alias("node"), F.lit(True).alias("sure"))), F.transform(tested, lambda b: F.struct(b.alias("node"), F.lit(False).alias("sure"))))

    placed = seen.select(*PACKAGE, "version", F.explode(_bound(bin_of(F.col("_place")), lambda b: F.array(b, -1 - node_of(b)))).alias("_node"))
    place = lambda end: version_place(F.coalesce(F.col("_r.exact"), F.col(f"_r.{end}")))
    ends = ranges.distinct().withColumn("_r", range_bounds(F.col("spec"))).select(*PACKAGE, "spec", place("min").alias("_low"), place("max").alias("_high")).where("_low is not null or _high is not null")
    bins = F.struct(bin_of(F.col("_low")).alias("first"), bin_of(F.col("_high")).alias("last"))
    keyed = ends.select(*PACKAGE, "spec", F.explode(_bound(bins, lambda r: keys_of(r["first"], r["last"]))).alias("_key")).select(*PACKAGE, "spec", F.col("_key.node").alias("_node"), F.col("_key.sure").alias("_sure"))
    met = placed.join(keyed, [*PACKAGE, "_node"])
    return met.where(F.col("_sure") | in_range(F.col("version"), F.col("spec"))).select(*PACKAGE, "version", "spec")


def _doubles(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>") if values else F.array().cast("array<double>")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once; null where it is null."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), use(v))), F.lit(0))


def recent(df: DataFrame, days: int, column: str = "published") -> DataFrame:
    """Rows of the last ``days`` days before the latest: its date is one row."""
    last = df.agg(F.max(column).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(column) >= F.date_sub("_last", days)).drop("_last")


def lookup(df: DataFrame, value, key: str = "cve_id") -> DataFrame:
    """The row of a key; the filter reaches the scan."""
    return df.where(F.col(key) == value)


def exploited_between(cves: DataFrame, first: str, last: str, vendor: str | None = None) -> DataFrame:
    """Exploited ones published from one date to another, of vendors whose name holds ``vendor``."""
    out = cves.where(F.col("kev") & F.col("published").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out.where(F.contains(F.lower(F.col("vendor").cast("string")), F.lit(vendor.lower()))) if vendor else out


def search_pocs(pocs: DataFrame, title: str | None = None, kind: str | None = None, platform: str | None = None) -> DataFrame:
    """Proofs of concept whose title, type or platform holds what is asked of it."""
    asked = [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (("title", title), ("poc_type", kind), ("platform", platform)) if v]
    wanted = F.lit(not asked)
    for a in asked:
        wanted = wanted | a
    return pocs.where(wanted)


def members(cves: DataFrame, listed: DataFrame, key: str = "cve_id") -> DataFrame:
    return cves.join(listed.select(key), key, "left_semi")


def not_yet_found(cves: DataFrame, found: DataFrame, key: str = "cve_id") -> DataFrame:
    return cves.join(found.select(key), key, "left_anti")


def vulnerability_statistics(cves: DataFrame) -> DataFrame:
    return cves.groupBy("severity").agg(F.count("*").alias("n"), F.count_if("kev").alias("kev"), F.countDistinct("vendor").alias("vendors"))


def most_common(df: DataFrame, column: str, limit: int, name: str | None = None) -> DataFrame:
    """The most frequent values with their counts; ties in order of value."""
    name = name or column
    return df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(limit)


def per_dependency(cves: DataFrame, key: str) -> DataFrame:
    """(key, n, has_kev, kev_ids): the ids of exploited ones, in order, joined; null where there is none."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kev"), F.col("cve_id")))), lambda x: x.cast("string")), ",")
    return cves.groupBy(key).agg(F.count("*").alias("n"), F.bool_or("kev").alias("has_kev"), F.nullif(ids, F.lit("")).alias("kev_ids"))


def relevant(deps: DataFrame, cves: DataFrame) -> DataFrame:
    """(input_seq, cve_id) of CVEs that concern a dependency.

    ``deps`` has input_seq, ecosystem, name and version; ``cves`` its key cve_id,
    description, products, ranges and from_advisory. An advisory names its
    product, so that is an equality. Else the name must stand in the description
    or a product. Go modules also count by their last part, Maven ones by their
    artifact. All names are sought at once, each distinct one once, by an
    automaton over the texts. A version that is known must lie in a range, if
    there are any.
    """
    from ..functions.versions import in_range

    own = F.lower("name")
    short = F.when(F.col("ecosystem") == "go", F.substring_index(own, "/", -1)).when(F.col("ecosystem") == "maven", F.substring_index(own, ":", -1))
    names = deps.select("input_seq", "version", F.explode(F.array_distinct(F.array_compact(F.array(own, short)))).alias("needle")).where("needle <> ''")
    met = mentions(cves, names.select("needle")).join(names, "needle").join(cves.select("cve_id", "ranges", "from_advisory", F.transform("products", lambda p: F.lower(p)).alias("products")), "cve_id")
    named = ~F.col("from_advisory") | F.array_contains("products", F.col("needle"))
    fits = F.col("version").isNull() | (F.col("version") == "*") | (F.size("ranges") <= 0) | F.exists("ranges", lambda r: in_range(F.col("version"), r))
    return met.where(named & fits).select("input_seq", "cve_id").distinct()


def mentions(cves: DataFrame, names: DataFrame) -> DataFrame:
    """(cve_id, needle): names, in lower case, that stand in the description or in one product, in any case."""
    library = numbered(names, "needle")
    # no name holds the character between the texts, so none is found across two
    text = F.concat_ws("\x00", F.lower("description"), F.transform("products", lambda p: F.lower(p)))
    return holders(cves.select("cve_id", text.alias("text")), library, "cve_id", "text", "needle").join(library, "phrase_id").select("cve_id", "needle")


def framework_cves(frameworks: DataFrame, cves: DataFrame) -> DataFrame:
    """(framework, cve_id) of CVEs whose description or products hold the framework's name."""
    named = frameworks.select("name", F.lower("name").alias("needle")).distinct()
    return mentions(cves, named).join(named, "needle").select(F.col("name").alias("framework"), "cve_id").distinct()


def read_through(wanted: DataFrame, local: DataFrame, feed: DataFrame, key: str = "cve_id") -> DataFrame:
    """Wanted rows from the store, from the feed where the store has none; ``origin`` tells which."""
    cols = [c for c in local.columns if c != key]
    a = local.select(key, F.struct(*cols).alias("_a"))
    b = feed.select(key, F.struct(*cols).alias("_b"))
    out = wanted.select(key).distinct().join(a, key, "left").join(b, key, "left").where("_a is not null or _b is not null")
    return out.select(key, F.when(F.col("_a").isNotNull(), "store").otherwise("feed").alias("origin"), F.coalesce("_a", "_b").alias("v")).select(key, "origin", "v.*")


def alias_lookup(entries: DataFrame, alias: str) -> DataFrame:
    return entries.where(F.array_contains("aliases", alias))


def security_summary(deps: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: dependencies, vulnerable ones, findings, and whether any is critical or exploited. ``hits`` has input_seq, severity and kev."""
    n = hits.agg(F.countDistinct("input_seq").alias("vulnerable"), F.count("*").alias("findings"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("has_critical"), F.coalesce(F.bool_or("kev"), F.lit(False)).alias("has_exploited"))
    return deps.agg(F.count("*").alias("dependencies")).crossJoin(n)
