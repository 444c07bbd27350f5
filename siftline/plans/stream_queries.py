"""Queries that run real streams over the driver's tables, in steps with restarts between them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import text_index
from ..operators.graph import shared_folder
from ..sources import paged
from ..streaming import keyed, merge
from . import table_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """As in table_queries, registered here."""

    def add(f):
        table_queries.query(sql)(f)
        QUERIES[f.__name__] = table_queries.QUERIES.pop(f.__name__)
        if sql:
            ORACLES[f.__name__] = table_queries.ORACLES.pop(f.__name__)
        return f

    return add


ROUNDS = """SELECT finding_id, CAST(round AS INT) AS round, CASE tokens % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' ELSE 'needs_review' END AS verdict, confidence, (tokens % 50) / 100.0e0 AS attack, (tokens * 7 % 50) / 100.0e0 AS defence,
  CASE WHEN role = 'user' THEN concat('a', CAST(tokens % 2 AS STRING)) END AS attacker, CASE WHEN role = 'assistant' THEN concat('d', CAST(tokens % 2 AS STRING)) END AS defender, CAST(tokens * 40 AS BIGINT) AS tokens FROM debate"""
SIDE = "count(*) FILTER (WHERE {0} IS NOT NULL AND NOT fresh_{0}) OVER w - coalesce(max(old_{0}) FILTER (WHERE fresh_{0}) OVER w, 0) AS stable_{0}"
DECISIONS = f"""WITH d AS ({ROUNDS}), n AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY round) AS n, row_number() OVER (PARTITION BY finding_id, attacker ORDER BY round) = 1 AS fresh_attacker, row_number() OVER (PARTITION BY finding_id, defender ORDER BY round) = 1 AS fresh_defender FROM d),
  o AS (SELECT *, count(*) FILTER (WHERE attacker IS NOT NULL AND NOT fresh_attacker) OVER w AS old_attacker, count(*) FILTER (WHERE defender IS NOT NULL AND NOT fresh_defender) OVER w AS old_defender FROM n WHERE round = n - 1 WINDOW w AS (PARTITION BY finding_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, sum(tokens) OVER w AS spent, lag(confidence, 1) OVER w AS c1, lag(confidence, 2) OVER w AS c2, {SIDE.format('attacker').replace('WHERE fresh_attacker', 'WHERE attacker IS NOT NULL AND fresh_attacker')}, {SIDE.format('defender').replace('WHERE fresh_defender', 'WHERE defender IS NOT NULL AND fresh_defender')} FROM o WINDOW w AS (PARTITION BY finding_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT *, CASE WHEN n >= 5 THEN 'max_rounds' WHEN confidence >= 0.85e0 THEN 'high_confidence' WHEN verdict IN ('confirmed', 'false_positive') AND confidence >= 0.7e0 AND abs(attack - defence) >= 0.3e0 THEN 'decisive_verdict' WHEN abs(attack - defence) >= 0.35e0 THEN 'strength_gap'
    WHEN stable_attacker >= 2 AND stable_defender >= 2 THEN 'strategy_stable' WHEN n >= 3 AND greatest(confidence, c1) <= c2 + 0.05e0 THEN 'no_progress' WHEN spent >= 50000 THEN 'cost_limit' END AS reason FROM s)
  SELECT finding_id, round, CAST(n AS INT) AS n, reason IS NOT NULL AS ended, reason, CAST(spent AS BIGINT) AS tokens FROM (SELECT *, min(CASE WHEN reason IS NOT NULL THEN n END) OVER (PARTITION BY finding_id) AS last FROM r) WHERE last IS NULL OR n <= last"""


@query(DECISIONS)
def str5_str6_debate_stream(t):
    """Rounds arrive in three steps, in no order; decisions come per round from keyed state."""
    debate = t("debate")
    rounds = debate.sparkSession.sql(ROUNDS.replace("FROM debate", "FROM {debate}"), debate=debate)
    step = F.pmod(F.xxhash64("finding_id", "round"), F.lit(3))
    return keyed.run_steps([rounds.where(step == k) for k in range(3)], keyed.debate_decisions, idle_batches=False)


PER, FULL = 43_200_000_000, 3 * 43_200_000_000
LEFT = f"least({FULL}, b.level + r.us - b.us)"


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  b(user_id, n, event_id, us, allowed, level) AS (SELECT user_id, n, event_id, us, TRUE, CAST({FULL - PER} AS BIGINT) FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.event_id, r.us, {LEFT} >= {PER}, CAST({LEFT} - CASE WHEN {LEFT} >= {PER} THEN {PER} ELSE 0 END AS BIGINT) FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1)
  SELECT user_id, event_id, allowed, CAST(floor(level / {PER}) AS BIGINT) AS left FROM b""".replace(" AS left FROM b", ' AS "left" FROM b'))
def str7_bucket_stream(t):
    """A token every twelve hours, three at most, by the events' own times; four steps in order of time."""
    return keyed.run_steps(keyed.in_order(t("events"), "ts", 4), lambda s: keyed.token_bucket_stream(s, 1 / 43_200, 3, "user_id", "ts", "event_id"))


@query("""WITH p AS (SELECT *, event_type IN ('signup', 'purchase') AS put FROM events), w AS (SELECT *, last_value(CASE WHEN put THEN event_id END IGNORE NULLS) OVER o AS source, last_value(CASE WHEN put THEN ts END IGNORE NULLS) OVER o AS stored FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT user_id, event_id, CASE WHEN put THEN 'put' WHEN ts <= stored + INTERVAL 6 HOUR THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN ts <= stored + INTERVAL 6 HOUR THEN source END AS source FROM w""")
def snk5_str9_cache_stream(t):
    """Signups and purchases put, other events get, entries live six hours; four steps in order of time."""
    events = t("events").withColumn("put", F.col("event_type").isin("signup", "purchase"))
    out = keyed.run_steps(keyed.in_order(events, "ts", 4), lambda s: keyed.cache_stream(s, 6 * 3600, "user_id", "ts", "event_id", "put"))
    return out.where("outcome <> 'expired'")


WINDOW, PAGE = 120, 500
PAGED = f"""WITH w AS (SELECT *, min(published) OVER () AS lo FROM cves), k AS (SELECT *, CAST(floor((published - lo) / {WINDOW}) AS INT) AS k FROM w)
  SELECT cve_id, CAST(lo + k * {WINDOW} + {WINDOW - 1} AS DATE) AS window_end, CAST(floor((row_number() OVER (PARTITION BY k ORDER BY published, cve_id) - 1) / {PAGE}) * {PAGE} AS BIGINT) AS start_index, description, severity FROM k"""


def _feed(t, parts: int, read):
    """Publish the store as a feed in ``parts`` lots of windows below the shared folder; after each lot ``read`` is called."""
    cves = t("cves")
    folder = f"{shared_folder(cves.sparkSession)}/siftline-feed-{uuid.uuid4().hex}"
    first, last = cves.agg(F.min("published"), F.max("published")).first()
    document = F.to_json(F.struct(F.concat(F.lit("CVE-"), F.col("cve_id").cast("string")).alias("id"), "description", "severity"))
    records = cves.select("published", "cve_id", document.alias("document"))
    # whole windows to a lot
    windows = (last - first).days // WINDOW + 1
    lot = F.floor(F.floor(F.datediff("published", F.lit(first)) / WINDOW) * parts / windows)
    for k in range(parts):
        paged.publish(records.where(lot == k), folder, "published", "cve_id", "document", first, WINDOW, PAGE)
        out = read(folder)
    value = F.from_json("document", "id string, description string, severity string")
    cve = F.col("v.id").substr(5, 20).cast("bigint").alias("cve_id")
    return out.select("window_end", "start_index", value.alias("v")).select(cve, "window_end", "start_index", "v.description", "v.severity")


@query(PAGED)
def src13_paged_feed(t):
    """Every page of every window as a partition of one table."""
    spark = t("cves").sparkSession
    return _feed(t, 1, lambda folder: paged.feed(spark, folder))


@query(PAGED)
def str2_feed_stream(t):
    """The same feed published in three lots; after each a stream starts from its checkpoint and reads the new windows only."""
    spark = t("cves").sparkSession

    def read(folder: str):
        query = paged.feed(spark, folder, streaming=True).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{folder}-out")

    return _feed(t, 3, read)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def snk1_snk2_merge_stream(t):
    """A store of the last event of each user, merged by buckets from a stream in three steps that are not in order."""
    events = t("events").select("user_id", "event_id", "event_type", "value")
    spark = events.sparkSession
    root = f"{shared_folder(spark)}/siftline-merge-{uuid.uuid4().hex}"
    table = merge.MergedTable(spark, f"{root}/table", "user_id", "event_id")
    for k in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.parquet(f"{root}/in/step{k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in/step*")
        stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("user_id", "event_id", "event_type", "value")


@query(
    r"""WITH d AS (SELECT doc_id, regexp_split_to_array(lower(CASE WHEN doc_id % 10 = 3 THEN concat('That of ', text) ELSE text END), '[^\p{L}\p{N}]+') AS words FROM documents)
  SELECT doc_id, CAST(len(list_filter(words, lambda x: x = 'that')) + len(list_filter(words, lambda x: x = 'of')) AS BIGINT) AS score FROM d WHERE list_contains(words, 'that') AND list_contains(words, 'of')"""
)
def flt7_stored_index(t):
    """All documents indexed, a tenth of them again with a new text, then searched for two words."""
    docs = t("documents").select("doc_id", "text")
    spark = docs.sparkSession
    index = text_index.TextIndex(spark, f"{shared_folder(spark)}/siftline-index-{uuid.uuid4().hex}", "doc_id", "text")
    index.add(docs, 0)
    index.add(docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("That of "), "text")), 1)
    return index.search("of That").select("doc_id", "score")
