"""A stored inverted index over texts: postings by term, kept up to date by batches.

A batch of new or changed texts becomes a segment: rows of (term, chunk) with
sorted document ids and term frequencies, dealt to folders by a hash of the
term and sorted by it. A chunk holds a bounded number of documents, so a frequent
term is many rows. A search opens the folders of its terms only, begins with the
rarest, and reads of every other term the chunks where candidates are left. The
documents themselves are a merged table that knows which segment of a document
counts; the texts are read only where no document holds all words.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.merge import MergedTable

SEPARATORS = r"[^\p{L}\p{N}]+"
#: Documents in a chunk, about.
CHUNK = 1 << 14


class TextIndex:
    """Index below ``path`` of the texts of documents with a whole number as ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "cve_id", text: str = "description", buckets: int = 64):
        self.spark, self.path, self.key, self.text, self.buckets = spark, path.rstrip("/"), key, text, buckets
        self.documents = MergedTable(spark, f"{self.path}/documents", key, "_segment", buckets=buckets)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, number: int) -> None:
        """Index a batch of documents, new ones or new texts of old ones; keys are unique in it. Batches are numbered upwards; one that runs again writes the same."""
        docs = docs.withColumn("_segment", F.lit(number))
        words = docs.select(F.col(self.key).cast("bigint").alias("id"), F.explode(F.split(F.lower(self.text), SEPARATORS)).alias("term")).where("term <> ''")
        chunks = max(1, -(-docs.count() // CHUNK))
        counted = words.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
        posted = counted.groupBy("term", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("p"))
        ids = F.transform("p", lambda x: x["id"])
        rows = posted.select("term", "chunk", F.size("p").alias("n"), ids.alias("ids"), F.transform("p", lambda x: x["tf"]).alias("tfs"), self._bucket(F.col("term")).alias("_bucket"))
        rows.repartition("_bucket").sortWithinPartitions("_bucket", "term", "chunk").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/postings/_segment={number}")
        self.documents.merge(docs, number)

    def _postings(self, terms: list[str]) -> DataFrame:
        wanted = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term"))).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("_bucket").isin(wanted) & F.col("term").isin(terms))

    def holders(self, query: str) -> DataFrame:
        """(key, score) of documents that hold all words of the query; the score is how often they do."""
        terms = sorted({w for w in query.lower().split() if w})
        none = self.spark.createDataFrame([], "id bigint, score bigint")
        system, root = fs.FileSystem.from_uri(self.path)
        if not terms or system.get_file_info(f"{root}/postings").type == fs.FileType.NotFound:
            return none.withColumnRenamed("id", self.key)
        postings = self._postings(terms)
        sizes = {r["term"]: r["n"] for r in postings.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(terms):
            return none.withColumnRenamed("id", self.key)
        out = None
        for term in sorted(terms, key=lambda w: (sizes[w], w)):
            rows = postings.where(F.col("term") == term)
            if out is not None:
                rows = rows.join(out.select("_segment", "chunk").distinct(), ["_segment", "chunk"], "left_semi")
            rows = rows.select("_segment", "chunk", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"))).alias("d")).select("_segment", "chunk", F.col("d.id").alias("id"), F.col("d.tf").cast("bigint").alias("tf"))
            if out is None:
                out = rows.withColumnRenamed("tf", "score")
            else:
                out = out.join(rows, ["_segment", "chunk", "id"]).select("_segment", "chunk", "id", (F.col("score") + F.col("tf")).alias("score"))
        current = self.documents.read().select(F.col(self.key).cast("bigint").alias("id"), "_segment")
        return out.join(current, ["id", "_segment"]).select(F.col("id").alias(self.key), "score")

    def search(self, query: str) -> DataFrame:
        """Documents that hold all words of the query with their score; if there is none, those that contain it as text, score 0."""
        docs = self.documents.read().drop("_segment")
        found = self.holders(query)
        if found.take(1):
            return docs.join(found, self.key)
        return docs.where(F.contains(F.lower(self.text), F.lit(query.lower()))).withColumn("score", F.lit(0).cast("bigint"))
