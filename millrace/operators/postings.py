"""A stored token index: postings in buckets by token, refreshed by document (M1, M5).

folder/g=<n>/postings/bucket=<b> holds (id, token, field, positions) of the documents written with
generation n, folder/g=<n>/documents their (id, len), len being null for deleted ones. Of a document
the newest generation counts. A search reads the buckets of its words and the documents, no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import names_in
from .search import _tokens


@dataclass(frozen=True)
class PostingIndex:
    """An index of text fields of documents named by one id column; `buckets` must stay the same for a folder."""

    spark: SparkSession
    folder: str
    id_col: str
    fields: list[str]
    buckets: int = 64

    def generations(self) -> list[int]:
        """The complete generations; one that was not finished has no list of documents and is passed over."""
        found = sorted(int(g[2:]) for g in names_in(self.spark, self.folder) if g.startswith("g="))
        return [g for g in found if "_SUCCESS" in names_in(self.spark, f"{self.folder}/g={g}/documents")]

    def write(self, df: DataFrame) -> None:
        """Index a whole table; whatever the folder holds is replaced for readers."""
        self._add(df, None, whole=True)

    def refresh(self, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        """Index changed and new documents again and forget deleted ones (a table with the id column); other documents are not read."""
        self._add(changed, deleted, whole=False)

    def _add(self, df: DataFrame, deleted: DataFrame | None, whole: bool) -> None:
        every = [int(g[2:]) for g in names_in(self.spark, self.folder) if g.startswith("g=")]
        here = f"{self.folder}/g={max(every, default=-1) + 1}"
        parts = F.array(*[F.struct(F.lit(f).alias("field"), _tokens(F.col(f)).alias("t")) for f in self.fields])
        rows = df.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).alias("id"), parts.alias("p"))
        tokens = rows.select("id", F.explode("p").alias("p")).select("id", "p.field", F.posexplode("p.t").alias("pos", "token"))
        posting = tokens.groupBy("token", "field", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")
        # A bucket's rows lie together by token, so that row groups without a word are passed over; frequent tokens are split.
        spread = posting.withColumn("bucket", bucket).repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(8)))
        spread.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{here}/postings")
        length = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + F.size(p["t"]))
        docs = rows.groupBy("id").agg(F.sum(length).alias("len")).withColumn("whole", F.lit(whole))
        if deleted is not None:
            gone = deleted.select(F.col(self.id_col).alias("id")).where("id IS NOT NULL").distinct().join(docs.select("id"), "id", "left_anti")
            docs = docs.unionByName(gone.select("id", F.lit(None).cast("long").alias("len"), F.lit(False).alias("whole")))
        docs.write.mode("overwrite").parquet(f"{here}/documents")  # last: it makes the generation count

    def documents(self) -> DataFrame:
        """(id, g, len) of the documents that the index holds, with their newest generation."""
        gens = self.generations()
        if not gens:
            raise FileNotFoundError(f"no index in {self.folder}")
        parts = [self.spark.read.parquet(f"{self.folder}/g={g}/documents").withColumn("g", F.lit(g)) for g in gens]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        newest = rows.groupBy("id").agg(F.max("g").alias("g"), F.max_by("len", "g").alias("len"))
        start = max((g for g, part in zip(gens, parts, strict=True) if not part.where("whole").isEmpty()), default=gens[0])
        return newest.where((F.col("g") >= start) & F.col("len").isNotNull())

    def select(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """((id, field, pos, token) of the terms, (id, len) of all documents with a token), for the searches of `search`.

        Only the buckets of the terms are listed and read.
        """
        docs = self.documents()
        hashes = self.spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "token string")
        wanted = sorted({r.b for r in hashes.select(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int").alias("b")).collect()})
        kind = docs.schema["id"].dataType.simpleString()
        schema = f"token string, field string, id {kind}, positions array<int>"
        found = self.spark.createDataFrame([], f"{schema}, g int")
        for g in self.generations():
            there = set(names_in(self.spark, f"{self.folder}/g={g}/postings"))
            if paths := [f"{self.folder}/g={g}/postings/bucket={b}" for b in wanted if f"bucket={b}" in there]:
                found = found.unionByName(self.spark.read.schema(schema).parquet(*paths).withColumn("g", F.lit(g)))
        rows = found.where(F.col("token").isin(*terms)).join(docs.select("id", "g"), ["id", "g"])
        rows = rows.select(F.col("id").alias(self.id_col), "field", F.explode("positions").alias("pos"), "token")
        return rows, docs.where("len > 0").select(F.col("id").alias(self.id_col), "len")
