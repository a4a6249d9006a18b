"""Incremental ingest: each micro-batch of observations is compared with what is stored, then stored."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import reconcile as R
from factloom.sources.tables import shared_folder

#: Folders over which stored observations are spread by entity; a batch reads those of its entities alone.
PARTS = 32
EDGES = "id string, observation_a string, observation_b string, verdict string, relationship_type string, confidence double, batch_a int, batch_b int"


def new_documents(documents: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to extract, to reconcile again): documents by whether their file_hash is known; those without one are new."""
    hashes = known.where("file_hash is not null").select("file_hash").distinct()
    again = documents.join(hashes, "file_hash", "left_semi")
    return documents.join(hashes, "file_hash", "left_anti").select(*documents.columns), again.select(*documents.columns)


class IncrementalStore:
    """Observations and relationships in a folder, extended by micro-batches.

    Observations are stored prepared, as the gate and the cascade need them, so no batch prepares old rows
    again.  A row like the one stored of its id is dropped; another one replaces it, and with it its
    relationships, which hold for the versions of the ends they were found with.  New rows are compared with
    each other and with stored ones, so each pair is judged once, whatever the order of arrival.  A batch that
    runs again after a failure overwrites its own output.
    """

    def __init__(self, spark: SparkSession, entities: DataFrame, concepts: DataFrame, folder: str | None = None) -> None:
        self.spark, self.entities, self.concepts = spark, entities, concepts
        self.folder = folder or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        self.schema = None
        self.batches: list[int] = []

    def _read(self, numbers: list[int]) -> DataFrame | None:
        if not numbers:
            return None
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/observations/{k}").withColumn("batch", F.lit(k)) for k in numbers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _versions(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.max(F.struct("batch", "content")).alias("v")).select("id", "v.batch", "v.content")

    def add(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        ready = R.prepare(R.with_names(R.latest(batch), self.entities, self.concepts))
        content = F.xxhash64(*(c for c in ready.columns if c != "id"))
        ready = ready.withColumns({"content": content, "part": F.pmod(F.xxhash64("entity_id"), F.lit(PARTS)).cast("int")})
        if self.schema is None:
            self.schema = ready.schema
        before = [k for k in self.batches if k < number]
        stored = self._read(before)
        if stored is not None:
            ready = ready.join(self._versions(stored).select("id", "content"), ["id", "content"], "left_anti").select(*ready.columns)
        ready.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/observations/{number}")
        fresh = self._read([number])
        ends = lambda s: F.lit(number).alias(f"batch_{s}")
        edges = self._edges(R.reconcile(fresh.drop("batch")), ends("a"), ends("b"))
        if stored is not None:
            parts = [r[0] for r in fresh.select("part").distinct().collect()]  # at most PARTS
            near = stored.where(F.col("part").isin(parts))
            current = near.join(self._versions(near).select("id", "batch"), ["id", "batch"], "left_semi").join(fresh.select("id"), "id", "left_anti")
            found = R.reconcile(current.select(*fresh.columns).drop("batch"), left=fresh.drop("batch"))
            version = current.select(F.col("id").alias("observation_b"), F.col("batch").alias("batch_b"))
            edges = edges.unionByName(self._edges(found.join(version, "observation_b"), ends("a"), F.col("batch_b")))
        edges.write.mode("overwrite").parquet(f"{self.folder}/relationships/{number}")
        if number not in self.batches:
            self.batches.append(number)

    def _edges(self, found: DataFrame, a: Column, b: Column) -> DataFrame:
        return found.select("id", "observation_a", "observation_b", "verdict", "relationship_type", "confidence", a, b)

    def run(self, stream: DataFrame) -> DataFrame:
        """Reads all that is available and returns the relationships."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.relationships()

    def observations(self) -> DataFrame:
        """The stored observations, the last version of each, prepared."""
        rows = self._read(self.batches)
        return rows.join(self._versions(rows).select("id", "batch"), ["id", "batch"], "left_semi")

    def relationships(self) -> DataFrame:
        """The relationships of the last versions of their ends."""
        edges = self.spark.read.schema(EDGES).parquet(*(f"{self.folder}/relationships/{k}" for k in self.batches))
        rows = self._read(self.batches).groupBy("id").agg(F.max("batch").alias("batch"))
        side = lambda s: rows.select(F.col("id").alias(f"observation_{s}"), F.col("batch").alias(f"batch_{s}"))
        return edges.join(side("a"), ["observation_a", "batch_a"], "left_semi").join(side("b"), ["observation_b", "batch_b"], "left_semi")
