"""A persisted catalog of deliveries: files of each entity with version, status and what they were merged into.

The catalog is a table in committed versions. Registering and merging read the last version and commit the next one; of two writers at
once the second one finds its number taken, reads again and repeats its change on top, so both are there and no version is given twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import Versions
from .manifest import catalog

FILES = "entity string, name string, arrived timestamp, rows long, version int, status string, canonical boolean, merged_into string"


class Catalog:
    def __init__(self, store: Versions, tries: int = 20):
        self.store, self.tries = store, tries

    def files(self, entity: str | None = None) -> DataFrame:
        """FILES rows, of one entity or all."""
        out = self.store.read("files") if self.store.versions() else self.store.spark.createDataFrame([], FILES)
        return out if entity is None else out.where(F.col("entity") == entity)

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        for _ in range(self.tries):
            try:
                self.store.commit({"files": change(self.files())})
                return self.files()
            except RuntimeError:  # another writer was first
                continue
        raise RuntimeError(f"no commit in {self.tries} tries")

    def register(self, deliveries: DataFrame) -> DataFrame:
        """Add deliveries (entity, name, arrived, rows): ACTIVE, with the entity's next versions in the order of arrival and name."""

        def change(known: DataFrame) -> DataFrame:
            placed = catalog(deliveries).select("entity", "name", "arrived", F.col("version").alias("place"))
            sizes = deliveries.groupBy("entity", "name", "arrived").agg(F.max("rows").alias("rows"))
            last = known.groupBy("entity").agg(F.max("version").alias("last"))
            new = placed.join(sizes, ["entity", "name", "arrived"]).join(last, "entity", "left")
            version = (F.coalesce("last", F.lit(0)) + F.col("place")).cast("int")
            none = F.lit(None).cast("string")
            return known.unionByName(new.select("entity", "name", "arrived", "rows", version.alias("version"), F.lit("ACTIVE").alias("status"), F.lit(False).alias("canonical"), none.alias("merged_into")))

        return self._change(change)

    def candidates(self) -> DataFrame:
        """(entity, files) of the entities with several files to merge."""
        live = self.files().where(F.col("status").isin("ACTIVE", "SUPERSEDED") & F.col("merged_into").isNull())
        return live.groupBy("entity").agg(F.count("*").alias("files")).where("files >= 2")

    def merged(self, entity: str, name: str, arrived, rows: int) -> DataFrame:
        """Record that an entity's files were merged into the file of this name: they are SUPERSEDED, it is MERGED_CONSOLIDATED."""

        def change(known: DataFrame) -> DataFrame:
            mine = (F.col("entity") == entity) & F.col("merged_into").isNull()
            old = known.withColumns({
                "status": F.when(mine, "SUPERSEDED").otherwise(F.col("status")), "canonical": F.col("canonical") & ~mine, "merged_into": F.when(mine, name).otherwise(F.col("merged_into")),
            })
            version = (known.where(F.col("entity") == entity).agg(F.max("version")).first()[0] or 0) + 1
            return old.unionByName(self.store.spark.createDataFrame([(entity, name, arrived, rows, version, "MERGED_CONSOLIDATED", True, None)], FILES))

        return self._change(change)
