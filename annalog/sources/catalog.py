"""The catalog of stores: a file for each name, published exclusively."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from annalog.sources.files import Files
from annalog.sources.log import now
from annalog.values import StoreInfo, store_name

SCHEMA = "store_id string, name string, created_at timestamp_ntz"


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)

    def create(self, name: str) -> StoreInfo | None:
        """The new store; None if the name is taken."""
        info = StoreInfo(uuid.uuid4().hex, store_name(name), now())
        text = json.dumps({"store_id": info.store_id, "name": info.name, "created_at": info.created_at.isoformat(timespec="microseconds")})
        return info if self.files.publish(f"stores/{name}.json", text) else None

    def find(self, name: str) -> StoreInfo | None:
        text = self.files.read(f"stores/{store_name(name)}.json")
        if text is None:
            return None
        x = json.loads(text)
        return StoreInfo(x["store_id"], x["name"], datetime.fromisoformat(x["created_at"]))

    def remove(self, name: str) -> StoreInfo | None:
        """Drop the entry, then all data; None if there was no such store."""
        info = self.find(name)
        if info is None or not self.files.delete(f"stores/{name}.json"):
            return None
        self.files.delete(f"logs/{info.store_id}")
        return info

    def stores(self) -> list[StoreInfo]:
        found = [self.find(n.removesuffix(".json")) for n in self.files.names("stores")]
        return [s for s in found if s]

    def frame(self) -> DataFrame:
        """(store_id, name, created_at) of each store."""
        return self.spark.createDataFrame([(s.store_id, s.name, s.created_at) for s in self.stores()], SCHEMA)
