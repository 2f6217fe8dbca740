"""A store directory: append-only ledger parts, immutable graph snapshots, audit parts and a manifest.

Every change publishes the next manifest by renaming a complete file into place; a reader uses one manifest from
beginning to end.  The manifest says what the directory is and in which schema version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from chronolith.operators.maintenance import AUDIT_SCHEMA
from chronolith.runtime import publish_once
from chronolith.sources.ledger import LEDGER_SCHEMA

APPLICATION, SCHEMA_VERSION = "chronolith-store", 2
NODE_SCHEMA = (
    "id string, tenant_id string, project_id string, environment_id string, kind string, text string, canonical_key string, created_at_unix_ms long, updated_at_unix_ms long, "
    "valid_from_unix_ms long, valid_to_unix_ms long, valid_to_event_id long, confidence double, token_estimate int, observation_count int"
)
EDGE_SCHEMA = "id long, tenant_id string, project_id string, environment_id string, from_node_id string, to_node_id string, kind string, weight double, created_at_unix_ms long, source_event_id long"
SPAN_SCHEMA = "node_id string, tenant_id string, project_id string, trace_id string, span_id string, seq long"
BATCH_SCHEMA = "id long, ledger_event_id long, distiller_kind string, distiller_fingerprint string, memories string, created_at_unix_ms long"
MARK_SCHEMA = "ledger_event_id long, projected_at_unix_ms long"
SCHEMAS = {"projected": MARK_SCHEMA, "ledger": LEDGER_SCHEMA, "nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA, "spans": SPAN_SCHEMA, "audit": AUDIT_SCHEMA, "batches": BATCH_SCHEMA}


class StoreError(ValueError):
    """The directory is no store, or one of another version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = self._load()
        self._migrate()

    # -- files ------------------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> dict:
        folder, fs = self._path("_manifests")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if fs.exists(folder) else []
        if not names:
            root, fs = self._path("")
            if fs.exists(root) and any(not f.getPath().getName().startswith((".", "_")) for f in fs.listStatus(root)):
                raise StoreError(f"{self.root} holds files but no manifest")
            return {"application": APPLICATION, "schema_version": SCHEMA_VERSION, "version": 0, "parts": {}, "next_id": 1, "projected": []}
        path, fs = self._path(f"_manifests/{names[-1]}")
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found.get("application") != APPLICATION:
            raise StoreError(f"{self.root} belongs to {found.get('application')!r}")
        if found["schema_version"] > SCHEMA_VERSION:
            raise StoreError(f"{self.root} has schema version {found['schema_version']}; this is {SCHEMA_VERSION}")
        return found

    def _migrate(self) -> None:
        """Bring an older store to this version: version 1 knew only the last event that was projected, version 2 marks every one."""
        if self.manifest["schema_version"] < 2:
            top = self.manifest.get("projected_to", 0)
            self.manifest = {k: v for k, v in self.manifest.items() if k != "projected_to"} | {"schema_version": 2}
            self.write(projected=self.read("ledger").filter(f"id <= {top}").selectExpr("id AS ledger_event_id", "cast(0 AS bigint) AS projected_at_unix_ms"))

    def publish(self, **changes) -> None:
        new = self.manifest | changes | {"version": self.manifest["version"] + 1}
        if not publish_once(self.spark, f"{self.root}/_manifests/{new['version']:010d}.json", json.dumps(new)):
            raise StoreError(f"another writer published version {new['version']}")
        self.manifest = new

    # -- tables ------------------------------------------------------------------------
    def read(self, table: str) -> DataFrame:
        parts = self.manifest["parts"].get(table, [])
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{p}" for p in parts])

    def write(self, replace: bool | set[str] = False, **tables: DataFrame) -> None:
        """Write parts and publish them together, after those that are there or, all of them or the named ones, instead of them."""
        parts = dict(self.manifest["parts"])
        for name, df in tables.items():
            part = f"{name}/{self.manifest['version'] + 1:010d}"
            df.write.mode("overwrite").parquet(f"{self.root}/{part}")
            instead = replace if isinstance(replace, bool) else name in replace
            parts[name] = [part] if instead else [*parts.get(name, []), part]
        self.publish(parts=parts)

    def compact(self, table: str, files: int | None = None) -> None:
        """Rewrite the parts of a table as one."""
        df = self.read(table)
        self.write(replace=True, **{table: df.coalesce(files) if files else df})

    def backup(self, target: str) -> None:
        """Copy all parts of the current manifest; refuses a directory that exists."""
        dest = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        conf = self.spark._jsc.hadoopConfiguration()
        to = dest.getFileSystem(conf)
        if to.exists(dest):
            raise StoreError(f"{target} exists already")
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        for part in [p for ps in self.manifest["parts"].values() for p in ps]:
            source, fs = self._path(part)
            util.copy(fs, source, to, self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{part}"), False, conf)
        copy = Store.__new__(Store)
        copy.spark, copy.root, copy.manifest = self.spark, target.rstrip("/"), dict(self.manifest)
        copy.publish()

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str) -> "Store":
        """A store from a backup, checked before it is copied."""
        cls(spark, source).backup(root)
        return cls(spark, root)

    def health(self) -> dict:
        from chronolith.operators.maintenance import integrity
        from chronolith.operators.retrieve import cue_index

        nodes = self.read("nodes")
        found = {r["metric"]: r["value"] for r in integrity(nodes, self.read("edges"), self.read("spans"), cue_index(nodes)).collect()}
        return {"application": self.manifest["application"], "schema_version": self.manifest["schema_version"], "version": self.manifest["version"], "integrity": found, "clean": not any(found.values())}
