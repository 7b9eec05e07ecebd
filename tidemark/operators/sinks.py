"""Snapshots of several tables, committed at once by a manifest, and skipped if nothing changed.

Each table goes to a folder of its own that is never written again; the manifest that names the folders is the
commit point, written last. Readers follow the newest manifest, so they never see half a commit, and a commit
that failed leaves only folders that nothing names.

A table may be committed by its key. Then its rows are dealt into buckets by a hash of the key, each with a hash of
its content, and the table's hash is that of its buckets' in order: a tree of two levels. A commit compares them with
the last manifest's and writes the buckets that differ; the others stay where an earlier commit put them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Buckets of a table that is committed by its key, as long as it isn't given another number.
BUCKETS = 64


def _sums(df: DataFrame) -> list[Column]:
    """The count and sums over row hashes, which depend on the rows alone and not on their order."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return [F.count("*").alias("n"), *(F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5))]


def bucket_of(keys: list[str], buckets: int) -> Column:
    """A row's bucket: of its key alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_hashes(df: DataFrame, keys: list[str], buckets: int) -> dict[int, str]:
    """The content hash of each bucket that has rows; one small row for each bucket comes to the driver."""
    rows = df.groupBy(bucket_of(keys, buckets).alias("_bucket")).agg(*_sums(df)).collect()
    return {r["_bucket"]: "|".join(str(x) for x in r[1:]) for r in rows}


def _root(hashes: dict[str, str]) -> str:
    """A table's hash: that of its buckets' in order."""
    return hashlib.sha256("\n".join(f"{b} {hashes[b]}" for b in sorted(hashes, key=int)).encode()).hexdigest()


def schema_text(df: DataFrame) -> str:
    return ",".join(sorted(f"{c}:{t}" for c, t in df.dtypes))


def content_hash(df: DataFrame) -> str:
    """Equal for tables with equal rows in any order: the count, and sums over row hashes; one small row at the end."""
    return f"{schema_text(df)}|" + "|".join(str(x) for x in df.agg(*_sums(df)).first())


def json_document(df: DataFrame, keys: list[str]) -> str:
    """A small table as one JSON text: rows ordered by keys, fields sorted, two spaces of indent, a line end.

    For reports that people read; large tables go to Parquet.
    """
    rows = [json.loads(r[0]) for r in df.orderBy(*keys).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).collect()]
    return json.dumps(rows, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


class Snapshots:
    """Committed versions of named tables under a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """The newest manifest: version, and folder and hash by table; empty before the first commit."""
        fs, folder = self._fs(f"{self.base}/manifests")
        if not fs.exists(folder):
            return {"version": 0, "tables": {}}
        newest = max((x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")), default=None)
        if newest is None:
            return {"version": 0, "tables": {}}
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.base}/manifests/{newest}", wholetext=True).collect())
        return json.loads(text)

    def read(self, name: str, schema=None) -> DataFrame:
        """The committed table; an empty one with the schema if there is none."""
        entry = self.manifest()["tables"].get(name)
        if entry is None:
            if schema is None:
                raise ValueError(f"no committed table {name}")
            return self.spark.createDataFrame([], schema)
        if "buckets" in entry:
            return self._folders(entry["buckets"], T.StructType.fromJson(entry["types"]))
        return self.spark.read.parquet(f"{self.base}/{entry['folder']}")

    def commit(self, keys: dict[str, list[str]] | None = None, buckets: int = BUCKETS, **tables: DataFrame) -> list[str]:
        """Write the tables whose rows changed and commit them together; their names.

        keys: for tables that are committed by key, its columns; of these only the buckets that changed are written.
        """
        old = self.manifest()
        entries, changed = dict(old["tables"]), []
        for name, df in tables.items():
            entry = self._by_key(name, df, keys[name], buckets, entries.get(name)) if name in (keys or {}) else self._whole(name, df, entries.get(name))
            if entry is not None:
                entries[name] = entry
                changed.append(name)
        if changed:
            version = old["version"] + 1
            self._publish(f"{self.base}/manifests/{version:012d}.json", json.dumps({"version": version, "tables": entries}, sort_keys=True))
        return changed

    def upsert(self, name: str, rows: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> bool:
        """Merge rows into a table by key, and commit it; whether anything changed.

        Only buckets that a row falls into are read and perhaps written, so this costs what they hold, not what the table does.
        merge: `(stored, new) -> rows`, of the columns of `rows`, and with the keys that either has.
        """
        old = self.manifest()
        entry = old["tables"].get(name)
        if entry is not None and (entry.get("keys") != keys or entry.get("schema") != schema_text(rows)):
            raise ValueError(f"table {name} is committed by other keys or with other columns")
        buckets = entry["count"] if entry else buckets
        hit = [str(r[0]) for r in rows.select(bucket_of(keys, buckets)).distinct().collect()]
        there = {b: x for b, x in (entry["buckets"] if entry else {}).items() if b in hit}
        types = T.StructType.fromJson(entry["types"]) if entry else rows.schema
        stored = self._folders(there, types)
        found = self._by_key(name, merge(stored, rows).select(*rows.columns), keys, buckets, {**entry, "buckets": there, "hash": None} if entry else None)
        new = {**(entry["buckets"] if entry else {}), **found["buckets"]}
        if entry is not None and new == entry["buckets"]:
            return False
        entries = {**old["tables"], name: {**found, "buckets": new, "hash": _root({b: x["hash"] for b, x in new.items()})}}
        version = old["version"] + 1
        self._publish(f"{self.base}/manifests/{version:012d}.json", json.dumps({"version": version, "tables": entries}, sort_keys=True))
        return True

    def look_up(self, name: str, rows: DataFrame) -> DataFrame:
        """The table's rows with a key that `rows` has; only these keys' buckets are read."""
        entry = self.manifest()["tables"][name]
        hit = [str(r[0]) for r in rows.select(bucket_of(entry["keys"], entry["count"])).distinct().collect()]
        found = self._folders({b: x for b, x in entry["buckets"].items() if b in hit}, T.StructType.fromJson(entry["types"]))
        return found.join(rows.select(*entry["keys"]).distinct(), entry["keys"], "left_semi")

    def _folders(self, buckets: dict, types: T.StructType) -> DataFrame:
        folders = sorted({f"{self.base}/{b['folder']}" for b in buckets.values()})
        return self.spark.read.schema(types).parquet(*folders) if folders else self.spark.createDataFrame([], types)

    def _whole(self, name: str, df: DataFrame, old: dict | None) -> dict | None:
        """A table's new entry, written; None if nothing changed."""
        digest = content_hash(df)
        if (old or {}).get("hash") == digest:
            return None
        folder = f"tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.base}/{folder}")
        return {"folder": folder, "hash": digest}

    def _by_key(self, name: str, df: DataFrame, keys: list[str], buckets: int, old: dict | None) -> dict | None:
        """The same, of a table by buckets: a bucket is a folder of a commit, and an entry names one for each."""
        same = old is not None and old.get("keys") == keys and old.get("count") == buckets and old.get("schema") == schema_text(df)
        before = old["buckets"] if same else {}
        hashes = {str(b): h for b, h in bucket_hashes(df, keys, buckets).items()}
        root = _root(hashes)
        if same and old["hash"] == root:
            return None
        moved = [b for b, h in hashes.items() if before.get(b, {}).get("hash") != h]
        folder = f"tables/{name}-{uuid.uuid4().hex}"
        if moved:
            rows = df.withColumn("_bucket", bucket_of(keys, buckets)).where(F.col("_bucket").isin([int(b) for b in moved]))
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.base}/{folder}")
        kept = {b: before[b] if b not in moved else {"hash": h, "folder": f"{folder}/_bucket={b}"} for b, h in hashes.items()}
        return {"buckets": kept, "hash": root, "keys": keys, "count": buckets, "schema": schema_text(df), "types": json.loads(df.schema.json())}

    def _publish(self, path: str, text: str) -> None:
        """Write beside and rename. On stores whose rename is atomic and fails onto an existing file, as HDFS's is, two writers
        can't both commit a version; elsewhere (object stores, local disks) commits need one writer at a time."""
        fs, target = self._fs(path)
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version is already committed: {path}")
