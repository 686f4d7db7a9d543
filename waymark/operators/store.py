"""A store of Parquet tables. A version is a manifest that names, for each table, the folder of each bucket of its keys.

A commit writes new folders first and the manifest last, so the tables of a commit become visible together, a commit
that breaks off changes nothing, and a merge rewrites only the buckets that its batch touches. Tables of the layout
before manifests (a folder `v1`, `v2`, ... a table) are read too, until `migrate` or the first commit that replaces them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from .merge import keep_last_id

SCHEMAS = {
    "discoveries": schemas.DISCOVERIES, "targets": schemas.TARGETS, "routers": schemas.ROUTERS, "leasesets": schemas.LEASESETS,
    "transports": schemas.TRANSPORTS, "smoke": schemas.SMOKE,
}
#: The columns that deal a table's rows to buckets: the first that isn't empty. Other tables are one bucket.
KEYS = {"discoveries": ("ident_hash_hex", "i2p_dns_name"), "targets": ("ident_hash_hex", "i2p_dns_name"), "routers": ("ident_hash_hex",), "leasesets": ("ident_hash_hex",), "transports": ("ident_hash_hex",)}
#: What a column that a stored table lacks is filled with, by its name or its type; all others are null.
DEFAULTS = {"found_links": "[]", "flags": "[]", "string": "", "double": 0.0, "int": 0, "bigint": 0}
#: 1: a folder a version; 2: manifests, buckets, one row a hash and way of probing, transports, times of lease sets.
FORMAT = 2
MANIFESTS = "_manifests"


def bucket_of(table: str, buckets: int) -> Column:
    keys = [F.nullif(F.col(c), F.lit("")) for c in KEYS.get(table, ())]
    return F.pmod(F.xxhash64(F.coalesce(*keys, F.lit(""))), F.lit(buckets)).cast("int") if keys else F.lit(0)


class Store:
    """Tables under one folder, on any file system that Spark reads. One writer at a time: a commit fails if another one
    came between. buckets: of tables that are written for the first time."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self, path: str, end: str = "") -> list[int]:
        names = [n.removesuffix(end) for n in self._names(path) if n.endswith(end)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def versions(self) -> list[int]:
        return self._numbers(f"{self.folder}/{MANIFESTS}", ".json")

    def manifest(self, number: int | None = None) -> dict:
        """A version, the last one by default: format, and tables with their buckets (number to folder) and schemas."""
        found = self.versions()
        if number is None and not found:
            return {"number": 0, "format": FORMAT, "tables": {}, "batches": {}}
        fs, p = self._fs(f"{self.folder}/{MANIFESTS}/v{found[-1] if number is None else number}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _conform(self, df: DataFrame, table: str) -> DataFrame:
        """df with the columns of the table's present schema first: those it lacks have their default, those of another type
        are cast. Columns that the schema doesn't know stay."""
        if table not in SCHEMAS:
            return df
        kinds, known = dict(df.dtypes), self.spark.createDataFrame([], SCHEMAS[table]).dtypes
        own = [(F.col(c).cast(t) if c in kinds else F.lit(DEFAULTS.get(c, DEFAULTS.get(t))).cast(t)).alias(c) for c, t in known]
        return df.select(*own, *[c for c in df.columns if c not in dict(known)])

    def _load(self, table: str, held: dict, only: list[int] | None = None) -> DataFrame:
        by_schema: dict[str, list[str]] = {}
        for b, at in held["buckets"].items():
            if only is None or int(b) in only:
                by_schema.setdefault(held["schemas"][at], []).append(f"{self.folder}/{table}/{at}/_bucket={b}")
        parts = [self._conform(self.spark.read.schema(StructType.fromJson(json.loads(s))).parquet(*sorted(paths)), table) for s, paths in sorted(by_schema.items())]
        found = parts[0] if parts else self._conform(self.spark.createDataFrame([], StructType.fromJson(json.loads(held["schema"]))), table)
        for more in parts[1:]:
            found = found.unionByName(more, allowMissingColumns=True)
        return found

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The current version, or an older one; an empty table of the known schema before the first."""
        held = self.manifest(version)["tables"].get(table)
        if held:
            return self._load(table, held)
        old = self._numbers(f"{self.folder}/{table}")
        return self._conform(self.spark.read.parquet(f"{self.folder}/{table}/v{old[-1]}") if old else self.spark.createDataFrame([], SCHEMAS[table]), table)

    def differing(self, table: str) -> list[tuple[str, str, str]]:
        """(column, stored type, expected type) of columns that were stored with another type; they are cast when read."""
        held = self.manifest()["tables"].get(table)
        old = self._numbers(f"{self.folder}/{table}")
        stored = [StructType.fromJson(json.loads(s)) for s in held["schemas"].values()] if held else [self.spark.read.parquet(f"{self.folder}/{table}/v{old[-1]}").schema] if old else []
        known = dict(self.spark.createDataFrame([], SCHEMAS[table]).dtypes)
        return sorted({(f.name, f.dataType.simpleString(), known[f.name]) for s in stored for f in s if f.name in known and f.dataType.simpleString() != known[f.name]})

    def commit(self) -> Commit:
        return Commit(self)

    def write(self, table: str, df: DataFrame) -> int:
        """A new version in which df is the table."""
        with self.commit() as c:
            c.write(table, df)
        return c.number

    def merge(self, table: str, batch: DataFrame, put: Callable[[DataFrame, DataFrame], DataFrame], source: str = "", number: int | None = None) -> int | None:
        """put(stored, batch) over the buckets that the batch's keys fall into; the others keep their files. source and number
        name a batch of a stream: one that was merged before changes nothing. Returns how many buckets were written."""
        with self.commit() as c:
            if number is not None and c.base["batches"].get(source, -1) >= number:
                return None
            touched = c.merge(table, batch, put)
            if number is not None:
                c.batches[source] = number
        return touched

    def migrate(self) -> list[str]:
        """Brings tables of the layout before manifests into the present one, in one commit; of repeated probes of a hash and a
        way the last stays. Returns the tables that were moved."""
        moved = []
        with self.commit() as c:
            for table in SCHEMAS:
                if table not in c.base["tables"] and self._numbers(f"{self.folder}/{table}"):
                    df = self.read(table)
                    c.write(table, keep_last_id(df) if table == "discoveries" else df)
                    moved.append(table)
        return moved

    def vacuum(self, keep: int = 2) -> int:
        """Removes the manifests before the last `keep`, and the buckets that only those name. Returns how many buckets went."""
        numbers, gone = self.versions(), 0
        named = lambda part: {(t, at, b) for n in part for t, x in self.manifest(n)["tables"].items() for b, at in x["buckets"].items()}
        held, old = named(numbers[-keep:]), named(numbers[:-keep])
        for n in numbers[:-keep]:
            fs, p = self._fs(f"{self.folder}/{MANIFESTS}/v{n}.json")
            fs.delete(p, False)
        for table, at, b in sorted(old - held):
            fs, p = self._fs(f"{self.folder}/{table}/{at}/_bucket={b}")
            gone += bool(fs.delete(p, True))
        return gone


class Commit:
    """New contents of tables, visible together at the end of the `with` block; nothing is if it raises or writes nothing."""

    def __init__(self, store: Store):
        self.store = store
        self.base = store.manifest()
        self.number = self.base["number"]
        self.tables: dict[str, dict] = dict(self.base["tables"])
        self.batches: dict[str, int] = dict(self.base["batches"])

    def __enter__(self) -> Commit:
        return self

    def read(self, table: str) -> DataFrame:
        """The table as this commit leaves it."""
        return self.store._load(table, self.tables[table]) if table in self.tables else self.store.read(table)

    def _put(self, table: str, df: DataFrame, buckets: int) -> tuple[str, str, list[str]]:
        at = uuid.uuid4().hex
        path = f"{self.store.folder}/{table}/{at}"
        dealt = df.withColumn("_bucket", bucket_of(table, buckets))
        dealt = dealt.repartition("_bucket") if table in KEYS else dealt
        dealt.write.partitionBy("_bucket").parquet(path)
        return at, df.schema.json(), [n.removeprefix("_bucket=") for n in self.store._names(path) if n.startswith("_bucket=")]

    def write(self, table: str, df: DataFrame) -> None:
        """df becomes the whole table."""
        buckets = self.tables[table]["of"] if table in self.tables else self.store.buckets if table in KEYS else 1
        at, schema, found = self._put(table, df, buckets)
        self.tables[table] = {"of": buckets, "schema": schema, "buckets": dict.fromkeys(found, at), "schemas": {at: schema} if found else {}}

    def merge(self, table: str, batch: DataFrame, put: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """put(stored, batch) over the buckets of the batch's keys."""
        if table not in self.tables:  # the first version, or one of the layout before
            self.write(table, put(self.store.read(table), batch))
            return len(self.tables[table]["buckets"])
        held = self.tables[table]
        touched = sorted(r[0] for r in batch.select(bucket_of(table, held["of"])).distinct().collect())  # at most one number a bucket
        if not touched:
            return 0
        at, schema, found = self._put(table, put(self.store._load(table, held, touched), batch), held["of"])
        if stray := [b for b in found if int(b) not in touched]:
            raise ValueError(f"{table}: the merge made rows of other keys than its batch (buckets {', '.join(stray)})")
        buckets = {b: x for b, x in held["buckets"].items() if int(b) not in touched} | dict.fromkeys(found, at)
        schemas_ = held["schemas"] | {at: schema}
        self.tables[table] = held | {"schema": schema, "buckets": buckets, "schemas": {x: schemas_[x] for x in set(buckets.values())}}
        return len(touched)

    def __exit__(self, kind, *_) -> None:
        if kind or (self.tables == self.base["tables"] and self.batches == self.base["batches"]):
            return
        s, number = self.store, self.base["number"] + 1
        folder = f"{s.folder}/{MANIFESTS}"
        fs, hidden = s._fs(f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(hidden)
        try:
            out.write(bytearray(json.dumps({"number": number, "format": FORMAT, "tables": self.tables, "batches": self.batches}).encode()))
        finally:
            out.close()
        target = s._fs(f"{folder}/v{number}.json")[1]
        if s.versions()[-1:] not in ([], [number - 1]) or not fs.rename(hidden, target):
            raise OSError(f"version {number} was written by another writer")
        self.number = number
