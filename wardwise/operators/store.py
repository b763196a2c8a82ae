"""Tables kept together: one manifest names the files of all of them, so a run changes all its tables or none.

A table's rows lie in buckets by the hash of their key. A run writes the buckets that it touches as new files; the
manifest carries the others on. The manifest of the next number is put in place by a rename, which is also where
two writers of one number meet; the run's success is a row of that manifest. A run that fails leaves a file that
says so and the manifest as it was. The number of buckets follows the rows, so what a run writes follows its own size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardwise.sources.shared import discard, materialized

from .tables import upsert

BUCKET = "_bucket"
RUNS = "run string, source string, started_at string, status string, rows long, vintage string, error string"


class Store:
    """Tables in a folder. ``target``: rows of a bucket that a table is laid out for; it is laid out anew when it has four times as many."""

    def __init__(self, spark: SparkSession, path: str, target: int = 1_000_000):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _put(self, name: str, content: dict) -> None:
        """A small file, whole or not at all; an error if it is there already."""
        fs, path = self._fs()
        draft = path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        to = path(f"{self.path}/{name}")
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(draft, to):
            raise RuntimeError(f"{name} was written by another run")

    def _get(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def version(self) -> int:
        """Number of the newest manifest; 0 before the first."""
        return max((int(n) for n in self._names("manifests")), default=0)

    def manifest(self) -> dict:
        n = self.version()
        return self._get(f"manifests/{n}") if n else {"tables": {}, "runs": []}

    def read(self, table: str, manifest: dict | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """A table's rows, or those of some buckets; None where there is no such table."""
        entry = (manifest or self.manifest())["tables"].get(table)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        files = [f"{self.path}/{b['path']}" for k, b in entry["buckets"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """A row for each run: the ones that succeeded from the manifest, the others from their files."""
        done = {r["run"]: r for r in self.manifest()["runs"]}
        failed = {n: self._get(f"failed/{n}") for n in self._names("failed")}
        begun = {n: self._get(f"begun/{n}") for n in self._names("begun")}
        rows = list((begun | failed | done).values())
        fields = [f.split()[0] for f in RUNS.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], RUNS)

    @contextmanager
    def run(self, source: str, started_at: str, vintage: str | None = None, name: str | None = None) -> Iterator[Changes]:
        """Changes that count together, from when the block ends without an error. A named run that has succeeded is an error to begin again."""
        run = name or uuid.uuid4().hex
        row = {"run": run, "source": source, "started_at": started_at, "vintage": vintage}
        before = self.version()
        manifest = self._get(f"manifests/{before}") if before else {"tables": {}, "runs": []}
        if any(r["run"] == run for r in manifest["runs"]):
            raise ValueError(f"run {run} has succeeded already")
        if run not in self._names("begun"):
            self._put(f"begun/{run}", row | {"status": "running"})
        changes = Changes(self, manifest)
        try:
            yield changes
            success = row | {"status": "success", "rows": changes.rows}
            self._put(f"manifests/{before + 1}", {"tables": changes.manifest["tables"], "runs": manifest["runs"] + [success]})
        except Exception as e:
            if run not in self._names("failed"):
                self._put(f"failed/{run}", row | {"status": "failed", "error": str(e)[:500]})
            raise


class Changes:
    """What a run has written so far; nobody else sees it."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.rows = store, 0
        self.manifest = json.loads(json.dumps(manifest))

    def read(self, table: str) -> DataFrame | None:
        return self.store.read(table, self.manifest)

    def replace(self, table: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """All rows of a table. They are made once, into a draft, as the number of buckets follows the number of rows."""
        draft = f"{self.store.path}/drafts/{uuid.uuid4().hex}"
        rows = materialized(rows, "draft", draft)
        self._write(table, rows, keys, self._layout(rows.count()), {})
        discard(self.store.spark, draft)

    def upsert(self, table: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """New rows win by key. Only the buckets of their keys are read and written."""
        entry = self.manifest["tables"].get(table)
        if entry is None:
            return self.replace(table, upsert(rows.limit(0), rows, keys), keys)
        if list(keys) != entry["keys"]:
            raise ValueError(f"the keys of {table} are {entry['keys']}")
        n = entry["n"]
        touched = [r[0] for r in rows.select(self._bucket(keys, n)).distinct().collect()]  # as many as there are buckets at most
        current = self.store.read(table, self.manifest, touched)
        self._write(table, upsert(current, rows.select(*current.columns), keys), keys, n, {k: b for k, b in entry["buckets"].items() if int(k) not in touched})
        entry = self.manifest["tables"][table]
        held = sum(b["rows"] for b in entry["buckets"].values())
        if held > 4 * self.store.target * n:
            self._write(table, self.read(table), keys, self._layout(held), {})

    def _layout(self, rows: int) -> int:
        return 1 << max(0, -(-rows // self.store.target) - 1).bit_length()

    @staticmethod
    def _bucket(keys: Sequence[str], n: int):
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias(BUCKET)

    def _write(self, table: str, rows: DataFrame, keys: Sequence[str], n: int, kept: dict) -> None:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        at = f"{self.store.path}/{folder}"
        # A bucket's rows may come from several tasks, so a hot one is not written by one alone.
        rows.withColumn(BUCKET, self._bucket(keys, n)).write.partitionBy(BUCKET).parquet(at)
        written = self.store.spark.read.schema(StructType([*rows.schema.fields]).add(BUCKET, "integer")).option("basePath", at).parquet(at)
        counts = {r[0]: r[1] for r in written.groupBy(BUCKET).count().collect()}  # a row a bucket
        self.rows += sum(counts.values())
        buckets = kept | {str(k): {"path": f"{folder}/{BUCKET}={k}", "rows": c} for k, c in counts.items()}
        self.manifest["tables"][table] = {"keys": list(keys), "n": n, "schema": rows.schema.jsonValue(), "buckets": buckets}


def digest(df: DataFrame) -> DataFrame:
    """What a table holds, whatever the order of its rows: for each column, and for whole rows (``*``), the number of rows and
    the sum and xor of hashes. A changed cell changes its column's and the rows' sum; rows that swap a value change the rows'."""
    flat = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f"`{f.name}`") for f in df.schema.fields])
    names = sorted(flat.columns)
    hashes = [F.xxhash64(F.lit(n), F.col(f"`{n}`"), F.col(f"`{n}`").isNull()) for n in names]
    whole = F.xxhash64(*[F.struct(F.col(f"`{n}`"), F.col(f"`{n}`").isNull()) for n in names])
    # Sums of three parts of a hash are longs, which add up faster than decimals.
    pieces = lambda h: (F.shiftright(h, 44), F.shiftright(h, 22).bitwiseAND(F.lit(0x3FFFFF)), h.bitwiseAND(F.lit(0x3FFFFF)))
    each = [(n, h, f"_{k}") for k, (n, h) in enumerate(zip([*names, "*"], [*hashes, whole]))]
    one = flat.select(*[h.alias(c) for _, h, c in each]).agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{j}{c}") for *_, c in each for j, p in enumerate(pieces(F.col(c)))], *[F.bit_xor(c).alias(f"x{c}") for *_, c in each])
    at = lambda c: F.col(c).cast("decimal(20,0)")
    total = lambda c: (((at(f"s0{c}") * F.lit(1 << 22)).cast("decimal(30,0)") + at(f"s1{c}")).cast("decimal(30,0)") * F.lit(1 << 22)).cast("decimal(38,0)") + at(f"s2{c}")
    rows = [F.struct(F.lit(n).alias("column"), F.col("n"), total(c).cast("decimal(38,0)").cast("string").alias("sum"), F.col(f"x{c}").alias("xor")) for n, _, c in each]
    return one.where("n > 0").select(F.explode(F.array(*rows)).alias("p")).select("p.*")
