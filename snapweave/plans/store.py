"""The chunk store and its generations, on any file system Spark can reach.

    chunks/shard=NN/*.parquet    every distinct chunk: fp, length, payload
    files/attempt=<attempt>, refs/attempt=<attempt>   what one attempt wrote about one generation
    commits/<dataset>/gNNNNNNNNNN.json   the marker whose appearance is the atomic instant of a commit
    _store.json                  version and chunk sizes

Only markers make anything visible: an attempt that died leaves folders that no marker names, which sweep() removes. A
marker is written under another name and renamed, so it is there whole or not at all; one that can't be read counts as none.
Chunks are named by their content, so writing one twice does no harm; readers take either. The catalog and every check
are single plans over all generations, whose attempts are partitions of two tables.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import snapshot
from ..operators.chunking import Params
from ..schema import CHUNK_REFS, DETAIL_LIMIT, FILES, MAX_CHUNK, STORE_VERSION, EngineError
from ..sources.tree import write_in_order
from . import faults

CHUNKS = "fp binary, length int, payload binary, shard int"
COMMITS = "dataset string, generation long, digest string, attempt string"


class Store:
    def __init__(self, spark: SparkSession, root: str, params: Params):
        self.spark, self.root, self.params = spark, root.rstrip("/"), params

    # files on the store's own file system

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Publish a new small file at once; False where it is there already."""
        fs, path = self._fs(), self._path(name)
        if fs.exists(path):
            return False
        own = self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp".lstrip("/"))
        out = fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without OVERWRITE a rename refuses a name that is taken
            context.rename(fs.makeQualified(own), fs.makeQualified(path), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:  # noqa: BLE001 - Java's
            fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _marker_at(self, name: str) -> dict | None:
        """A marker's content; None where there is none or it can't be read."""
        try:
            m = json.loads(self._read(name)) if self._fs().exists(self._path(name)) else None
            return m if m and {"generation", "digest", "attempt"} <= m.keys() else None
        except ValueError:
            return None

    def _names(self, name: str) -> list[str]:
        if not self._fs().exists(self._path(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(name)))

    def remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    @classmethod
    def open(cls, spark: SparkSession, root: str, params: Params | None = None) -> Store:
        """A store that is there or is made; other chunk sizes than its own are refused."""
        own = cls(spark, root, params or Params())
        want = {"version": STORE_VERSION, "low": own.params.low, "avg": own.params.avg, "high": own.params.high}
        if not own._create("_store.json", json.dumps(want)):
            have = json.loads(own._read("_store.json"))
            if have["version"] != STORE_VERSION:
                raise EngineError("unsupported", "store version")
            if params and have != want:
                raise EngineError("unsupported", "other chunk sizes than the store's")
            own.params = Params(have["low"], have["avg"], have["high"])
        return own

    # chunks

    def chunks(self) -> DataFrame:
        if not self._names("chunks"):
            return self.spark.createDataFrame([], CHUNKS)
        return self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks")

    def fingerprints(self) -> DataFrame:
        return self.chunks().select("fp", "length").dropDuplicates(["fp"])

    def get(self, fps: DataFrame) -> DataFrame:
        """Chunks by fingerprint, hashed again: fp, payload, status. The shard prunes partitions."""
        asked = fps.select("fp", c.shard(F.col("fp")).cast("int").alias("shard")).distinct()
        found = asked.join(self.chunks().drop("length"), ["shard", "fp"], "left").dropDuplicates(["fp"])  # of the few asked, not of the store
        status = F.when(F.col("payload").isNull(), "not-found").when(c.fingerprint(F.col("payload")) != F.col("fp"), "corrupt").otherwise("ok")
        return found.select("fp", "payload", status.alias("status"))

    def checked(self, rows: DataFrame) -> DataFrame:
        """`rows` (fp, payload) with what the store says to each."""
        payload = F.coalesce("payload", F.lit(b""))
        return rows.select("fp", "payload", snapshot.put_guard(F.octet_length(payload), F.col("fp"), c.fingerprint(payload), MAX_CHUNK).alias("status"))

    def put(self, rows: DataFrame) -> None:
        """Insert what is absent. A row whose name is not its content's fails the job before anything is written."""
        checked = self.checked(rows)
        bad = checked.where("status <> 'ok'").select("status").limit(1).collect()
        if bad:
            raise EngineError(bad[0].status, "a chunk was refused")
        new = checked.select("fp", "payload").dropDuplicates(["fp"]).join(self.fingerprints().select("fp"), "fp", "left_anti")
        faults.reach("before_chunks")
        out = new.select("fp", F.octet_length("payload").alias("length"), "payload", c.shard(F.col("fp")).cast("int").alias("shard"))
        out.repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{self.root}/chunks")
        faults.reach("after_chunks")

    # generations

    def commits(self) -> DataFrame:
        """dataset, generation, digest, attempt of all visible generations."""
        rows = []
        for dataset in self._names("commits"):
            for name in self._names(f"commits/{dataset}"):
                if name.endswith(".json") and (m := self._marker_at(f"commits/{dataset}/{name}")):
                    rows.append((dataset, m["generation"], m["digest"], m["attempt"]))
        return self.spark.createDataFrame(rows, COMMITS)

    def _marker(self, dataset: str, generation: int) -> dict | None:
        return self._marker_at(f"commits/{dataset}/g{generation:010d}.json")

    def _all(self, table: str, columns: str) -> DataFrame:
        """What all visible generations hold, with dataset, generation and digest of each: a join on the attempt, which prunes partitions."""
        if not self._names(table):
            rows = self.spark.createDataFrame([], f"{columns}, attempt string")
        else:
            rows = self.spark.read.schema(f"{columns}, attempt string").parquet(f"{self.root}/{table}")
        return rows.join(F.broadcast(self.commits().withColumnRenamed("digest", "published")), "attempt")

    @staticmethod
    def _row_hashes(files: DataFrame, refs: DataFrame, *by: str) -> DataFrame:
        a = files.select(*by, F.sha2(F.concat_ws("\0", "path", "mode", "size", "mtime_ns", c.to_hex(F.col("digest"))), 256).alias("h"))
        return a.unionByName(refs.select(*by, F.sha2(F.concat_ws("\0", "path", "chunk_no", "length", c.to_hex(F.col("fp"))), 256).alias("h")))

    @staticmethod
    def _digests(hashes: DataFrame, *by: str) -> DataFrame:
        joined = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), ""), 256).alias("h")
        return hashes.groupBy(*by, F.substring("h", 1, 3).alias("b")).agg(joined("h")).groupBy(*by).agg(joined(F.concat("b", "h")))

    @classmethod
    def digest(cls, files: DataFrame, refs: DataFrame) -> str:
        """One hash of a generation's rows in any order: hashes of rows, sorted and hashed within 4096 buckets, then over the buckets."""
        found = cls._digests(cls._row_hashes(files, refs)).first()
        return found.h

    def commit(self, dataset: str, generation: int, files: DataFrame, refs: DataFrame) -> str:
        """Publish a generation: its digest. The same again is fine; another one under the same number is refused."""
        if not self.spark.range(1).select(c.valid_dataset(F.lit(dataset))).first()[0]:
            raise EngineError("invalid-argument", "dataset name")
        digest = self.digest(files, refs)
        if have := self._marker(dataset, generation):
            if have["digest"] == digest:
                return digest
            raise EngineError("exists", f"{dataset} {generation} has another digest")
        if refs.join(self.fingerprints(), "fp", "left_anti").limit(1).count():
            raise EngineError("protocol", "not all chunks have arrived")
        attempt = f"{dataset}-{generation:010d}-{uuid.uuid4().hex}"
        faults.reach("before_manifest")
        files.select("path", "mode", "size", "mtime_ns", "digest").write.parquet(f"{self.root}/files/attempt={attempt}")
        refs.select("path", "chunk_no", "offset", "length", "fp").write.parquet(f"{self.root}/refs/attempt={attempt}")
        faults.reach("after_manifest")
        faults.reach("before_marker")
        marker, name = json.dumps({"generation": generation, "digest": digest, "attempt": attempt}), f"commits/{dataset}/g{generation:010d}.json"
        if not self._create(name, marker):
            if not self._marker_at(name):  # a torn file of another writer makes nothing visible
                self._fs().delete(self._path(name), False)
            return self.commit(dataset, generation, files, refs)
        faults.reach("after_marker")
        return digest

    def manifest(self, dataset: str, generation: int) -> tuple[DataFrame, DataFrame]:
        """(files, refs) of a visible generation."""
        m = self._marker(dataset, generation)
        if not m:
            raise EngineError("not-found", f"{dataset} {generation}")
        return tuple(self.spark.read.schema(k).parquet(f"{self.root}/{t}/attempt={m['attempt']}") for t, k in (("files", FILES), ("refs", CHUNK_REFS)))

    def latest(self, dataset: str) -> int:
        found = self.commits().where(F.col("dataset") == dataset).agg(F.max("generation").alias("g")).first().g
        if found is None:
            raise EngineError("not-found", dataset)
        return found

    def sweep(self) -> int:
        """Remove what no marker names; how many attempts that were."""
        alive = {r.attempt for r in self.commits().collect()}
        dead = {a.partition("=")[2] for t in ("files", "refs") for a in self._names(t)} - alive
        for a in dead:
            for t in ("files", "refs"):
                self._fs().delete(self._path(f"{t}/attempt={a}"), True)
        return len(dead)

    def all_refs(self) -> DataFrame:
        return self._all("refs", CHUNK_REFS).select("dataset", "generation", "path", "chunk_no", "length", "fp")

    def catalog(self) -> DataFrame:
        """A row per visible generation: dataset, generation, files, logical_bytes, chunk_refs."""
        by = ["dataset", "generation"]
        files = self._all("files", FILES).groupBy(*by).agg(F.count("*").alias("files"), F.sum("size").alias("logical_bytes"))
        refs = self._all("refs", CHUNK_REFS).groupBy(*by).agg(F.count("*").alias("chunk_refs"))
        counts = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("files", "logical_bytes", "chunk_refs")]
        return self.commits().select(*by).join(files, by, "left").join(refs, by, "left").select(*by, *counts)

    def totals(self) -> DataFrame:
        return self.fingerprints().agg(F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes_stored"))

    def problems(self, deep: bool = False) -> DataFrame:
        """(problem, detail) of everything that is wrong; with `deep` every payload is hashed again."""
        refs = self.all_refs()
        missing = refs.select("fp").distinct().join(self.fingerprints(), "fp", "left_anti").select(F.lit("missing chunk").alias("problem"), c.to_hex(F.col("fp")).alias("detail"))
        wrong = F.octet_length("payload") != F.col("length")
        if deep:
            wrong = wrong | (c.fingerprint(F.col("payload")) != F.col("fp"))
        bad = self.chunks().where(wrong).select(F.lit("corrupt chunk").alias("problem"), c.to_hex(F.col("fp")).alias("detail"))
        gaps = snapshot.prefix_consistent(self.commits()).where("NOT consistent").select(F.lit("gap in generations").alias("problem"), F.col("dataset").alias("detail"))
        by = ["dataset", "generation"]
        again = self._digests(self._row_hashes(self._all("files", FILES), self._all("refs", CHUNK_REFS), *by), *by)
        empty = F.sha2(F.lit(""), 256)  # a generation without rows
        altered = self.commits().join(again, by, "left").where(F.coalesce("h", empty) != F.col("digest"))
        altered = altered.select(F.lit("altered manifest").alias("problem"), F.concat_ws(" ", *by).alias("detail"))
        return missing.unionByName(bad).unionByName(gaps).unionByName(altered)

    def verify(self, deep: bool = False) -> dict:
        found = self.problems(deep)
        return {"chunks": self.totals().first().chunks, "generations": self.commits().count(), "problems": found.count(), "detail": [tuple(r) for r in found.orderBy("problem", "detail").limit(DETAIL_LIMIT).collect()]}

    def materialize(self, dataset: str, generation: int, out: str) -> int:
        """Write a generation's files below `out` (a folder all executors share): how many.

        A file is written chunk by chunk in order, whatever its size, hashed on the way, and renamed into place only if its digest is right.
        """
        files, refs = self.manifest(dataset, generation)
        bad = files.where(~c.valid_path(F.col("path"))).select("path").limit(1).collect()
        if bad:
            raise EngineError("malformed", bad[0].path)
        if lost := refs.join(self.fingerprints(), "fp", "left_anti").select("path").limit(1).collect():
            raise EngineError("not-found", lost[0].path)
        payload = self.chunks().join(refs.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "payload")
        parts = refs.select("path", "chunk_no", "fp").join(payload, "fp").select("path", "chunk_no", "payload")
        heads = files.select("path", F.lit(-1).alias("chunk_no"), F.lit(None).cast("binary").alias("payload"), "mode", "size", "digest")
        rows = parts.select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("mode", "int"), ("size", "long"), ("digest", "binary")))).unionByName(heads)
        rows = rows.repartition("path").sortWithinPartitions("path", "chunk_no")  # a file's head, then its chunks
        try:
            rows.foreachPartition(lambda part: write_in_order(part, out))
        except Exception as e:  # noqa: BLE001 - a task's error comes back as text
            if found := re.search(r"EngineError: ([a-z-]+): (.*)", str(e)):
                raise EngineError(found[1], found[2]) from None
            raise
        return files.count()
