"""A vector store in a folder: a listing of items, vectors or packed payloads, failures, and a log of manifests.

Data goes to new folders that nothing reads yet. A manifest names the folders that make up the store; manifests are
numbered, and a new one appears by a rename, so a crash at any point leaves the last good state. The listing is written
first and the status is "building" from then on, so that a build can be resumed; vectors are appended batch by batch,
and only rows that are missing, so a batch may be repeated.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vantle.functions import sizes
from vantle.functions import vectors as V
from vantle.operators import ranking, search
from vantle.operators.config import identity
from vantle.sources import npy

FORMAT = 1
LISTING = "row_index long, video_id string, path string, caption string"
FAILURES = "row_index long, video_id string, path string, error string"
#: The folder of manifests; their names are numbers of so many digits.
LOG, DIGITS = "log", 10


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/") or "/"

    # files

    def _fs(self, name: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self) -> bool:
        fs, target = self._fs()
        return fs.exists(target) and len(fs.listStatus(target)) > 0

    def _numbers(self) -> list[int]:
        fs, target = self._fs(LOG)
        names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(int(n[:DIGITS]) for n in names if len(n) == DIGITS + 5 and n[:DIGITS].isdigit() and n.endswith(".json"))

    @staticmethod
    def _entry(number: int) -> str:
        return f"{LOG}/{number:0{DIGITS}}.json"

    def is_store(self) -> bool:
        return bool(self._numbers())

    def manifest(self) -> dict:
        """The last committed one."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"there is no store in {self.path}")
        fs, target = self._fs(self._entry(numbers[-1]))
        stream = fs.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Makes manifest the store's state; another writer that was faster makes this fail."""
        text = json.dumps(manifest, sort_keys=True, allow_nan=False, ensure_ascii=False)
        number = (self._numbers() or [0])[-1] + 1
        fs, draft = self._fs(f"{LOG}/.{uuid.uuid4().hex}")
        _, target = self._fs(self._entry(number))
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path} was changed by another writer")

    def _write(self, kind: str, rows: DataFrame) -> str:
        """A new folder of rows, which belongs to the store once a manifest names it."""
        name = f"{kind}/{uuid.uuid4().hex}"
        write = rows.write
        (write.parquet if kind == "vectors" else write.json)(f"{self.path}/{name}")
        return name

    def _folders(self, kind: str) -> list[str]:
        return [f"{self.path}/{name}" for name in self.manifest()["parts"].get(kind, [])] if self.is_store() else []

    def clean(self) -> None:
        """Removes folders that the last manifest doesn't name: what crashed writers and overwritten stores left."""
        named = {name for names in self.manifest()["parts"].values() for name in names}
        for kind in ("items", "vectors", "failures"):
            fs, target = self._fs(kind)
            for f in fs.listStatus(target) if fs.exists(target) else []:
                if f"{kind}/{f.getPath().getName()}" not in named:
                    fs.delete(f.getPath(), True)

    def bytes_of(self, *kinds: str) -> int:
        """Bytes of parts of the store (items, vectors, failures, manifest), of all of it where none is named."""
        total = 0
        for kind in kinds or ("items", "vectors", "failures", "manifest"):
            names = [self._entry(self._numbers()[-1])] if kind == "manifest" else self.manifest()["parts"].get(kind, [])
            for name in names:
                fs, target = self._fs(name)
                total += fs.getContentSummary(target).getLength()
        return total

    # building

    def _guard(self, overwrite: bool) -> None:
        """Refuses to write over a folder that holds no store, over a store unless told so, and over a user's folders."""
        if not self.exists():
            return
        if not self.is_store():
            raise FileExistsError(f"{self.path} holds files of something else")
        if not overwrite:
            raise FileExistsError(f"{self.path} exists")
        if os.path.realpath(self.path.removeprefix("file://")) in {os.path.realpath(p) for p in ("/", os.path.expanduser("~"), os.getcwd())}:
            raise ValueError(f"{self.path} isn't overwritten")

    def initialize(self, items: DataFrame, config: dict, dimension: int, overwrite: bool = False, resume: bool = False) -> None:
        """A new store of items (row_index, video_id, path, caption), or with resume an existing one after a look at its
        listing, configuration (device and precision aside) and dimension."""
        items = items.select(*(f.split()[0] for f in LISTING.split(", ")))
        if resume:
            if not self.is_store():
                raise FileNotFoundError(f"there is no store to resume in {self.path}")
            self.resume(items, config, dimension)
            return
        self._guard(overwrite)
        seen = Observation()
        parts = {"items": [self._write("items", items.observe(seen, F.count(F.lit(1)).alias("n")))]}
        self._commit({"format_version": FORMAT, "created_at": _now(), "count": seen.get["n"], "embedding_dim": dimension, "config": config, "packing": "float32", "status": "building", "parts": parts})
        self.clean()

    def resume(self, items: DataFrame, config: dict, dimension: int | None = None) -> DataFrame:
        """Items that are still to do; items, configuration and dimension must be the stored ones."""
        known = self.manifest()
        if identity(known.get("config", {})) != identity(config) or dimension not in (None, known["embedding_dim"]):
            raise ValueError("the store was built with another configuration")
        names = [c for c in ("row_index", "video_id", "path") if c in items.columns]
        mine, theirs = items.select(names), self.listing().select(names)
        if not (mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()):
            raise ValueError("the store holds other items")
        return self.pending()

    def _state(self) -> dict:
        """The manifest, or that of a store without items."""
        return self.manifest() if self.is_store() else {"format_version": FORMAT, "created_at": _now(), "count": 0, "embedding_dim": 0, "packing": "float32", "config": {}, "status": "building", "parts": {}}

    def _add(self, **rows: DataFrame) -> None:
        """Writes rows to new folders and commits them together."""
        new = {kind: self._write(kind, df) for kind, df in rows.items()}
        state = self._state()
        self._commit({**state, "parts": {**state["parts"], **{kind: [*state["parts"].get(kind, []), name] for kind, name in new.items()}}})

    def append(self, batch: DataFrame) -> None:
        """Encoded rows (row_index, video_id, embedding, error): good ones that are missing to vectors, others to failures."""
        good = batch.where("error is null").select("row_index", "embedding")
        if self._folders("vectors"):
            good = good.join(self.stored().select("row_index"), "row_index", "left_anti")
        bad = batch.where("error is not null").select(*[c for c in ("row_index", "video_id", "path", "error") if c in batch.columns])
        self._add(vectors=good, failures=bad)

    def enlist(self, items: DataFrame) -> None:
        """Adds items that the listing lacks."""
        items = items.select(*(F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in (f.split()[0] for f in LISTING.split(", "))))
        if self._folders("items"):
            items = items.join(self.listing().select("row_index"), "row_index", "left_anti")
        self._add(items=items)

    def finish(self, **report) -> dict:
        """Counts what is there and commits the report with the status: complete, or partial."""
        count, done = self.listing().count(), self.stored().count()
        state = self._state()
        dimension = state["embedding_dim"] or (self.stored().agg(F.max(F.size("embedding"))).first()[0] or 0)
        whole = {"finished_at": _now(), "requested_count": count, "completed_count": done, **report, "database_files_bytes": self.bytes_of()}
        self._commit({**state, "embedding_dim": dimension, "count": count, "completed_count": done, "status": "complete" if done == count else "partial", "report": whole})
        return whole

    def import_vectors(self, rows: DataFrame, normalize: bool = False, overwrite: bool = False, **provenance) -> dict:
        """Items (row_index, video_id, caption, embedding and, if known, path). Vectors and their values must be there and
        finite; they are made unit only where that is asked for and one isn't. The checks are made while the vectors are
        written, and nothing is committed where one fails."""
        self._guard(overwrite)
        again = False
        if normalize:
            again = not rows.agg(F.bool_and(V.is_unit("embedding"))).first()[0]
        resolved = "path" in rows.columns
        seen = Observation()
        size = F.size("embedding")
        checks = [F.bool_and(V.all_finite("embedding")).alias("finite"), F.bool_and(V.is_unit("embedding")).alias("unit"), F.max(size).alias("most"), F.min(size).alias("least"), F.count(F.lit(1)).alias("n"), F.count("caption").alias("captions")]
        vector = F.transform(V.normalized("embedding"), lambda x: x.cast("float")) if again else F.col("embedding")
        vectors = self._write("vectors", rows.observe(seen, *checks).select("row_index", vector.alias("embedding")))
        found = seen.get
        wrong = "vectors are null or hold values that are null or not finite" if found["finite"] is False else "vectors differ in length" if found["most"] != found["least"] else None
        if wrong:
            fs, target = self._fs(vectors)
            fs.delete(target, True)
            raise ValueError(wrong)
        path = F.col("path") if resolved else F.col("video_id")
        items = self._write("items", rows.select("row_index", "video_id", path.alias("path"), "caption"))
        flags = {"origin": "imported", "imported_at": _now(), "source_normalized": bool(found["unit"]), "renormalized_on_import": again, "paths_resolved": resolved, "captions": found["captions"] > 0}
        n, dimension = found["n"], found["most"] or 0
        self._commit({"config": {}, **provenance, "format_version": FORMAT, "count": n, "completed_count": n, "embedding_dim": dimension, "packing": "float32", "status": "complete", **flags, "parts": {"items": [items], "vectors": [vectors]}})
        self.clean()
        return {"output_dir": self.path, "count": n, "dimension": dimension, "source_normalized": bool(found["unit"]), "captions": found["captions"], "paths_resolved": resolved, "database_bytes": self.bytes_of()}

    # reading

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = self._folders(kind)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*folders) if kind == "vectors" else self.spark.read.schema(schema).json(folders)

    def listing(self) -> DataFrame:
        return self._read("items", LISTING)

    def failures(self) -> DataFrame:
        """Items that failed, with the reason, once for each time they did."""
        return self._read("failures", FAILURES)

    def stored(self) -> DataFrame:
        """Vectors as they are packed."""
        return self._read("vectors", "row_index long, embedding array<float>")

    def pending(self) -> DataFrame:
        return self.listing().join(self.stored().select("row_index"), "row_index", "left_anti")

    def decoded(self) -> DataFrame:
        """(row_index, embedding) as doubles, whatever the packing."""
        manifest = self.manifest()
        doubles = lambda: F.transform("embedding", lambda x: x.cast("double"))
        value = {
            "float32": doubles,
            "float16": doubles,
            "int8": lambda: V.unpack_int8("embedding", "scale"),
            "binary": lambda: F.transform(V.unpack_bits("embedding", manifest["embedding_dim"]), lambda x: x.cast("double")),
        }[manifest["packing"]]
        return self.stored().select("row_index", value().alias("embedding"))

    def vectors(self) -> DataFrame:
        """The listing with embedding as doubles; null where an item isn't done (completed says so)."""
        return self.listing().join(self.decoded(), "row_index", "left").withColumn("completed", F.col("embedding").isNotNull())

    def metadata_bytes(self) -> dict:
        """Bytes of the listing and the manifest, and an item's share."""
        count = self.manifest()["count"]
        if count < 1:
            raise ValueError("the store is empty")
        parts = {f"{n}_bytes": self.bytes_of(n) for n in ("items", "manifest")}
        return {**parts, "count": count, "total_bytes": sum(parts.values()), "bytes_per_item": sum(parts.values()) / count}

    # operators over whole stores

    def pack(self, target: str, packing: str, overwrite: bool = False) -> Store:
        """The store in another packing at another place."""
        if target.rstrip("/") == self.path:
            raise ValueError("a store can't be packed into itself")
        if packing not in V.PACKINGS:
            raise ValueError(f"unknown packing {packing}")
        out = Store(self.spark, target)
        out._guard(overwrite)
        parts = {"vectors": [out._write("vectors", packed(self.decoded(), packing))], "items": [out._write("items", self.listing())]}
        known = self.manifest()
        out._commit({**known, "packing": packing, "packed_at": _now(), "packed_from": self.path, "source_packing": known["packing"], "parts": parts})
        out.clean()
        return out

    def export(self, target: str, packing: str = "float32", overwrite: bool = False) -> None:
        """The vectors as matrices that other tools read: embeddings.npy, completed.npy and, for int8, scales.npy, written
        by the tasks at their rows' places and made visible together."""
        if packing not in V.PACKINGS:
            raise ValueError(f"unknown packing {packing}")
        npy.register(self.spark)
        state = self.manifest()
        d = state["embedding_dim"]
        kind, width = {"float32": ("float32", d), "float16": ("float16", d), "int8": ("int8", d), "binary": ("uint8", -(-d // 8))}[packing]
        write = packed(self.decoded(), packing).write.format("npy").mode("overwrite" if overwrite else "append")
        write.option("rows", state["count"]).option("width", width).option("dtype", kind).save(target)

    def search(self, query: list[float], k: int = 10) -> DataFrame:
        """rank, row_index, video_id, path, caption and score of the k best completed items."""
        manifest = self.manifest()
        if len(query) != manifest["embedding_dim"]:
            raise ValueError(f"the query has {len(query)} components, the store's vectors have {manifest['embedding_dim']}")
        score = search.binary_score(query, len(query)) if manifest["packing"] == "binary" else search.exact_score(query)
        hits = search.topk(self.decoded(), score, k, "row_index").select("row_index", "score", "rank")
        return self.listing().join(F.broadcast(hits), "row_index").orderBy("rank")  # k rows

    def evaluate(self, texts: DataFrame, recall_at: tuple[int, ...] = (1, 5, 10)) -> dict:
        """Retrieval of items by text vectors (row_index, embedding), of which row i describes item i. The store must be
        complete, and both must have the same rows and dimension. Ties count against the truth."""
        manifest = self.manifest()
        items, dimension = self.decoded().toDF("id", "vector"), manifest["embedding_dim"]
        found = texts.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        listed, done = self.listing().count(), items.count()
        if done != listed:
            raise ValueError(f"{listed - done} items aren't done; only a complete store can be evaluated")
        if found["n"] and (found["least"], found["most"]) != (dimension, dimension):
            raise ValueError(f"text vectors must have {dimension} components")
        if found["n"] != listed:
            raise ValueError(f"there are {found['n']} text vectors for {listed} items")
        queries = texts.select("row_index", V.normalized("embedding").alias("embedding")).toDF("id", "vector")
        truth = queries.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
        ranks = ranking.positions(search.truth_places(queries, items, truth, manifest["packing"] == "binary"))
        out = ranks.agg(*(F.avg((F.col("rank") <= k).cast("double") * 100).alias(f"R@{k}") for k in recall_at), F.median("rank").alias("MedianR"), F.avg("rank").alias("MeanR"), F.count("*").alias("queries")).first()
        return {"db": self.path, "packing": manifest["packing"], **out.asDict()}

    def compare(self, k: int = 10) -> dict:
        """Of every packing: bytes, mean cosine to the stored vectors, and agreement of the k nearest neighbours."""
        dimension, rows = self.manifest()["embedding_dim"], self.decoded()
        count = rows.count()
        if count < 2:
            raise ValueError("two items at least are needed")
        k = min(k, count - 1)
        kinds = {p: unpacked(packed(rows, p), p, dimension).select("row_index", "embedding") for p in V.PACKINGS}
        kinds = {"source": rows.select("row_index", "embedding"), **kinds}
        agree = {r["packing"]: r["agreement"] for r in search.agreements(kinds, "source", k).collect()}
        source, out = rows.select("row_index", F.col("embedding").alias("own")), []
        for p in V.PACKINGS:
            cosine = None  # signs keep no magnitude
            if p != "binary":
                cosine = kinds[p].join(source, "row_index").agg(F.avg(V.dot(V.normalized("embedding"), V.normalized("own")))).first()[0]
            each = {"float32": 4 * dimension, "float16": 2 * dimension, "int8": dimension, "binary": -(-dimension // 8)}[p]
            file = count * each + sizes.NPY_HEADER + (count * 4 + sizes.NPY_HEADER if p == "int8" else 0)
            out.append({"packing": p, "bytes_per_item": each + 4 * (p == "int8"), "vector_file_bytes": file, "mean_cosine_to_float32": cosine, f"neighbour_agreement_at_{k}": agree.get(p, 0.0)})
        return {"source_dir": self.path, "count": count, "dimension": dimension, "top_k": k, "packings": out}


def packed(rows: DataFrame, packing: str) -> DataFrame:
    """(row_index, embedding and, for int8, scale) of rows of doubles."""
    return {
        "float32": lambda: rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("float"))),
        "float16": lambda: rows.withColumn("embedding", F.transform(V.pack_half("embedding"), lambda x: x.cast("float"))),
        "int8": lambda: rows.withColumn("scale", V.int8_scale("embedding")).withColumn("embedding", V.pack_int8("embedding")),
        "binary": lambda: rows.withColumn("embedding", V.pack_bits("embedding")),
    }[packing]()


def unpacked(rows: DataFrame, packing: str, dimension: int) -> DataFrame:
    if packing == "int8":
        return rows.withColumn("embedding", V.unpack_int8("embedding", "scale"))
    if packing == "binary":
        return rows.withColumn("embedding", F.transform(V.unpack_bits("embedding", dimension), lambda x: x.cast("double")))
    return rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
