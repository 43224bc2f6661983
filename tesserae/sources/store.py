"""The index store: documents, chunks and vectors as Parquet tables, each version in a folder of its own.

A write makes a new version beside the old one and then names it in ``CURRENT``, so a reader never meets half a table. Vectors
are kept under embedder, width and text, so a changed chunk never keeps the vector of its former text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import embed as M

TABLES = {
    "documents": "doc_id string, text string, source string, title string, metadata map<string,string>, fingerprint string",
    "chunks": "chunk_id string, doc_id string, text string, ordinal int, heading string, heading_path array<string>, start int, end int, parent_id string, metadata map<string,string>",
    "vectors": "key string, vector array<float>",
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self, table: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/CURRENT")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, table: str) -> DataFrame:
        _, path, fs = self._pointer(table)
        if not fs.exists(path):
            return self.spark.createDataFrame([], TABLES[table])
        version = self.spark.read.text(f"{self.path}/{table}/CURRENT").first()["value"]
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/{version}")

    def write(self, table: str, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        names = [f.name for f in self.spark.createDataFrame([], TABLES[table]).schema]
        rows.select(*names).write.parquet(f"{self.path}/{table}/{version}")
        _, path, fs = self._pointer(table)
        out = fs.create(path, True)
        out.write(bytearray(version.encode()))
        out.close()

    def changed(self, documents: DataFrame) -> DataFrame:
        """Documents that are new or whose text differs from the one stored."""
        named = documents.withColumn("fingerprint", X.fingerprint("text"))
        return named.join(self.read("documents").select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti").select(*named.columns)

    def upsert(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Replace documents and all their chunks."""
        ids = documents.select("doc_id").distinct()
        self.write("documents", self.read("documents").join(ids, "doc_id", "left_anti").unionByName(documents, allowMissingColumns=True))
        self.write("chunks", self.read("chunks").join(ids, "doc_id", "left_anti").unionByName(chunks))

    def vectors(self, chunks: DataFrame, name: str = "hashed", dim: int = 512, encoder=None) -> DataFrame:
        """(chunk_id, vector) of chunks; only texts that this embedder hasn't seen are embedded and kept."""
        cache = self.read("vectors")
        _, new = M.embed_cached(chunks, cache, name, dim, encoder)
        new = new.checkpoint()
        if new.limit(1).count():
            self.write("vectors", cache.unionByName(new))
        kept = self.read("vectors")
        return chunks.select("chunk_id", M.cache_key(name, dim).alias("key")).join(kept, "key").select("chunk_id", "vector")

    def load_chunks(self, indexable_only: bool = True) -> DataFrame:
        from ..operators.chunk import indexable

        chunks = self.read("chunks")
        return indexable(chunks) if indexable_only else chunks

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in TABLES}
