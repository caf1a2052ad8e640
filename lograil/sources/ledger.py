"""Tables that a stream writes in batches: a ledger says which folders are whole, and nothing that is read is overwritten.

A batch is known by (stream, run, number); run is the id that Spark keeps in a checkpoint, so batch 0 of a new checkpoint is
another batch than batch 0 of the lost one. Its rows go to a folder of its own, one sub-folder for each part (day, month or
bucket of the key), and then one row for each part to the ledger, in one file. Only what the ledger names is read:

* a batch that died half-way is written anew over its own, unnamed folder;
* a batch that is in the ledger is skipped;
* rows that another run has brought already are told by their key (insert-only, upsert).

An upsert writes the touched parts anew as a whole; the ledger's row for a part then stands for all rows of it so far. One
writer at a time for each table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lograil.sources.scratch import discard, table

_LEDGER = "seq long, folder string, part string, whole boolean"


@dataclass(frozen=True)
class Batch:
    """A micro-batch. Without a number it is never taken for one that is finished."""

    stream: str
    run: str
    number: int | None = None

    def folder(self) -> str:
        return f"{self.stream}-{self.run}-{uuid.uuid4().hex if self.number is None else self.number}"


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of a stream's checkpoint; a checkpoint that is made anew has another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """(seq, folder, part, whole): the finished batches and the parts that they wrote; whole: in place of all before."""
    schema = _parse_datatype_string(_LEDGER)
    if not _exists(spark, f"{base}/ledger"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/ledger")


def live(spark: SparkSession, base: str) -> DataFrame:
    """(folder, part) that make up the table now."""
    rows = ledger(spark, base).where("part is not null")
    last = rows.where("whole").groupBy("part").agg(F.max("seq").alias("last"))
    return rows.join(last, "part", "left").where("last is null or seq >= last").select("folder", "part")


def read(spark: SparkSession, base: str, schema: StructType, parts: list[str] | None = None) -> DataFrame:
    """The table's rows (columns of schema, and ledger_part); only the named parts, if any are, are listed by Spark's partition pruning."""
    full = StructType([*schema.fields, StructField("ledger_folder", _parse_datatype_string("string")), StructField("ledger_part", _parse_datatype_string("string"))])
    if not _exists(spark, f"{base}/data"):
        return spark.createDataFrame([], full).drop("ledger_folder")
    rows = spark.read.schema(full).option("basePath", f"{base}/data").parquet(f"{base}/data")
    if parts is not None:
        rows = rows.where(F.col("ledger_part").isin(parts))
    now = live(spark, base).select(F.col("folder").alias("ledger_folder"), F.col("part").alias("ledger_part"))
    return rows.join(now, ["ledger_folder", "ledger_part"], "left_semi").drop("ledger_folder")


def key_bucket(key: list[str], buckets: int = 64) -> Column:
    """A part that follows from the key, for tables without a day or month."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string")


def put(rows: DataFrame, base: str, batch: Batch, part: Column, key: list[str] | None = None, version: list[str] | None = None) -> bool:
    """Write a batch of rows; False if it is finished already.

    Without key all rows are added; with key only those whose key the table and the batch do not have yet (insert-only);
    with key and version columns the highest version of each key stays, the batch's where they are equal (upsert). part
    must follow from the key, as a record's event time does. Null and empty parts are kept under the name "none".
    """
    spark, folder = rows.sparkSession, batch.folder()
    done = ledger(spark, base)
    if batch.number is not None and not done.where(F.col("folder") == folder).isEmpty():
        return False
    seq = (done.agg(F.max("seq")).first()[0] or 0) + 1
    named = rows.withColumn("ledger_part", F.coalesce(F.nullif(part.cast("string"), F.lit("")), F.lit("none")))
    temporary = None
    if key:
        named = temporary = table(named, "batch")
        touched = [r[0] for r in temporary.select("ledger_part").distinct().collect()]  # days, months or buckets of one batch
        have = read(spark, base, rows.schema, touched)
        if version:
            both = have.withColumn("_new", F.lit(0)).unionByName(named.withColumn("_new", F.lit(1)))
            named = both.groupBy("ledger_part", *key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*version, "_new")).alias("_r")).select("ledger_part", *key, "_r.*").select(*rows.columns, "ledger_part")
        else:
            known = have.select("ledger_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
            on = named["ledger_part"] == known["ledger_part"]
            for i, k in enumerate(key):
                on &= named[k].eqNullSafe(known[f"_k{i}"])
            named = named.join(known, on, "left_anti").dropDuplicates(key)
    named.write.mode("overwrite").partitionBy("ledger_part").parquet(f"{base}/data/ledger_folder={folder}")
    written = _parts(spark, f"{base}/data/ledger_folder={folder}")
    entry = [(seq, folder, p, bool(version)) for p in written] or [(seq, folder, None, False)]
    spark.createDataFrame(entry, _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{base}/ledger/{folder}")
    if temporary is not None:
        discard(temporary)
    return True


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parts that a batch has written, from its folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted(unescape(n.partition("=")[2]) for n in names if n.startswith("ledger_part="))


def vacuum(spark: SparkSession, base: str) -> int:
    """Delete folders of parts that nothing reads any more; returns their number. Not while a reader or writer is at work."""
    kept = {(r.folder, r.part) for r in live(spark, base).collect()}
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/data")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for batch in fs.listStatus(p) if fs.exists(p) else []:
        for part in _parts(spark, batch.getPath().toString()):
            if (batch.getPath().getName().partition("=")[2], part) not in kept:
                name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)
                gone += fs.delete(spark._jvm.org.apache.hadoop.fs.Path(batch.getPath(), f"ledger_part={name}"), True)
    return gone


def fan_out(rows: DataFrame, batch: Batch, sinks: dict[str, dict]) -> None:
    """Write a batch to several tables: base -> arguments of `put`, and `where` for a choice of rows. The batch is read once;
    a table that has it already is passed over, so a batch that reached some of them only is completed by its replay."""
    once = table(rows, "fan-out")
    for base, how in sinks.items():
        how = dict(how)
        where = how.pop("where", None)
        put(once.where(where) if where is not None else once, base, batch, **how)
    discard(once)
