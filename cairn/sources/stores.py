"""Sources and sinks that outlive a session: run logs, versioned vector indexes, artifacts with manifests, typed JSON files.

All are folders of Parquet files. What is current is told by a log of *heads*: a write puts its files into a folder of its own and
then appends one head row, which Spark commits as a whole. So a write that fails half-way leaves what was current as it is, a write
that is repeated replaces its first copy, and readers that have begun keep their files. ``vacuum`` removes what no head names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import guards as G
from cairn.operators import schemas

_HEAD = "name string, seq long, version string, record string"


class Refused(ValueError):
    """A load or a write whose input breaks rules; ``reasons`` lists them."""

    def __init__(self, reasons: Iterable[str]) -> None:
        self.reasons = sorted(reasons)
        super().__init__("; ".join(self.reasons))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def heads(spark: SparkSession, root: str) -> DataFrame:
    """(name, seq, version, record): the newest head of each name; two writes at the same time leave the one of greater version."""
    if not _exists(spark, f"{root}/heads"):
        return spark.createDataFrame([], _HEAD)
    newest = F.max(F.struct("seq", "version", "record")).alias("h")
    return spark.read.schema(_HEAD).json(f"{root}/heads").groupBy("name").agg(newest).select("name", "h.seq", "h.version", "h.record")


def publish(spark: SparkSession, root: str, versions: dict[str, str], record: dict | None = None) -> None:
    """Makes ``versions`` (by name, a few) current, all of them at once."""
    before = {r.name: r.seq for r in heads(spark, root).where(F.col("name").isin(list(versions))).collect()}
    said = json.dumps(record or {}, sort_keys=True)
    rows = [(name, before.get(name, 0) + 1, version, said) for name, version in versions.items()]
    spark.createDataFrame(rows, _HEAD).coalesce(1).write.mode("append").json(f"{root}/heads")


def current(spark: SparkSession, root: str, name: str) -> tuple[str, dict] | None:
    """(folder, record) of what is current under a name."""
    row = heads(spark, root).where(F.col("name") == name).first()
    return (f"{root}/{name}/{row.version}", json.loads(row.record)) if row else None


def put(df: DataFrame, root: str, name: str, record: dict | None = None, by: list[str] | None = None) -> None:
    """Writes a table and makes it current."""
    version = uuid.uuid4().hex
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/{name}/{version}")
    publish(df.sparkSession, root, {name: version}, record)


def get(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = current(spark, root, name)
    if not found:
        raise Refused([f"{name}: nothing is stored"])
    return spark.read.parquet(found[0])


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes versions that are not current. Not to be run beside a write or a reader of older versions."""
    gone, path = 0, spark._jvm.org.apache.hadoop.fs.Path
    for row in heads(spark, root).collect():  # a head for each name
        at = path(f"{root}/{row.name}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(at):
            if status.getPath().getName() != row.version:
                gone += bool(fs.delete(status.getPath(), True))
    return gone


# --- runs -------------------------------------------------------------------------------------------------------------

#: Tables of a run log; each row of them has the run's id and the id of the write that it came with.
RUN_TABLES = ("run_metrics", "failure_rows")


def log_runs(root: str, runs: DataFrame, metrics: DataFrame, failures: DataFrame, *, measures: list[str]) -> None:
    """Logs whole runs: ``runs`` (run_id, parameters map), ``metrics`` (run_id, case_id, measures) and ``failures`` (run_id, case_id, ...).

    Kept are each run's parameters, the mean of each measure and the failure rows. Logging a run again replaces it, even by one
    with fewer failures: rows are written under a new write id, and the run's row, which names that id, is swapped last.
    Refused are blank ids, runs without cases, cases twice in a run, and rows of runs that are not logged here.
    """
    spark, write_id = runs.sparkSession, uuid.uuid4().hex
    known = runs.select("run_id").distinct()
    blank = runs.where(F.col("run_id").isNull() | (F.trim("run_id") == "")).select(F.lit("run_id is blank").alias("reason"))
    again = runs.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit("run twice: "), "run_id"))
    empty = runs.join(metrics, "run_id", "left_anti").select(F.concat(F.lit("no cases: "), "run_id"))
    twice = metrics.groupBy("run_id", "case_id").agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit("case twice: "), "run_id", F.lit(" "), F.col("case_id").cast("string")))
    other = metrics.select("run_id").unionByName(failures.select("run_id")).join(known, "run_id", "left_anti").select(F.concat(F.lit("unknown run: "), F.coalesce("run_id", F.lit("null"))))
    reasons = blank.union(again).union(empty).union(twice).union(other).distinct().limit(20).collect()
    if reasons:
        raise Refused(r.reason for r in reasons)
    means = metrics.unpivot(["run_id"], measures, "metric", "value").groupBy("run_id", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    for name, table in zip(RUN_TABLES, (means, failures), strict=True):
        table.withColumn("write_id", F.lit(write_id)).write.partitionBy("run_id").mode("append").parquet(f"{root}/{name}")
    runs.select("run_id", "parameters", F.lit(write_id).alias("write_id")).write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/runs")


def read_log(spark: SparkSession, root: str, name: str = "runs") -> DataFrame:
    """The runs, or the rows of one of RUN_TABLES that came with each run's last write."""
    runs = spark.read.parquet(f"{root}/runs").withColumn("run_id", F.col("run_id").cast("string"))
    if name == "runs":
        return runs.drop("write_id")
    rows = spark.read.parquet(f"{root}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
    return rows.join(runs.select("run_id", "write_id"), ["run_id", "write_id"], "left_semi").drop("write_id")


# --- vector indexes ---------------------------------------------------------------------------------------------------

SCHEMA_VERSION = "1"
IDENTITY = ("schema_version", "provider", "model", "dimension", "corpus_hash", "chunking_strategy", "ids_hash", "rows")


def index_identity(vectors: DataFrame, corpus: DataFrame, *, key: str, vector: str, columns: list[str], provider: str, model: str, chunking_strategy: str) -> dict[str, str]:
    """What an index is of: the fields of IDENTITY. ``corpus`` (key, columns) is what was embedded; hashes are of rows in the order of the key."""
    shape = vectors.agg(F.count("*").alias("rows"), F.max(F.size(vector)).alias("dimension")).first()
    whole = lambda df, names: G.table_hash(df, key, names).first()["hash"]
    return {
        "schema_version": SCHEMA_VERSION, "provider": provider, "model": model, "dimension": str(shape.dimension), "corpus_hash": whole(corpus, [key, *columns]),
        "chunking_strategy": chunking_strategy, "ids_hash": whole(vectors, [key]), "rows": str(shape.rows),
    }


def save_index(vectors: DataFrame, root: str, identity: dict[str, str], *, key: str, vector: str, name: str = "index") -> None:
    """Stores (key, vector), vectors at unit length, with their identity. Vectors that are empty, not finite, zero or of another dimension are refused."""
    v = F.col(vector).cast("array<double>")
    problem = F.coalesce(G.vector_problems(v, int(identity["dimension"])), F.when(F.forall(v, lambda x: x == 0), "zero"))
    bad = vectors.select(problem.alias("p")).where("p is not null").groupBy("p").count().collect()
    if bad:
        raise Refused(f"{r.p}: {r['count']} vectors" for r in bad)
    unit = F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    put(vectors.select(key, unit.alias(vector)), root, name, identity)


def index_mismatches(stored: dict[str, str], expected: dict[str, str]) -> list[tuple[str, str | None, str | None]]:
    """(field, stored, expected) of each field of the identity that differs."""
    return [(f, stored.get(f), expected.get(f)) for f in IDENTITY if stored.get(f) != expected.get(f)]


def load_index(spark: SparkSession, root: str, expected: dict[str, str], *, vector: str, name: str = "index") -> DataFrame:
    """The stored vectors, if their identity is the expected one in every field and they are what it says; Refused with each reason otherwise."""
    found = current(spark, root, name)
    if not found:
        raise Refused(["nothing is stored"])
    reasons = [f"{field}: stored {a}, expected {b}" for field, a, b in index_mismatches(found[1], expected)]
    if reasons:
        raise Refused(reasons)
    vectors = spark.read.parquet(found[0])
    shape = vectors.agg(F.count("*").alias("rows"), F.count_if(G.vector_problems(F.col(vector), int(expected["dimension"])).isNotNull()).alias("bad")).first()
    if str(shape.rows) != expected["rows"] or shape.bad:
        raise Refused([f"files hold {shape.rows} vectors, {shape.bad} of them unfit"])
    return vectors


# --- files and manifests ----------------------------------------------------------------------------------------------


def file_facts(spark: SparkSession, root: str) -> DataFrame:
    """(key, byte_size, sha256, files) of every folder of files under ``root``, by its path from there; a folder of several files counts once, by the sizes and hashes of all in the order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = F.lit(spark.range(1).select(F.regexp_replace(F.lit(root), r"^[a-z]+:/*", "/")).first()[0].rstrip("/") + "/")
    files = files.select(F.substring(below, F.length(base) + 1, F.length(below)).alias("file"), "length", F.sha2("content", 256).alias("sha"))
    files = files.select(F.regexp_replace("file", "/?[^/]*$", "").alias("key"), "file", "length", "sha")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("file", "sha"))), lambda s: s["sha"])  # files of one folder, a few
    grouped = files.groupBy("key").agg(F.sum("length").alias("byte_size"), listed.alias("shas"))
    return grouped.select("key", "byte_size", F.when(F.size("shas") == 1, F.col("shas")[0]).otherwise(F.sha2(F.array_join("shas", ""), 256)).alias("sha256"), F.size("shas").alias("files"))


def verify_files(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, status) of every file and every record of ``manifest`` (key, byte_size, sha256); both may be null in a record.

    no_record: a file that no record names; no_file: a record without its file; no_hash: a record that asks for no hash;
    size, sha256: what differs first; ok.
    """
    own = facts.select("key", F.col("byte_size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_file"))
    want = manifest.select("key", "byte_size", "sha256", F.lit(True).alias("_record"))
    status = (
        F.when(F.col("_record").isNull(), "no_record").when(F.col("_file").isNull(), "no_file").when(F.col("sha256").isNull() | (F.trim("sha256") == ""), "no_hash")
        .when(F.col("byte_size") != F.col("_size"), "size").when(F.lower("sha256") != F.col("_sha"), "sha256").otherwise("ok")
    )
    return own.join(want, "key", "full_outer").select("key", status.alias("status"))


def canonical_json(value: Column) -> Column:
    """JSON of a struct, map, array or variant with keys in order at all depths and without spaces: a variant sorts its keys, and so writes them."""
    return F.to_json(F.parse_json(F.to_json(value)))


def put_artifacts(rows: DataFrame, root: str, *, artifact: str, key: str, columns: list[str], name: str = "artifacts") -> None:
    """Stores rows as canonical JSON by artifact, then upserts each artifact's record (rows, bytes, sha256) in the manifest beside it.

    The hash of an artifact is that of its lines' hashes in the order of the key, by ranges (``guards.table_hash``), so no artifact is
    gathered. Artifacts that are not among ``rows`` stay as they are.
    """
    spark = rows.sparkSession
    lines = rows.select(F.col(artifact).alias("artifact"), F.col(key).cast("long").alias("key"), canonical_json(F.struct(*columns)).alias("line"))
    if current(spark, root, name):
        known = get(spark, root, name)
        lines = known.join(lines.select("artifact").distinct(), "artifact", "left_anti").unionByName(lines)
    put(lines, root, name, by=["artifact"])
    stored = get(spark, root, name)
    hashed = G.table_hash_by(stored, ["artifact"], "key", ["line"]).withColumnRenamed("hash", "sha256")
    facts = stored.groupBy("artifact").agg(F.count("*").alias("rows"), F.sum(F.octet_length("line")).alias("bytes")).join(hashed, "artifact")
    put(facts, root, f"{name}_manifest")


def upsert(root: str, name: str, rows: DataFrame, *, by: list[str], key: list[str]) -> None:
    """Replaces all stored rows of the values of ``by`` that ``rows`` has, then appends ``rows``, as one new version. A key twice is refused."""
    spark = rows.sparkSession
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise Refused(f"twice: {tuple(r[k] for k in key)}" for r in twice)
    if current(spark, root, name):
        rows = get(spark, root, name).join(rows.select(*by).distinct(), by, "left_anti").unionByName(rows)
    put(rows, root, name)


def market_snapshot(observations: DataFrame, *, places: int = 4) -> DataFrame:
    """(symbol, close, date, state) of (symbol, close, date): the last day on which a symbol has a complete close, and its close.

    Closes that are null, not finite or not positive are incomplete; several different ones on that day leave the state ``ambiguous``,
    and symbols without any get ``incomplete``. Closes are rounded half up.
    """
    close = F.col("close").cast("double")
    whole = close.isNotNull() & ~F.isnan(close) & (close > 0) & (close < float("inf"))
    good = F.when(whole & F.col("date").isNotNull(), F.struct("date", F.round(F.col("close").cast("decimal(38,10)"), places).alias("close")))
    last = observations.groupBy("symbol").agg(F.max(good).alias("hi"), F.max(F.when(good.isNotNull(), F.col("date"))).alias("date"))
    least = observations.select("symbol", "date", good.alias("g")).where("g is not null").groupBy("symbol", "date").agg(F.min("g.close").alias("low"))
    out = last.join(least, ["symbol", "date"], "left")
    state = F.when(F.col("hi").isNull(), "incomplete").when(F.col("low") != F.col("hi.close"), "ambiguous").otherwise("ok")
    return out.select("symbol", F.when(state == "ok", F.col("hi.close").cast("double")).alias("close"), "date", state.alias("state"))


# --- typed JSON -------------------------------------------------------------------------------------------------------


def load_json(spark: SparkSession, path: str, rules: DataFrame, *, items: str, record: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON files, each one object (or, without ``whole_files``, each line).

    ``items`` names the key of the object whose array holds the records, ``record`` their type as DDL; ``rules`` are of one schema
    (see ``operators.schemas``). Rejects are (file, place, rule), ``not_json`` for what can't be read; no record of an object with a
    reject is loaded, so a file is loaded whole or not at all.
    """
    text = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    if not whole_files:
        text = text.withColumn("file", F.concat("file", F.lit("#"), F.sha2("text", 256)))
    schema = rules.select("schema").first()[0]
    rows = text.select("file", F.lit(schema).alias("schema"), F.try_parse_json("text").alias("value"))
    broken = rows.where("value is null").select("file", F.lit("$").alias("place"), F.lit("not_json").alias("rule"))
    rejects = broken.unionByName(schemas.violations(rows.where("value is not null"), rules, "file"))
    good = rows.where("value is not null").join(rejects.select("file").distinct(), "file", "left_anti")
    each = good.select("file", F.posexplode(F.try_variant_get("value", f"$.{items}", "array<variant>")).alias("ordinal", "r"))
    return each.select("file", "ordinal", F.try_variant_get("r", "$", f"struct<{record}>").alias("record")).select("file", "ordinal", "record.*"), rejects


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that several rows have, upper and lower case and outer blanks apart."""
    return rows.groupBy(F.lower(F.trim(F.col(key).cast("string"))).alias("key")).agg(F.count("*").alias("n")).where("n > 1")

