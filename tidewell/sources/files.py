"""Tables of records in files: CSV with a stated schema, resumable Parquet, JSON, and content hashes."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record of one experiment, with the columns that only some studies have.
RECORDS = (
    "system string, method string, method_label string, sparse_factor int, obs_dt double, noise double, seed int, upsample int, pod_rank int, rank_mode string, rank_cv_error double, "
    "support_f1 double, coef_error double, practical_score double, threshold double, status string"
)


def read_csv(spark: SparkSession, path: str, schema: str = RECORDS, bad: str | None = None) -> DataFrame:
    """A CSV file with a header; its columns are matched by name, those it lacks are null, and nothing is inferred. A cell that is not
    of its column's type is null; with bad, a column of that name lists such cells of the row as "column=text"."""
    header = spark.read.option("header", True).csv(path)
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    cols = [F.expr(f"try_cast(nullif(`{n}`, '') AS {t})").alias(n) if n in header.columns else F.lit(None).cast(t).alias(n) for n, t in fields]
    if bad is not None:
        wrong = [F.when(F.expr(f"nullif(`{n}`, '') IS NOT NULL AND try_cast(`{n}` AS {t}) IS NULL"), F.concat(F.lit(f"{n}="), F.col(n))) for n, t in fields if n in header.columns]
        cols.append(F.filter(F.array(*wrong), lambda c: c.isNotNull()).alias(bad))
    return header.select(*cols)


def bad_cells(df: DataFrame, bad: str) -> DataFrame:
    """(column, cells, example): how many cells of each column could not be read."""
    cells = df.select(F.explode(bad).alias("cell"))
    return cells.groupBy(F.substring_index("cell", "=", 1).alias("column")).agg(F.count("*").alias("cells"), F.min(F.expr("substring(cell, instr(cell, '=') + 1)")).alias("example"))


def write_csv(df: DataFrame, path: str) -> None:
    """For export to people; a table that Spark reads again is better written as Parquet."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_batch(df: DataFrame, path: str, batch: str, column: str = "batch") -> None:
    """Add a batch of records under its name. The same batch again, as after a failure, takes the place of what it wrote before,
    and leaves the others alone."""
    df.withColumn(column, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, at any depth. Each file is read whole by a task (2 GB at most) and only its
    digest leaves it. Spark passes over empty files. Each call reads the files anew: its plan has a name of its own, so that it is
    not answered from an earlier call's rows that are cached."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).where(F.lit(uuid.uuid4().hex) != "")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files of an earlier table of digests that are missing or changed in a later one, and those that are new."""
    old, new = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "path", "full").withColumn("change", change).where("change IS NOT NULL").select("path", "change")


def archive(df: DataFrame, path: str) -> bool:
    """Write once: False, and nothing changed, if there is something already."""
    try:
        df.write.mode("error").parquet(path)
        return True
    except Exception as error:  # noqa: BLE001
        if "PATH_ALREADY_EXISTS" in str(error):
            return False
        raise


def content_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def table_hash(df: DataFrame) -> str:
    """One hash for a table, whatever the order of its rows: the count and the sum of the rows' hashes."""
    h = F.conv(F.substring(content_hash(*sorted(df.columns)), 1, 15), 16, 10).cast("decimal(20,0)")
    row = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}".encode()).hexdigest()


def manifest(df: DataFrame, **more) -> str:
    """What is known of a result, as JSON: columns, hash, and whatever the caller adds."""
    return json.dumps({"columns": df.dtypes, "content": table_hash(df), **more}, sort_keys=True, default=str)


def to_markdown(df: DataFrame, limit: int = 200) -> str:
    """A small report as a Markdown table."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v) for v in r) + " |" for r in rows])


def write_manifest(df: DataFrame, path: str, **more) -> None:
    """The manifest of a result as one JSON text in a folder that Spark can reach."""
    df.sparkSession.createDataFrame([(manifest(df, **more),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
