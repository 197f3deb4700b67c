"""Input columns, keys and scratch tables shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.grams import pack_texts
from kiln.session import delete_scratch, scratch_path

# separator bytes of the word contracts, as a Java / DuckDB class body
SPACES = r"\x20\x09-\x0D"


ARROW_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Texts are long rows: unless the session sets its own number of rows
    for an Arrow batch, take fewer than the default 10,000, so that the
    batches of a task stay small beside its executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """128-bit key of the text: equal texts have equal keys, so a result that
    depends on the text alone is computed once per distinct text."""
    return F.unhex(F.md5(text_of(column).cast("binary")))


def held_out(id_column: str = "doc_id") -> Column:
    """True for the rows kept out of every fit: crc32(id as text) mod 4 = 2
    (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table under the shared checkpoint folder
    and read back: lineage is cut, each column is read on its own, and a lost
    executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for table in tables:
        delete_scratch(table.sparkSession, table.scratch)


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with its last column, a text, compressed (see
    ``grams.unpacked``): for rows that shuffle with their texts."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(pack_texts, f"{columns}, `{rows.columns[-1]}` binary")


def total_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, text bytes) of a table in one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_of(column))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


HEAVY_KEYS = 1000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique on ``on``), whose column
    ``weight`` says how many of the ``total`` rows a key has.

    Keys with more than a HEAVY_KEYS-th of the rows are at most HEAVY_KEYS:
    they are broadcast, so their rows stay where they are.  The others shuffle
    in groups that no longer stand out.  ``rows`` is read twice."""
    heavy = F.col(weight) * HEAVY_KEYS > total
    hot = F.broadcast(table.filter(heavy))
    columns = rows.columns + [c for c in table.columns if c not in on]
    return (rows.join(hot, on).select(*columns)
            .unionByName(rows.join(F.broadcast(table.filter(heavy).select(*on)), on, "left_anti")
                         .join(table.filter(~heavy), on).select(*columns)))
