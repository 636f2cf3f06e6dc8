"""Small helpers that several operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word is a maximal run of characters other than these.
WORD_GAP = r"[\x20\x09-\x0D]+"

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where that setting is absent a temporary folder takes its place, in local sessions only: on a cluster it would
    scatter a table over machines. The folder is removed when the Python process ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="hopflow-")
        _folders[app] = f"{base.rstrip('/')}/hopflow-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session may be gone already; the folder is then left to the cluster's cleaner
        pass


#: Tables that `written` has made: the path of each, and a weak reference to what plans that read it hold.
_tables: dict[str, object] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    _tables[path] = spark._jvm.java.lang.ref.WeakReference(table._jdf.queryExecution().analyzed().relation())
    return table


def release(spark: SparkSession) -> None:
    """Deletes the tables of `written` that no DataFrame reads any more, as Spark does with its shuffle files.

    Every plan over a table, however it was derived, holds the one relation that reading it has made; once both garbage
    collectors have found that nothing does, the table is spent. A table in use, by whomever, is never deleted, and one
    whose relation has not been collected yet waits for the next call, or for the end of the process."""
    gc.collect()
    for path, relation in list(_tables.items()):
        if relation.get() is None:
            del _tables[path]
            _remove(spark, path)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, so that value is evaluated once however often body uses x."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0


#: A key with this share of all rows is hot: there are at most 1 / HOT_SHARE of them, which bounds what is broadcast.
HOT_SHARE, SALTS = 0.005, 64


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The keys, of a table with one row for each and its number of rows `n`, that have HOT_SHARE of all rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) >= max(HOT_SHARE * total, 2)).select(*keys)


def salted_join(rows: DataFrame, found: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """rows joined with found, which has each key once, so that the rows of hot keys are dealt over SALTS tasks by `by`.

    Rows of other keys, and those with null keys, have one salt. `strategy` is a join hint; without one Spark chooses."""
    few = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))  # at most 1 / HOT_SHARE rows
    one = F.array(F.lit(0))
    left = rows.join(few, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(one)
    right = found.join(few, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right.hint(strategy) if strategy else right, [*keys, "_salt"], how).drop("_salt")


#: Bits of the filter of maybe_in: 4 MB, whatever the tables. It tells keys apart well up to some million of them.
FILTER_BITS = 1 << 25


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose whole-number `key` is in the column `key` of wanted, and some others: for a join that follows and
    would else shuffle all rows. Keys are hashed to the bits of a filter of FILTER_BITS, which is broadcast; with many
    more keys than bits it lets nearly all rows pass, and nothing is lost."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    marks = wanted.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
    bits = written(marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")), "filter")
    hashed = rows.withColumn("_bit", bit)
    place = F.bitmap_bit_position("_bit")
    met = hashed.withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(bits), "_bucket")  # FILTER_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.substr("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1).select(*rows.columns)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, as a written table: whoever reads it again meets the same numbers, whatever
    docs is made of. `name` must be no column of docs; see fresh."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def fresh(docs: DataFrame, name: str) -> str:
    """name, or name with underscores before it: a name that no column of docs has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
