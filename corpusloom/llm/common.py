"""What several operators share: the shared folder, written tables, word splitting and components."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps every byte that is no word byte to a blank and A-Z to a-z. Word bytes are 0-9, a-z and all bytes from 0x80.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    r"""Lower-cased (A-Z) words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a whole text, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    r"""Lower-cased (A-Z) words ``[^\x20\x09-\x0D]+`` of a whole text, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none, and driver and executors are one machine (tests), a folder of our own is set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="corpusloom-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back with the same schema.

    Tables that a lazy result still reads stay in the folder ``corpusloom`` there; whoever owns the shared folder
    deletes them when the results are used up."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing will read again."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._written
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name like ``stem`` that clashes with none of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def vectorized(ddl: str):
    """A pandas UDF of a module, made at its first use: workers import the module without a session."""

    def wrap(function):
        @functools.wraps(function)
        def call(*columns) -> Column:
            return F.pandas_udf(function, ddl)(*columns)

        return call

    return wrap


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id, written as text, is divisible by ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the values only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") + 0.5) / float(1 << 52)


def draw(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a text's MD5 sum, which SQL elsewhere can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


#: A bitmap of wanted keys has at most so many bits, so at most 64 MB are broadcast however many keys there are.
MAX_KEY_BITS = 1 << 29


def maybe_wanted(rows: DataFrame, key: Column, wanted: DataFrame, name: str, max_bits: int = MAX_KEY_BITS) -> DataFrame:
    """``rows`` with a boolean ``name``: false for certain where ``key`` (a long) is none of ``wanted`` (key long).

    The wanted keys set bits of a bitmap that is broadcast in pieces of 4 KB, so ``rows`` are not shuffled. Some rows
    whose key is not wanted are marked too, one in 32 for up to 16 million keys and more beyond, so an exact join of
    the marked rows has to follow. ``wanted`` should be a written table, since it is counted first.
    """
    bits = 1 << max(15, min(max_bits.bit_length() - 1, (32 * wanted.count()).bit_length()))

    def slot(k: Column) -> Column:
        return F.pmod(F.xxhash64(k, F.lit(29)), F.lit(bits)) + 1

    piece, bitmap = free_name(rows, "piece"), free_name(rows, "bitmap")
    maps = wanted.select(slot(F.col("key")).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias(piece)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(bitmap))
    at = F.bitmap_bit_position(slot(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot(key)) == F.col(piece), "left").withColumn(
        name, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop(piece, bitmap)


def row_key(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A long that tells rows apart: those that are equal in id and text share it."""
    return F.xxhash64(rows[quoted(doc_id)], F.xxhash64(rows[quoted(text)]))


def without(rows: DataFrame, key: Column, gone: DataFrame, stays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (a long) is not in ``gone``, without shuffling them all: (rows that no key of ``gone`` may
    meet, rows that were looked up).

    ``gone`` and ``stays`` are written tables (key) of all rows' keys; a key of both stays. A bitmap of the first tells
    rows that surely stay. The keys of the second that it marks too make another bitmap: rows that it leaves out surely
    go, the few others are joined. All helping columns have free names and are dropped again.
    """
    unsure = written(maybe_wanted(stays, F.col("key"), gone, "hit").where("hit").select("key").distinct(), "unsure")
    k, maybe, stay, other = (free_name(rows, x) for x in ("key", "maybe", "stay", "other"))
    columns = [F.col(quoted(c)) for c in rows.columns]
    marked = maybe_wanted(rows.withColumn(k, key), F.col(k), gone, maybe)
    open_ = maybe_wanted(marked.where(F.col(maybe)), F.col(k), unsure, stay).where(F.col(stay))
    looked_up = open_.join(unsure.select(F.col("key").alias(other)), F.col(k) == F.col(other), "left_semi")
    return marked.where(~F.col(maybe)).select(*columns), looked_up.select(*columns)


def components(edges: DataFrame, max_rounds: int = 60, share: int = 100_000) -> DataFrame:
    """Connected components of an edge list ``(a, b)``: rows ``(node, component)``, a written table.

    ``component`` is the smallest node that is reachable. Every round spreads the smallest label over the edges and
    then shortcuts labels through their labels, so that the rounds grow with the logarithm of the longest path. Labels
    live in written tables, never on the driver; those of a finished round are deleted. A node with more than one in
    ``share`` of all edges (at least 10,000) is dealt over several tasks by a salt: its edges stay where they are and
    its one label is copied to each salt. Minima are partial before each shuffle. Without edges there are no rows.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    degree = both.groupBy("b").agg(F.count("*").alias("n"))
    least = max(10_000, both.count() // share)
    hubs = written(degree.where(F.col("n") > least).select("b", F.ceil(F.col("n") / least).cast("int").alias("salts")), "hubs")  # at most ``share`` rows
    salted = both.join(F.broadcast(hubs), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        copies = labels.withColumnRenamed("node", "b").join(F.broadcast(hubs), "b", "left").select(
            "b", "component", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        near = salted.join(copies, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        spread = written(labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component")), "spread")
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("m"))
        step = written(spread.join(jump, "component", "left").select(
            "node", "old", F.least("component", F.coalesce("m", "component")).alias("component")), "labels")
        delete(labels, spread)
        labels = step
        if not step.where("old <> component").limit(1).count():
            delete(both, hubs)
            return step.select("node", "component")
        labels = step.select("node", "component")
        labels._written = step._written
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
