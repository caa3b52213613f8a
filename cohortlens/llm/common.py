"""Session plumbing, free names, spread joins, components and Bloom filters shared by this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernels import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a temporary folder on one machine, as in tests, else one in the warehouse."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="checkpoints") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this program wrote, wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until no column of df has it in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """df's schema and more fields (name, type) at its end, under the names given."""
    more = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields))
    return StructType([*df.schema.fields, *more.fields])


def lean_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of a few MB, in place of up to 64 MB: each is held several times over on the way."""
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the cluster's shared folder, so that lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, folder: str) -> DataFrame:
    """df written to a folder and read again. For steps that are repeated: a checkpoint keeps Spark's estimate of its size, which joins
    multiply, so after some rounds the estimate is a number of hundreds of MB on the driver; a file's size is known."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_rows(df: DataFrame, work, schema: StructType) -> DataFrame:
    """df.mapInArrow(work, schema), for columns of any names: the batches' own names are plain numbers."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(work, schema)


def in_turn(*works):
    """What ``map_rows`` takes, for all of works one after another: a task needs one Python worker for it, in place of one for each."""

    def work(batches):
        for each in works:
            batches = each(batches)
        return batches

    return work


def large_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input: sorted and merged, never broadcast.

    Spark judges by compressed bytes, and 10 MB of hashed keys are some 200 MB once the driver has built the table of them.
    """
    return left.join(right.hint("merge"), on, how)


#: A key that this share of all rows holds, or more, is hot; so there are so many hot keys at most.
HOT_KEYS = 64


def join_spread(rows: DataFrame, table: DataFrame, on: str, weight: str, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined to table by ``on``, and no task gets all rows of a hot key.

    table has one row a key, with the rows that hold it in ``weight``, which is
    dropped. Hot keys, ``HOT_KEYS`` at most, are broadcast to give their rows a
    salt from ``spread``, any column that differs among them; the table's rows
    of these keys are repeated for each salt. Every row is shuffled once.
    """
    salts, salt, total = free_names(rows, "salts", "salt", "total")
    sums = F.broadcast(table.agg(F.sum(weight).alias(total)))
    is_hot = F.col(weight) * HOT_KEYS >= F.col(total)
    hot = table.crossJoin(sums).where(is_hot).select(on, F.lit(HOT_KEYS).alias(salts))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread), F.col(salts)), F.lit(0)).cast("int")).drop(salts)
    repeated = table.crossJoin(sums).withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(is_hot, HOT_KEYS - 1).otherwise(0)))).drop(total, weight)
    return large_join(salted, repeated, [on, salt], how).drop(salt)


#: Edges that a task of the component search takes, about.
EDGES_A_TASK = 50_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge list (a, b); component is the smallest node.

    Alternates large-star and small-star steps. A hub's neighbours are never
    collected: its minimum is a partial aggregate, joined back to the edges,
    and hubs' edges are spread over tasks. Tasks are as many as the edges
    need, since each round shuffles some times. A round is stored in files
    until the next has been.
    Nodes without edges are not in the result.
    """
    spark = edges.sparkSession
    base = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, f"{base}/0")
    size = edges.count()
    seen = None

    def lowest(rows: DataFrame, low: DataFrame, tasks: int) -> DataFrame:
        # what one task takes in any case needs no spreading
        return rows.join(low.drop("degree"), "u") if tasks == 1 else join_spread(rows, low, "u", "degree", F.col("v"))

    for number in range(1, max_rounds + 1):
        tasks = max(1, -(-size // EDGES_A_TASK))
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        large = lowest(both.where("v > u"), low, tasks).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = lowest(large, low, tasks).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks), f"{base}/{number}")
        remove_folder(spark, f"{base}/{number - 1}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, size = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("v").alias("node")).distinct()
    out = checkpointed(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own.select("node", F.col("node").alias("component"))))
    remove_folder(spark, base)
    return out


def bloom_slots(h: np.ndarray, n_bits: int, n_hashes: int) -> np.ndarray:
    """The bit numbers of 64-bit hashes, one row for each of n_hashes; n_bits is a power of two."""
    a, b = h, mix(h + np.uint64(0x51ED27)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(n_bits - 1) for i in range(n_hashes)])


def set_bits(bits: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(bits, slots >> np.uint64(3), np.left_shift(np.uint8(1), (slots & np.uint64(7)).astype(np.uint8)))


def all_bits(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether all bits of a column of slots are set."""
    return np.logical_and.reduce((bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1), axis=0).astype(bool)


#: Bits of a filter of rows to look at, at most; fixed, so that what is broadcast is bounded. A full one only lets more rows through.
FILTER_BITS = 1 << 26


def bloom_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over the first column of hashes, 64-bit ones, made in the tasks and merged by words."""

    def build(batches):
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            set_bits(out, bloom_slots(batch.column(0).to_numpy().view(np.uint64), bits, 3))
        at = np.flatnonzero(out.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.view(np.uint64)[at].view(np.int64))], names=["at", "word"])

    words = hashes.mapInArrow(build, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    found = np.zeros(bits // 64, np.uint64)

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()]), pa.array([batch.column(1).to_numpy().tobytes()])], names=["at", "word"])

    for row in words.mapInArrow(pack, "at binary, word binary").toLocalIterator():
        found[np.frombuffer(row.at, np.int64)] = np.frombuffer(row.word, np.uint64)
    return found.view(np.uint8)


def filter_size(keys: int, most: int = FILTER_BITS) -> int:
    """Bits for so many keys: about ten each, a power of two, within a fixed bound."""
    return min(most, 1 << max(16, (10 * keys).bit_length()))


def parted(docs: DataFrame, key: Column, wanted: DataFrame, bits: int, inside=None, outside=None) -> tuple[DataFrame, DataFrame]:
    """docs in two parts: rows whose key's hash may be among ``wanted`` (a column of xxhash64 values), and all others, which surely aren't.

    A row without key is among the others. Both parts read docs where it lies.
    ``inside`` and ``outside`` are (work, schema) as ``map_rows`` takes them, to
    be done to a part by the Python workers that make it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted, bits))
    keyed = docs.select(*columns(docs), F.when(key.isNotNull(), F.xxhash64(key)).alias(free_names(docs, "h")[0]))
    names = docs.columns
    at = len(names)

    def part(wants: bool, then):
        def rows(batches):
            for batch in batches:
                h = batch.column(at)
                hit = all_bits(sent.value, bloom_slots(h.fill_null(0).to_numpy().view(np.uint64), bits, 3)) & np.asarray(h.is_valid())
                yield pa.RecordBatch.from_arrays(batch.columns[:at], names=names).filter(pa.array(hit == wants))

        work, schema = then or (in_turn(), docs.schema)
        return map_rows(keyed, in_turn(rows, work), schema)

    return part(True, inside), part(False, outside)
