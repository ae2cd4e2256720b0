"""Merges into tables that are stored by partition, without a table format.

A merge rewrites only the partitions that get rows or lose some. Partitions are known by their directories as the file system lists
them, so NULLs, escaped characters and odd spellings of a value are found as they are. Where the partition columns are part of the
key, a key can't move between partitions, and no other partition is looked at. Elsewhere the partitions that hold a source's
keys are found in three steps, each of which looks at fewer of them: by the key ranges and by Bloom filters that the table keeps
beside its data (``_keys``), then by reading the key columns of those that are left. A summary counts only while its partition has
the very files it was made from, so a lost or stale one costs time, never rows.

The new partitions are written in full beside the table; then a marker is written, and the directories change places. A merge that only
inserts, of rows with the table's columns, writes the new rows alone; their files move in beside those that are there, unless these have become
many and small. A merge that was stopped after the marker is finished by the next call, one stopped before it has changed nothing. A reader during the change may see some partitions new and
others old.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterflow.operators.upsert import Keys, exists, insert_only, matching, replace_groups, upsert

#: Fixed value: the directory name of a NULL.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"
SUMMARY, READY = "_keys", "ready"
#: Bits a key and hashes of the filters; bits of a block of them; up to so many source keys the filters are asked, beyond they'd hit everywhere.
BITS, HASHES, BLOCK, MOST_PROBES = 16, 5, 32768, 20_000
#: A partition with so many files of fewer bytes on average is written anew instead of getting further files.
MANY_FILES, SMALL_FILE = 100, 1_000_000

Values = tuple[str | None, ...]


@dataclass
class Stored:
    """A table's path, partition columns and, once listed, its directories: values as text -> paths and a mark of their files."""

    spark: SparkSession
    path: str
    partition_by: Keys
    like: DataFrame
    dirs: dict[Values, list[str]] = field(default_factory=dict)
    marks: dict[Values, str] = field(default_factory=dict)
    _schema: StructType | None = None

    def __post_init__(self):
        self.partition_by = list(self.partition_by)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        self.to_path = jvm.Path
        self.fs = self.to_path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    @property
    def schema(self) -> StructType:
        """The table's columns; partition columns have the source's types, not those their names look like."""
        if self._schema is None:
            known = {f.name: f for f in self.like.schema}
            here = self.spark.read.parquet(next(iter(self.dirs.values()))[0]).schema  # one partition's files have the columns of all
            self._schema = StructType([f for f in here if f.name not in self.partition_by] + [known[c] for c in self.partition_by])
        return self._schema

    def listed(self, root: str | None = None) -> list[tuple[Values, str]]:
        """(values, directory) of every partition, from the listing."""
        found = self.fs.globStatus(self.to_path((root or self.path) + "/*" * len(self.partition_by))) or []
        out = []
        for place in (x.getPath().toString() for x in found if x.isDirectory()):
            names = place.rsplit("/", len(self.partition_by))[1:]
            if all(n.startswith(f"{c}=") for n, c in zip(names, self.partition_by)):
                texts = [n.partition("=")[2] for n in names]
                out.append((tuple(None if t == NULL_NAME else unquote(t) for t in texts), place))
        return out

    def refresh(self) -> Stored:
        """List the directories; spellings of one value fall together."""
        found = self.listed()
        self.dirs, self.marks = {}, {}
        for values, (_, place) in zip(self._canonical([v for v, _ in found]), found):
            self.dirs.setdefault(values, []).append(place)
        files: dict[str, list[str]] = {}
        for x in self.fs.globStatus(self.to_path(self.path + "/*" * (len(self.partition_by) + 1))) or []:
            place, _, name = x.getPath().toString().rpartition("/")
            if not name.startswith(("_", ".")):
                files.setdefault(place, []).append(f"{name}:{x.getLen()}")
        self.marks = {v: ";".join(sorted(x for p in places for x in files.get(p, []))) for v, places in self.dirs.items()}
        return self

    def _canonical(self, values: list[Values]) -> list[Values]:
        """The values as the columns' types show them."""
        if not values:
            return []
        kinds = [self.like.schema[c].dataType for c in self.partition_by]
        texts = {f"v{j}": pa.array([v[j] for v in values], pa.string()) for j in range(len(kinds))}
        rows = self.spark.createDataFrame(pa.table({"i": range(len(values)), **texts}))  # from Arrow, which starts no Python workers
        shown = [F.coalesce(F.col(f"v{j}").try_cast(k).cast("string"), F.col(f"v{j}")) for j, k in enumerate(kinds)]
        return [tuple(r)[1:] for r in rows.select("i", *shown).orderBy("i").collect()]

    def texts(self) -> list[Column]:
        """The partition columns as the directories name them; an empty text is stored as NULL."""
        return [F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"_part{i}") for i, c in enumerate(self.partition_by)]

    def read(self, partitions: Sequence[Values], columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of some partitions, reading no other directory."""
        places = [p for v in partitions for p in self.dirs.get(v, [])]
        schema = self.schema
        if not places:
            df = self.spark.createDataFrame([], schema)
        else:
            df = self.spark.read.schema(schema).option("basePath", self.path).parquet(*places)
        return df if columns is None else df.select(*columns)

    def grows_by(self, source: DataFrame, partitions: Sequence[Values]) -> bool:
        """Whether source's rows can be put beside those of these partitions: columns and types are alike, and files aren't many and small."""
        sizes = [[int(x.rpartition(":")[2]) for x in self.marks[v].split(";") if x] for v in partitions if v in self.marks]
        crowded = any(len(s) >= MANY_FILES and sum(s) < SMALL_FILE * len(s) for s in sizes)
        return not crowded and {f.name: f.dataType for f in self.schema} == {f.name: f.dataType for f in source.schema}

    def of(self, rows: DataFrame) -> list[Values]:
        """The partitions of rows: as many as directories, on the driver."""
        return [tuple(r) for r in rows.select(*self.texts()).distinct().collect()]


def write_partitions(df: DataFrame, path: str, partition_by: Keys) -> None:
    """Replace the partitions that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def merge_into(spark: SparkSession, path: str, source: DataFrame, keys: Keys, partition_by: Keys, staging: str, how=upsert) -> DataFrame:
    """Merge source, one row for each key, into the table at path. staging: a folder of the same file system, for this table alone.
    Returns the source as it was staged, good until the next merge."""
    table = _opened(spark, path, source, partition_by, staging)
    source = _staged(source.dropDuplicates(list(keys)), staging)
    if table is None:
        source.write.partitionBy(*partition_by).parquet(path)
        return source
    touched = table.of(source)
    touched += moved_from(table, source, keys, touched)
    summarised = () if set(partition_by) <= set(keys) else keys
    if how is insert_only and table.grows_by(source, touched):
        there = matching(table.read(touched, keys), source, keys)  # the table's keys need not be shuffled if the source is small
        rows = matching(source, there, keys, "left_anti").hint("rebalance", *partition_by)  # few files for each partition
        exchange(table, rows, touched, staging, summarised, replaced=())
    else:
        rewrite(table, touched, lambda target: how(target, source, keys), staging, summarised)
    return source


def replace_groups_into(spark: SparkSession, path: str, source: DataFrame, group: Keys, partition_by: Keys, staging: str) -> None:
    """Delete all rows of the source's groups from every partition of the table at path, then add the source; an empty one changes nothing."""
    table = _opened(spark, path, source, partition_by, staging)
    source = _staged(source, staging)
    if table is None:
        source.write.partitionBy(*partition_by).parquet(path)
        return
    touched = table.of(source)
    touched += moved_from(table, source, group, touched)
    rewrite(table, touched, lambda target: replace_groups(target, source, group), staging, () if set(partition_by) <= set(group) else group)


def replace_grains_into(spark: SparkSession, path: str, made: DataFrame, grains: DataFrame, partition_by: Keys, staging: str) -> None:
    """Rows of the grains given (which have the partition columns too) go, then what was made of them is added: a grain that has no
    row any more loses its old ones."""
    table = _opened(spark, path, made, partition_by, staging)
    made = _staged(made, staging)
    if table is None:
        made.write.partitionBy(*partition_by).parquet(path)
        return
    keys = grains.columns
    touched = list(dict.fromkeys(table.of(grains) + table.of(made)))
    rewrite(table, touched, lambda target: matching(target, grains, keys, "left_anti").select(*target.columns).unionByName(made, allowMissingColumns=True), staging)


def _opened(spark: SparkSession, path: str, like: DataFrame, partition_by: Keys, staging: str) -> Stored | None:
    """The table as it is listed now, after finishing a merge that was stopped while its directories changed places."""
    table = Stored(spark, path, partition_by, like)
    finish(table, staging)
    if not exists(spark, path) or not table.listed():
        return None
    return table.refresh()


def _staged(source: DataFrame, staging: str) -> DataFrame:
    source.write.mode("overwrite").parquet(f"{staging}/source")
    return source.sparkSession.read.schema(source.schema).parquet(f"{staging}/source")


def rewrite(table: Stored, partitions: Sequence[Values], merged: Callable[[DataFrame], DataFrame], staging: str, keys: Keys = ()) -> None:
    """Put what merged makes of some partitions' rows in their place; those without rows go. keys: summarise them afterwards."""
    exchange(table, merged(table.read(partitions)), partitions, staging, keys, partitions)


def exchange(table: Stored, rows: DataFrame, partitions: Sequence[Values], staging: str, keys: Keys, replaced: Sequence[Values]) -> None:
    """Stage rows, then let them take the place of the replaced partitions, or move in beside the rows of others."""
    table.fs.delete(table.to_path(f"{staging}/old"), True)
    rows.write.mode("overwrite").partitionBy(*table.partition_by).parquet(f"{staging}/merged")
    out = table.fs.create(table.to_path(f"{staging}/{READY}"), True)
    out.writeBytes(json.dumps({"old": uuid.uuid4().hex, "places": [p for v in replaced for p in table.dirs.get(v, [])]}) + "\n")
    out.close()
    finish(table, staging)
    table.refresh()
    if keys:
        summarise(table, [v for v in partitions if v in table.dirs], keys)


def finish(table: Stored, staging: str) -> None:
    """Let the staged partitions change places with those they replace, or add their files; a second try leaves alone what has moved already."""
    marker = f"{staging}/{READY}"
    if not exists(table.spark, marker):
        return
    plan = json.loads(table.spark.read.text(marker).first()[0])
    name = lambda place: "/".join(place.rsplit("/", len(table.partition_by))[1:])
    for place in plan["places"]:
        old = f"{staging}/old/{plan['old']}/{name(place)}"
        if not exists(table.spark, old):  # else what stands at the place is new
            _move(table, place, old)
    for _, place in table.listed(f"{staging}/merged"):
        target = f"{table.path}/{name(place)}"
        if not exists(table.spark, target):
            _move(table, place, target)
            continue
        for x in table.fs.listStatus(table.to_path(place)):  # added rows: their files' names are in no other write
            _move(table, x.getPath().toString(), f"{target}/{x.getPath().getName()}")
    for done in (marker, f"{staging}/old", f"{staging}/merged"):
        table.fs.delete(table.to_path(done), True)


def _move(table: Stored, source: str, target: str) -> None:
    table.fs.mkdirs(table.to_path(target).getParent())
    if not table.fs.rename(table.to_path(source), table.to_path(target)):
        raise OSError(f"could not move {source} to {target}")


def _positions(keys: Keys) -> tuple[Column, Column]:
    """(hash that picks the block, array of bit numbers in it) of a row's keys, NULLs included."""
    parts = [x for k in keys for x in (F.col(k).isNull(), F.col(k).cast("string"))]
    bits = F.array(*[F.pmod(F.xxhash64(F.lit(i + 1), *parts), F.lit(BLOCK)) for i in range(HASHES)])
    return F.xxhash64(F.lit(0), *parts), bits


def summarise(table: Stored, partitions: Sequence[Values], keys: Keys) -> None:
    """Append the summaries of some partitions: range of each key, NULLs, and a Bloom filter in blocks of ``BLOCK`` bits."""
    keys, places = list(keys), [f"_part{i}" for i in range(len(table.partition_by))]
    rows = table.read(partitions).select(*table.texts(), *keys)
    ranges = [f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))] + [F.bool_or(F.col(k).isNull()).alias(f"null_{k}") for k in keys]
    blocks = F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), F.count(F.lit(1)) * BITS / BLOCK)))).cast("long").alias("blocks")
    stats = matched_marks(table, rows.groupBy(*places).agg(*ranges, blocks), places)
    which, bits = _positions(keys)
    spread = rows.select(*places, which.alias("which"), F.explode(bits).alias("bit"))
    on = [F.col(p).eqNullSafe(F.col(f"s{p}")) for p in places]
    sized = spread.join(stats.select(*[F.col(p).alias(f"s{p}") for p in places], "blocks"), reduce(lambda a, b: a & b, on))
    filters = sized.groupBy(*places, F.pmod("which", "blocks").alias("block")).agg(F.bitmap_construct_agg("bit").alias("bits"))
    stats = stats.select(*[F.col(p).alias(f"s{p}") for p in places], *[c for c in stats.columns if c not in places])
    filters.join(stats, reduce(lambda a, b: a & b, on)).drop(*[f"s{p}" for p in places]).write.mode("append").parquet(f"{table.path}/{SUMMARY}/{'-'.join(keys)}")


def matched_marks(table: Stored, rows: DataFrame, places: list[str]) -> DataFrame:
    """rows by partition, with the mark of the files that each partition has now; those of other files go."""
    kinds = ", ".join(f"m{p} string" for p in places)
    marks = table.spark.createDataFrame([(*v, m) for v, m in table.marks.items()], f"{kinds}, now string")
    on = [F.col(p).eqNullSafe(F.col(f"m{p}")) for p in places]
    if "mark" in rows.columns:
        on.append(F.col("mark") == F.col("now"))
    joined = rows.join(marks, reduce(lambda a, b: a & b, on)).drop(*[f"m{p}" for p in places])
    return joined.drop("now") if "mark" in rows.columns else joined.withColumnRenamed("now", "mark")


def moved_from(table: Stored, source: DataFrame, keys: Keys, known: Sequence[Values]) -> list[Values]:
    """Partitions beside the known ones where keys of the source are now."""
    if set(table.partition_by) <= set(keys):
        return []
    rest = [v for v in table.dirs if v not in set(known)]
    if not rest:
        return []
    asked = source.select(*keys).distinct()
    may = _may_hold(table, asked, list(keys), rest)
    rest = [v for v in rest if v in may]
    return table.of(matching(table.read(rest, list(dict.fromkeys([*keys, *table.partition_by]))), asked, keys)) if rest else []


def _may_hold(table: Stored, asked: DataFrame, keys: list[str], partitions: list[Values]) -> set[Values]:
    """The partitions that their summaries don't rule out."""
    stored, places = f"{table.path}/{SUMMARY}/{'-'.join(keys)}", [f"_part{i}" for i in range(len(table.partition_by))]
    if not exists(table.spark, stored):
        return set(partitions)
    kept = matched_marks(table, table.spark.read.parquet(stored), places)
    summarised = {tuple(r) for r in kept.select(*places).distinct().collect()}
    ends = asked.agg(F.count(F.lit(1)).alias("n"), *[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))], *[F.bool_or(F.col(k).isNull()).alias(f"null_{k}") for k in keys]).first()
    if not ends["n"]:
        return set()
    for k in keys:
        meets = (F.col(f"low_{k}") <= F.lit(ends[f"high_{k}"])) & (F.col(f"high_{k}") >= F.lit(ends[f"low_{k}"])) if ends[f"low_{k}"] is not None else F.lit(False)
        kept = kept.filter(F.coalesce(meets, F.lit(False)) | (F.col(f"null_{k}") & F.lit(bool(ends[f"null_{k}"]))))
    if ends["n"] <= MOST_PROBES:
        sizes = [r[0] for r in kept.select("blocks").distinct().collect()]  # powers of two
        which, bits = _positions(keys)
        probes = asked.select(F.explode(F.array(*map(F.lit, sizes or [1]))).alias("blocks"), which.alias("which"), bits.alias("probe")).withColumn("block", F.pmod("which", "blocks"))
        byte = lambda b: F.conv(F.hex(F.substring("bits", (b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        kept = kept.join(probes, ["blocks", "block"]).filter(F.forall("probe", lambda b: F.call_function("getbit", byte(b), (b % 8).cast("int")) == 1))
    return {tuple(r) for r in kept.select(*places).distinct().collect()} | (set(partitions) - summarised)
