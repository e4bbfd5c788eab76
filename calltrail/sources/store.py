"""The event store on Parquet: append (S8), read with schema evolution (S9),
export sessions (S10), erase a user (D1), clear (D2), retention (R7).

Layout: ``<table>/event_date=YYYY-MM-DD/load-<number>-*.parquet`` (daily
partitions, R8; ``erased-<number>-*`` after an erase); rows inside files sorted by
(app_id, ts) so row-group statistics act like the reference's (app_id, ts) index.
Beside the days: ``_loads`` (who owns a load number, which loads are in), ``_commits``
(one record per load, read by followers), ``_users`` (which load and day hold a
user), ``_erased`` (users erased so far), ``_staging``.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.schema import EVENT, FIELDS, V1_FIELDS, conform, with_time
from calltrail.sources import loads as LD
from calltrail.sources.loads import LoadClash, StoreBusy

STORE_SCHEMA = T.StructType(EVENT.fields + [T.StructField("event_date", T.DateType(), True)])
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # folder of rows without a day
_POS_BITS, _MAX_LOAD = LD.POS_BITS, LD.MAX_LOAD


def _fs(spark: SparkSession, path: str):
    return LD.fs_of(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    return LD.exists(spark, path)


def _mark(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def by_day(df: DataFrame) -> DataFrame:
    """Rows of a day together, ordered for the files.  The rebalance hint lets
    adaptive execution size the writers by data: a busy day is split over
    many tasks, small days share one."""
    return (df.hint("rebalance", F.col("event_date"))
              .sortWithinPartitions("event_date", "app_id", "ts", "seq"))


def assign_seq(df: DataFrame, load_id: int, work: str, order: list[str] | None = None) -> DataFrame:
    """Arrival order for rows without a ``seq`` (no column, or null as from a
    log stream): ``load_id`` * 2^36 + the row's dense position in the load.
    Existing ids are kept; if no row lacks one (a look at that column alone),
    nothing is written.

    The position follows ``order`` (default ``batch_id``, ``pos`` where present,
    else the order of the input), whatever the number of partitions: the rows are
    written once to ``work`` in that order, the written partitions are counted,
    and a row's position is its partition's start (one row per partition,
    broadcast) plus its place in it.  Load ids end at 2^27 - 1; larger ones,
    and loads of more than 2^36 rows, are refused.
    """
    load_id = int(load_id)
    if not 0 <= load_id <= _MAX_LOAD:
        raise ValueError(f"load id {load_id} is not in 0 .. {_MAX_LOAD}")
    spark = df.sparkSession
    if "seq" in df.columns:
        own = F.col("seq").cast("bigint")
        if not df.where(own.isNull()).limit(1).count():
            return df.withColumn("seq", F.coalesce(own, F.raise_error(F.lit(f"a row of load {load_id} lost its seq")).cast("bigint")))
    if order is None:
        order = ["batch_id", "pos"] if {"batch_id", "pos"} <= set(df.columns) else []
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(work)
    rows = spark.read.parquet(work).withColumns({
        "__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
                          (F.sum("__n").over(Window.orderBy("__part")) <= F.lit(1 << _POS_BITS)).alias("__fits"))
    if starts.where("not __fits").limit(1).count():
        raise ValueError(f"load {load_id} has more than 2^{_POS_BITS} rows")
    new = F.lit(load_id << _POS_BITS) + F.col("__start") + F.col("__at")
    if "seq" in df.columns:
        new = F.coalesce(F.col("seq").cast("bigint"), new)
    return (rows.join(F.broadcast(starts), "__part").withColumn("seq", new.cast("bigint"))
                .drop("__part", "__at", "__start", "__fits"))


def seq_by_batch(df: DataFrame, load_id: int, sizes: dict[str, int] | None = None) -> DataFrame:
    """``assign_seq`` for whole batches, whose ``pos`` runs from 0 without gaps: the same
    ids, ``load_id`` * 2^36 + the place in (batch_id, pos) order, without sorting or
    writing the rows.  A batch's start is a running sum over ``sizes`` (rows of each batch,
    counted here if not given), one number per batch (broadcast; the batches of a load are the
    files of a micro-batch, which its driver lists)."""
    if sizes is None:
        sizes = {r["batch_id"]: r["n"] for r in df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = at = int(load_id) << _POS_BITS
    batches, starts = sorted((b for b in sizes if b is not None), key=str.encode), []
    for batch in batches:
        starts.append(at)
        at += sizes[batch]
    if at - first > 1 << _POS_BITS:
        raise ValueError(f"load {load_id} has more than 2^{_POS_BITS} rows")
    known = df.sparkSession.createDataFrame(
        pa.table({"batch_id": pa.array(batches, pa.string()), "__start": pa.array(starts, pa.int64())}))
    return (df.join(F.broadcast(known), "batch_id")
              .withColumn("seq", F.col("__start") + F.col("pos")).drop("__start"))


def _fingerprint(df: DataFrame) -> list:
    # rows and a sum of row hashes; neither the order nor the ids of the rows count
    cols = ", ".join(f"map_entries(`{f.name}`)" if isinstance(f.dataType, T.MapType) else f"`{f.name}`"
                     for f in df.schema.fields if f.name != "seq")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.expr(f"xxhash64({cols})").cast("decimal(38,0)")), F.lit(0))
            .cast("string").alias("sum")]


def _dated(df: DataFrame) -> DataFrame:
    return with_time(conform(df)).drop("event_time")


def _same(df: DataFrame, load_id: int, known: str) -> None:
    own, info = _dated(df).agg(*_fingerprint(_dated(df))).first(), json.loads(known)
    if (own["rows"], own["sum"]) != (info["rows"], info["sum"]):
        raise LoadClash(f"load id {load_id} is already used by a load of {info['rows']} other rows; "
                        f"this one has {own['rows']}")


def append_events(df: DataFrame, table: str, load_id: int | None = None, order: list[str] | None = None, *,
                  source: str | None = None, batch=None, numbered: bool = False) -> int:
    """Conform and append one load to the store, partitioned by ``event_date``.

    A load is known by ``load_id``, a number that the caller picks (below 2^26, as
    larger ones are given to streams), or by ``source`` and ``batch``, which get
    a number of their own (``loads.claim_number``); with neither it is a new load.
    The number numbers the rows (``assign_seq``; not those that are ``numbered`` by it already, which are read
    twice at once, so they should be files) and makes the append idempotent:
    the same load appended again adds nothing.  Other rows under a ``load_id`` in
    use raise ``LoadClash``; rows are compared by count and a sum of hashes, without
    ``seq``.  Returns the number of files committed now.  Steps:

    1. the load is written to ``<table>/_staging/load=<number>``, with the users it
       holds to ``_users``, then marked ready; an attempt that ended before the
       mark left nothing visible and is redone;
    2. from the mark on the staged files are the load: each is renamed into its
       day as ``load-<number>-<part>``.  A replay finds only those not yet renamed
       and goes on with them, however its own input is split;
    3. users erased since the load began are erased from it;
    4. a record in ``_commits`` shows the load to followers, ``_loads/done`` has
       it as done, and the stage goes.
    """
    spark, root = df.sparkSession, table.rstrip("/")
    if load_id is not None:
        number = int(load_id)
        LD.own_number(spark, root, number)
    else:
        number = LD.claim_number(spark, root, source or "append", uuid.uuid4().hex if batch is None else batch)
    done, stage = f"{root}/_loads/done/{number}", f"{root}/_staging/load={number}"
    ready, files = f"{stage}/_ready", f"{stage}/files"
    known = LD.text_of(spark, done) or (LD.text_of(spark, f"{stage}/info") if _exists(spark, ready) else None)
    if known is not None and load_id is not None:
        _same(df, number, known)
    if LD.text_of(spark, done) is not None:
        return 0
    if known is None:
        fs, stage_path = _fs(spark, stage)
        fs.delete(stage_path, True)
        seen = Observation()
        dated = _dated(df if numbered else assign_seq(df, number, f"{stage}/rows", order))
        rows = by_day(dated)

        def write():
            rows.observe(seen, *_fingerprint(rows)).write.option(
                "parquet.bloom.filter.enabled#user_id", "true").partitionBy("event_date").parquet(files)

        if numbered:
            LD.at_once(spark, write, lambda: _index_users(spark, root, dated, number))
        else:
            write()
            _index_users(spark, root, spark.read.schema(STORE_SCHEMA).parquet(files), number)
        days = [n.split("=", 1)[1] for n in LD.names_in(spark, files) if n.startswith("event_date=")]
        LD.put_new(spark, f"{stage}/info", json.dumps({**seen.get, "commit": uuid.uuid4().hex, "days": days}))
        _mark(spark, ready)
    return _finish(spark, root, number)


#: The append is idempotent per load; this name says so where it matters.
append_events_once = append_events


def _finish(spark: SparkSession, root: str, number: int) -> int:
    # steps 2 to 4 of append_events for a load that is marked ready
    stage, claimed = f"{root}/_staging/load={number}", LD.modified(spark, f"{root}/_loads/ids/{number}")
    text = LD.text_of(spark, f"{stage}/info")
    info = json.loads(text)
    committed = _move_in(spark, f"{stage}/files", root, f"load-{number}-")
    gone = sorted({LD.text_of(spark, f"{root}/_erased/{n}") for n in LD.names_in(spark, f"{root}/_erased")
                   if LD.modified(spark, f"{root}/_erased/{n}") > claimed})
    if gone:
        with LD.lock(spark, f"{root}/_erase/lock", wait_s=LD.LEASE_S):
            for user in gone:
                _erase(spark, root, user, {(str(number), d) for d in info["days"]})
    LD.put_new(spark, f"{root}/_commits/{number}-{info['commit']}",
               json.dumps({"tag": str(number), "days": info["days"]}))
    LD.put_new(spark, f"{root}/_loads/done/{number}", text)
    fs, stage_path = _fs(spark, stage)
    fs.delete(stage_path, True)
    return committed


def _index_users(spark: SparkSession, root: str, files: DataFrame, number: int) -> None:
    """Which day of the load holds which user, by the user's hash and sorted by
    it in one shuffle, so that a look-up reads a row group of a few small files per load."""
    (files.where("user_id is not null")
          .select(F.xxhash64("user_id").alias("user"), F.coalesce(F.col("event_date").cast("string"), F.lit(NO_DAY)).alias("day"))
          .repartition("user").distinct().sortWithinPartitions("user")
          .write.mode("overwrite").parquet(f"{root}/_users/load={number}"))


def _move_in(spark: SparkSession, files: str, table: str, prefix: str) -> int:
    """Rename staged files into their day partitions as ``<prefix><part>``.  A
    name already taken by another file is an error; nothing is overwritten."""
    fs, _ = _fs(spark, files)
    path, moved = LD.jvm_class(spark, "org.apache.hadoop.fs.Path"), 0
    for day in LD.names_in(spark, files):
        source = path(f"{files}/{day}")
        if not day.startswith("event_date=") or not fs.getFileStatus(source).isDirectory():
            continue
        fs.mkdirs(path(f"{table}/{day}"))
        for f in fs.listStatus(source):
            found = f.getPath()
            own = found.getName()
            if not own.startswith("part-"):
                continue
            suffix = own[own.index("."):] if "." in own else ""
            target = path(f"{table}/{day}/{prefix}{own.split('-')[1]}{suffix}")
            if fs.exists(target) or not fs.rename(found, target):
                raise OSError(f"could not commit {found} as {target}")
            moved += 1
    return moved


def read_events(spark: SparkSession, table: str) -> DataFrame:
    """Read the store; files written before a column existed read it as null."""
    return spark.read.schema(STORE_SCHEMA).option("mergeSchema", "true").parquet(table)


def store_count(spark: SparkSession, table: str) -> int:
    fs, p = _fs(spark, table)
    if not fs.exists(p):
        return 0
    return read_events(spark, table).count()


def clear_events(spark: SparkSession, table: str) -> int:
    """Remove every event; returns how many there were."""
    n = store_count(spark, table)
    fs, p = _fs(spark, table)
    if fs.exists(p):
        fs.delete(p, True)
    return n


def _partition_dirs(spark: SparkSession, table: str) -> dict:
    fs, p = _fs(spark, table)
    out = {}
    if not fs.exists(p):
        return out
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("event_date="):
            out[name.split("=", 1)[1]] = st.getPath()
    return out


#: The load that a data file belongs to; files of other writers have none.
_TAG = r"^(?:load|erased)-([^-]+)-"


def file_tag(name):
    """Column: the load of a file by its name; a foreign file is a load by itself."""
    own = F.regexp_extract(name, _TAG, 1)
    return F.when(own != "", own).otherwise(F.concat(F.lit("p"), F.substring(F.md5(name), 1, 16)))


def files_of(spark: SparkSession, table: str) -> list[tuple[str, str, str]]:
    """(path, tag, day) of every data file, from one listing of the table."""
    out = []
    for f in map(unquote, read_events(spark, table).inputFiles()):
        day, name = f.rsplit("/", 2)[1:]
        own = re.match(_TAG, name)
        out.append((f, own[1] if own else "p" + hashlib.md5(name.encode()).hexdigest()[:16], day.split("=", 1)[-1]))
    return out


def files_that_may_hold(spark: SparkSession, table: str, user_id: str) -> list[str]:
    """The files of the loads and days that the user index names, and those of
    loads without an index (other writers')."""
    root = table.rstrip("/")
    named = set()
    if _exists(spark, f"{root}/_users"):
        named = {(r["load"], r["day"]) for r in
                 spark.read.schema("user long, day string, load string").parquet(f"{root}/_users")
                 .where(F.col("user") == F.xxhash64(F.lit(user_id))).select("load", "day").distinct().collect()}
    indexed = {n.split("=", 1)[1] for n in LD.names_in(spark, f"{root}/_users") if n.startswith("load=")}
    return [f for f, tag, day in files_of(spark, root) if tag not in indexed or (tag, day) in named]


def erase_user(spark: SparkSession, table: str, user_id: str, idle_s: float = 3600.0) -> int:
    """Delete every row of ``user_id``; returns the count (0 when run again).

    Only files that may hold the user (``files_that_may_hold``) are opened, and only
    those that do are rewritten: their other rows are written beside them, under
    ``<table>/_staging``, per load, and counted; only if old rows = new rows +
    erased rows are the new files renamed into their days (as ``erased-<load>-*``)
    and exactly the old files deleted.  What is to be renamed and deleted is
    noted first, so an exchange that breaks off is finished by the next erase.  Rows of loads
    that begin during the erase stay.  A reader during the exchange can see a row
    twice, never miss one; followers wait for it.

    The user is also noted in ``<table>/_erased``: a load that began before and ends after
    the erase drops the user itself.  Loads left ready but not finished for
    ``idle_s`` are finished first, and unfinished attempts of that age (their sources
    bring them again) are removed with the rows they hold.
    One erase runs at a time; a second raises ``StoreBusy``.
    """
    if user_id is None:
        raise ValueError("erase_user needs a user id")
    root = table.rstrip("/")
    with LD.lock(spark, f"{root}/_erase/lock"):
        _recover(spark, root)
    before = (time.time() - idle_s) * 1000
    for name in LD.names_in(spark, f"{root}/_staging"):
        own = f"{root}/_staging/{name}"
        if name.startswith("load=") and _exists(spark, f"{own}/_ready"):
            if LD.modified(spark, f"{own}/_ready") <= before:
                _finish(spark, root, int(name.split("=", 1)[1]))
        elif LD.modified(spark, own) <= before:
            _remove(spark, own)
    for name in LD.names_in(spark, f"{root}/_judged"):
        if LD.modified(spark, f"{root}/_judged/{name}") <= before:
            _remove(spark, f"{root}/_judged/{name}")
    LD.put_new(spark, f"{root}/_erased/{uuid.uuid4().hex}", user_id)
    with LD.lock(spark, f"{root}/_erase/lock", wait_s=60):
        return _erase(spark, root, user_id)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _erase(spark: SparkSession, root: str, user_id: str, only: set | None = None) -> int:
    # under the lock: rewrite the files that hold the user (of `only`: (load, day))
    files = files_that_may_hold(spark, root, user_id)
    if only is not None:
        files = [f for f, tag, day in files_of(spark, root) if f in set(files) and (tag, day) in only]
    if not files:
        return 0
    some = spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(*files)
    held = (some.select(F.col("_metadata.file_path").alias("file"), (F.col("user_id") == F.lit(user_id)).alias("mine"))
            .groupBy("file").agg(F.count_if("mine").alias("gone"), F.count(F.lit(1)).alias("rows"))
            .where("gone > 0").collect())
    if not held:
        return 0
    old = [unquote(r["file"]) for r in held]
    gone, rows = sum(r["gone"] for r in held), sum(r["rows"] for r in held)
    name = f"erased-{uuid.uuid4().hex}"
    stage = f"{root}/_staging/{name}"
    (spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(*old)
          .withColumn("__load", file_tag(F.col("_metadata.file_name")))
          .where(~F.col("user_id").eqNullSafe(F.lit(user_id)))
          .transform(by_day).write.mode("overwrite").option("parquet.bloom.filter.enabled#user_id", "true")
          .partitionBy("event_date", "__load").parquet(stage))
    _, sp = _fs(spark, stage)
    left = spark.read.schema(STORE_SCHEMA).parquet(stage)
    if left.count() + gone != rows:
        _remove(spark, stage)
        raise RuntimeError(f"erase_user: {rows} rows read, {gone} to erase, but the rest was not written; nothing was changed")
    moves = []
    for f in left.inputFiles():
        day, tag, own = unquote(f).rsplit("/", 3)[1:]
        tag = tag.split("=", 1)[1]
        moves.append([unquote(f), f"{root}/{day}/erased-{tag}-{name[7:]}-{own.split('-')[1]}{own[own.index('.'):]}"])
    if not LD.put_new(spark, f"{root}/_erase/journal", json.dumps({"moves": moves, "old": old, "stage": stage})):
        raise StoreBusy(f"{root}/_erase/journal is there already")
    _recover(spark, root)
    return gone


def _recover(spark: SparkSession, root: str) -> None:
    """Do what the journal of an erase still asks for; every step may be repeated."""
    journal = LD.text_of(spark, f"{root}/_erase/journal")
    if journal is None:
        return
    jvm, todo = spark._jvm, json.loads(journal)
    fs, _ = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    for src, dst in todo["moves"]:  # before anything old is deleted
        if fs.exists(path(src)):
            fs.mkdirs(path(dst).getParent())
            if fs.exists(path(dst)) or not fs.rename(path(src), path(dst)):
                raise OSError(f"could not commit {src} as {dst}")
        elif not fs.exists(path(dst)):
            raise OSError(f"neither {src} nor {dst} is there")
    for p in map(path, todo["old"]):
        if fs.exists(p) and not fs.delete(p, False):
            raise OSError(f"could not delete {p}")
        day = p.getParent()
        if fs.exists(day) and len(fs.listStatus(day)) == 0:
            fs.delete(day, False)
    _remove(spark, f"{root}/_erase/journal")
    _remove(spark, todo["stage"])


def erasing(spark: SparkSession, table: str) -> bool:
    """Whether an erase is exchanging files now."""
    return _exists(spark, f"{table.rstrip('/')}/_erase/journal")


def drop_before(spark: SparkSession, table: str, cutoff_date: str) -> list[str]:
    """Retention; delete whole day partitions older than ``cutoff_date``
    (``YYYY-MM-DD``).  Returns the dropped days."""
    fs, _ = _fs(spark, table)
    dropped = []
    for day, path in sorted(_partition_dirs(spark, table).items()):
        if day < cutoff_date:
            fs.delete(path, True)
            dropped.append(day)
    return dropped


def session_rows(df: DataFrame, compat: bool = False) -> DataFrame:
    """S10 rows in wire names.  ``compat``: v1 fields only, empty device
    fields as null, only params whose key starts with ``param``."""
    if not compat:
        return df.select(*[F.col(s).alias(w) for w, s, _, _ in FIELDS if s in df.columns])
    cols = []
    for w, s, _, _ in FIELDS:
        if s not in V1_FIELDS:
            continue
        c = F.col(s)
        if s in ("device_manufacturer", "device_model", "tag"):
            c = F.nullif(c, F.lit(""))
        if s == "params":
            m = F.map_filter(c, lambda k, v: k.startswith("param"))
            c = F.when(F.size(m) > 0, m)
        cols.append(c.alias(w))
    return df.select(*cols)


def write_session(df: DataFrame, path: str, compat: bool = False) -> None:
    """Export events.  Default: JSON lines, every field.  ``compat``:
    each output file is one JSON array (the viewer's session format) of the
    v1 fields, written per partition in seq order without gathering rows."""
    rows = session_rows(df.sortWithinPartitions("seq") if "seq" in df.columns else df, compat)
    if not compat:
        rows.write.mode("overwrite").json(path)
        return
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

    def to_array(batches):
        import pandas as pd
        first = True
        for b in batches:
            if len(b) == 0:
                continue
            vals = b["value"].astype(str)
            prefix = pd.Series([","] * len(vals))
            if first:
                prefix.iloc[0] = "["
                first = False
            yield pd.DataFrame({"value": (prefix.values + vals.values)})
        if not first:
            yield pd.DataFrame({"value": ["]"]})

    text.mapInPandas(to_array, "value string").write.mode("overwrite").text(path)
