"""Names of loads, and who may write them.

A load is known by its origin: a source (a user's own number, or a stream) and a
batch of it.  Each origin owns one load number, which numbers its rows.  Small
files under ``<table>/_loads`` hold this; every one is made by creating a file
that must not exist yet, so of two writers exactly one succeeds:

  ids/<number>    the origin that owns the number
  keys/<origin>   the number that a stream's batch got
  done/<number>   the load is in the store: its rows and their fingerprint

and ``<table>/_commits`` has one record per load in the store, which followers read.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.sql import SparkSession

POS_BITS = 36                          # rows of one load: up to 2^36
MAX_LOAD = (1 << (63 - POS_BITS)) - 1  # load numbers: 0 .. 2^27 - 1
#: Numbers from here on are given to streams; users' own should be below.
FIRST_CLAIMED = 1 << 26
LEASE_S = 6 * 3600


class LoadClash(ValueError):
    """A load number is taken by another load."""


class StoreBusy(RuntimeError):
    """Another process is erasing."""


def jvm_class(spark: SparkSession, name: str):
    """A class of the JVM, looked up once: each step of ``jvm.org.apache...`` asks it anew."""
    known = spark._jvm.__dict__.setdefault("_calltrail_classes", {})
    if name not in known:
        known[name] = getattr(spark._jvm, name)
    return known[name]


def fs_of(spark: SparkSession, path: str):
    p = jvm_class(spark, "org.apache.hadoop.fs.Path")(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    fs, p = fs_of(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = fs_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def text_of(spark: SparkSession, path: str) -> str | None:
    fs, p = fs_of(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm_class(spark, "org.apache.commons.io.IOUtils").toString(stream, "UTF-8")
    finally:
        stream.close()


def at_once(spark: SparkSession, *steps) -> None:
    """Run the first step here and each other in a thread of its own, with this thread's
    job group; ends when all have ended, with the error of one if any failed."""
    errors = []

    def held(step):
        try:
            step()
        except BaseException as e:  # noqa: BLE001
            errors.append(e)

    threads = [InheritableThread(held, args=(step,), session=spark) for step in steps[1:]]
    for t in threads:
        t.start()
    held(steps[0])
    for t in threads:
        t.join()
    if errors:
        raise errors[0]


def _write(spark: SparkSession, path: str, text: str):
    fs, p = fs_of(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return fs, p


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create `path` with its content in one step; False if it is there already.

    The content is written aside and given the name by an operation that
    fails on an existing one: a rename that does not overwrite (HDFS), or a hard link
    on a local disk, where a rename would overwrite.
    """
    fs, p = fs_of(spark, path)
    folder = p.getParent()
    fs.mkdirs(folder)
    _, aside = _write(spark, f"{folder}/.{p.getName()}.{uuid.uuid4().hex}", text)
    try:
        if fs.getUri().getScheme() == "file":
            local = [jvm_class(spark, "java.io.File")(x.toUri().getPath()).toPath() for x in (p, aside)]
            jvm_class(spark, "java.nio.file.Files").createLink(*local)
        else:
            rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
            plain = spark.sparkContext._gateway.new_array(rename, 0)
            jvm_class(spark, "org.apache.hadoop.fs.FileContext").getFileContext(
                fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, p, plain)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(aside, False)


# --- numbers ----------------------------------------------------------------------

def own_number(spark: SparkSession, root: str, number: int) -> None:
    """A user's own load number, good for one origin only."""
    if not 0 <= number <= MAX_LOAD:
        raise ValueError(f"load id {number} is not in 0 .. {MAX_LOAD}")
    origin, path = json.dumps(["load", str(number)]), f"{root}/_loads/ids/{number}"
    if not put_new(spark, path, origin) and text_of(spark, path) != origin:
        raise LoadClash(f"load id {number} is taken by {text_of(spark, path)}")


def claim_number(spark: SparkSession, root: str, source: str, batch) -> int:
    """The number of batch `batch` of `source`, the same whenever it is asked for.

    A new one is the first free from FIRST_CLAIMED on, found by doubling steps
    and halving (numbers are given without gaps), then taken by creating its
    file.  A process that dies in between leaves a number unused; of two that claim the
    same batch at once both get the number whose key file was there first.
    """
    origin = json.dumps([str(source), str(batch)])
    key = f"{root}/_loads/keys/{hashlib.sha256(origin.encode()).hexdigest()}"
    known = text_of(spark, key)
    if known is not None:
        return int(known)
    ids = f"{root}/_loads/ids"
    low, step = FIRST_CLAIMED - 1, 1
    while exists(spark, f"{ids}/{low + step}"):
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if exists(spark, f"{ids}/{mid}") else (low, mid)
    while not put_new(spark, f"{ids}/{high}", origin):
        high += 1
    if high > MAX_LOAD:
        raise ValueError(f"no load number up to {MAX_LOAD} is left")
    if put_new(spark, key, str(high)):
        return high
    return int(text_of(spark, key))


# --- one eraser at a time ---------------------------------------------------------------

@contextmanager
def lock(spark: SparkSession, path: str, wait_s: float = 0.0, lease_s: float = LEASE_S):
    """Hold the file `path`.  One that is older than `lease_s` belongs to a dead
    process and is taken over; otherwise wait `wait_s`, then raise StoreBusy."""
    until = time.time() + wait_s
    while not put_new(spark, path, str(time.time())):
        held = text_of(spark, path)
        if held is not None and time.time() - float(held) > lease_s:
            fs, p = fs_of(spark, path)
            fs.delete(p, False)
        elif time.time() > until:
            raise StoreBusy(f"another erase holds {path}")
        else:
            time.sleep(0.2)
    try:
        yield
    finally:
        fs, p = fs_of(spark, path)
        fs.delete(p, False)
