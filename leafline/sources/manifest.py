"""Sets of files that change all at once: data first, then one manifest that readers go by.

Each set is written to a folder of its own that no reader knows.  A manifest names the
folder of every set; manifests are numbered, and the one with the highest number counts.
It is written beside its place and renamed, so it is there whole or not at all.  Two
writers cannot both make the same number: the second one reads the new manifest and tries
the next.  So a reader sees each set as it was before a commit or after it, never a
part, and a writer that dies leaves folders that no manifest names (``unnamed``).

Defined results: a set that was never published is refused by name; an empty table is a
set like any other; publishing the same rows again makes a new folder of equal rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MOST_TRIES = 20


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    where, fs = _fs(spark, f"{root}/manifests")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The number of the manifest that counts, and the folder of each set; 0 without any."""
    numbers = _numbers(spark, root)
    if not numbers:
        return 0, {}
    return numbers[-1], json.loads(spark.read.text(f"{root}/manifests/{numbers[-1]:010d}.json", wholetext=True).first()[0])


def write(df: DataFrame, root: str, name: str) -> str:
    """The folder of a set's new rows, which no manifest names yet."""
    folder = f"{root}/sets/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def commit(spark: SparkSession, root: str, folders: dict[str, str]) -> int:
    """Makes the folders those of their sets, all at once; sets that are not named stay.  The new number."""
    for _ in range(MOST_TRIES):
        number, sets = current(spark, root)
        if _placed(spark, root, number + 1, json.dumps(sets | folders, sort_keys=True)):
            return number + 1
    raise RuntimeError(f"other writers were first {MOST_TRIES} times")


def _placed(spark: SparkSession, root: str, number: int, body: str) -> bool:
    """Whether the manifest of a number could be made; not if another writer has made it."""
    jvm = spark.sparkContext._jvm
    own, fs = _fs(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(own)
    out.write(bytearray(body.encode()))
    out.close()
    target, _ = _fs(spark, f"{root}/manifests/{number:010d}.json")
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        # unlike the plain rename of some file systems this one never takes another's place
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(own), fs.makeQualified(target), none)
    except Exception as error:  # noqa: BLE001
        fs.delete(own, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def publish(df: DataFrame, root: str, name: str) -> int:
    return commit(df.sparkSession, root, {name: write(df, root, name)})


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a set as of the manifest that counts now."""
    _, sets = current(spark, root)
    if name not in sets:
        raise KeyError(f"no set {name} was published")
    return spark.read.parquet(sets[name])


def unnamed(spark: SparkSession, root: str) -> list[str]:
    """Folders that the manifest that counts does not name: older rows, and those of writers that died."""
    where, fs = _fs(spark, f"{root}/sets")
    if not fs.exists(where):
        return []
    named = {f.rsplit("/", 1)[1] for f in current(spark, root)[1].values()}
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName() not in named)
