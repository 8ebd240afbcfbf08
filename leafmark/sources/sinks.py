"""Sinks that never overwrite, and the record store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafmark.operators.records import upsert


def check_new(spark, outputs: list[str], inputs: list[str]) -> None:
    """All destinations must be distinct, new and no inputs."""
    if len(set(outputs)) != len(outputs) or set(outputs) & set(inputs):
        raise ValueError("destinations must be distinct and no inputs")
    jvm = spark.sparkContext._jvm
    for out in outputs:
        path = jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileExistsError(out)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").option("encoding", "UTF-8").csv(path)


def save_baseline(baseline: DataFrame, current: DataFrame, path: str, key: str = "evaluation") -> None:
    """A new baseline at a new path: evaluations that ran replaced, ordered within files."""
    upsert(baseline, current, key).repartition(key).sortWithinPartitions(*[c for c in (key, "case", "step") if c in current.columns]).write.mode("errorifexists").parquet(path)


def append_changes(changes: DataFrame, reason: str, path: str) -> None:
    from pyspark.sql import functions as F

    changes.withColumn("reason", F.lit(reason)).write.mode("append").json(path)


def _files(spark, folder: str) -> dict[str, str]:
    """Every file below a folder, by its path from there, with the digest of its bytes; read by the executors."""
    from pyspark.sql import functions as F

    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(root).toString().rstrip("/")
    # names that begin with _ or . are hidden from readers: those of bundles don't
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("digest")).collect()
    at = lambda p: p.split(":", 1)[-1].lstrip("/")  # noqa: E731  with or without an authority
    return {at(r.path).removeprefix(at(root)).lstrip("/"): r.digest for r in found}


def publish(spark, destination: str, files: dict[str, bytes | DataFrame]) -> dict[str, str]:
    """Publish several files as one folder, all or none: (file: digest).

    Bytes (small: they come from the driver) become a file each, tables a
    folder of Parquet files.  All are written into a folder beside the
    destination, read back there, and moved by one rename, after which they
    are read again.  If anything fails, both folders are withdrawn.  A
    destination that exists is an error, as are names that begin with `_` or
    `.` or lead elsewhere.  Works on any store that Hadoop renames folders in.
    """
    import hashlib
    import uuid

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(destination)
    fs = path.getFileSystem(conf)
    if not files or any(name[:1] in "_./" or ".." in name for name in files):
        raise ValueError("names of files begin with neither _ nor . and stay in the folder")
    if fs.exists(path):
        raise FileExistsError(destination)
    staged = jvm.org.apache.hadoop.fs.Path(path.getParent(), f"{path.getName()}-{uuid.uuid4().hex}.staged")
    moved = False
    try:
        want = {}
        for name, content in files.items():
            if isinstance(content, DataFrame):
                content.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{staged}/{name}")
                continue
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staged}/{name}"), False)
            try:
                out.write(bytearray(content))
            finally:
                out.close()
            want[name] = hashlib.sha256(content).hexdigest()
        found = _files(spark, str(staged))
        missing = [n for n in files if not any(f == n or f.startswith(n + "/") for f in found)]
        if missing or any(found[n] != d for n, d in want.items()):
            raise OSError(f"what was staged isn't what was written: {missing or sorted(want)}")
        if fs.exists(path) or not fs.rename(staged, path):
            raise OSError(f"{destination} can't be published")
        moved = True
        if _files(spark, destination) != found:
            raise OSError(f"{destination} changed while it was published")
        return found
    except BaseException:
        fs.delete(staged, True)
        if moved:
            fs.delete(path, True)
        raise
