"""Small files and renames on whatever file system a path names, and folders whose manifests are numbered."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _target(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _target(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an error if there is one."""
    target, fs = _target(spark, path)
    out = fs.create(target, False)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _target(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames where target isn't there yet; False if it is, so that of two writers one has to go on."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(path(source), path(target), options)
    except Exception as error:  # noqa: BLE001 - the gateway wraps Java's
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def manifest(path: str, ordinal: int) -> str:
    return f"{path}/manifests/{ordinal:010d}.json"


def ordinals(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all manifests below path, in order."""
    target, fs = _target(spark, f"{path}/manifests")
    if not fs.exists(target):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(target)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())
