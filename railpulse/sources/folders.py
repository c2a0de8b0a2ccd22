"""Table folders and small files of a store, on whatever file system it lies."""

from __future__ import annotations

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """(path object, file system) of a location."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.exists(p)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds any data file; hidden names (``_``, ``.``) do not count."""
    p, fs = hadoop(spark, path)
    if not fs.exists(p):
        return False
    files = fs.listFiles(p, True)
    root = fs.makeQualified(p).toString()
    while files.hasNext():
        below = files.next().getPath().toString().removeprefix(root)
        if not any(x.startswith((".", "_")) for x in below.split("/")):
            return True
    return False


def children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names below ``path`` that begin with ``prefix``."""
    p, fs = hadoop(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(prefix))


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = hadoop(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def files(spark: SparkSession, path: str) -> list[str]:
    """Data files right in a folder, not in folders of it."""
    p, fs = hadoop(spark, path)
    found = (s.getPath() for s in fs.listStatus(p) if s.isFile())
    return sorted(f.toString() for f in found if not f.getName().startswith((".", "_")))


def move(spark: SparkSession, src: str, dst: str) -> None:
    """Rename a folder, in place of one of that name that nothing reads yet."""
    s, fs = hadoop(spark, src)
    d, _ = hadoop(spark, dst)
    fs.delete(d, True)
    fs.mkdirs(d.getParent())
    if not fs.rename(s, d):
        raise OSError(f"{src} could not be renamed to {dst}")


def rename_new(spark: SparkSession, src: str, dst: str) -> bool:
    """Rename a file to a name that must be free; if it is not, the file goes and the answer is False."""
    s, fs = hadoop(spark, src)
    d, _ = hadoop(spark, dst)
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(s).toUri(), spark._jsc.hadoopConfiguration())
    free = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    free[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(fs.makeQualified(s), fs.makeQualified(d), free)
    except Exception as e:
        if fs.exists(d):
            fs.delete(s, False)
            return False
        raise OSError(f"{src} could not be renamed to {dst}") from e
    return True


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop(spark, path)
    fs.delete(p, True)
