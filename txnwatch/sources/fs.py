"""Small file-system helpers over the Hadoop FileSystem API (via the session's
JVM), so paths on HDFS, object stores and ``file:`` all work the same."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """All files below ``path`` (recursive), sorted; hidden and ``_`` files skipped."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if name.startswith((".", "_")):
            continue
        if suffix and not name.lower().endswith(suffix):
            continue
        out.append(st.getPath().toString())
    return sorted(out)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file; false if the target exists already."""
    fs, p = _fs(spark, source)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return not fs.exists(to) and bool(fs.rename(p, to))


def first_line(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        return line or ""
    finally:
        stream.close()


def file_info(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    st = fs.getFileStatus(p)
    return {"path": st.getPath().toString(), "size": int(st.getLen()), "mtime_ms": int(st.getModificationTime())}


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
