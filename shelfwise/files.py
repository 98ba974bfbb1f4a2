"""Files of any store Spark reaches, through its Hadoop file systems: list, delete, rename, small texts.

All paths are strings as Spark takes them (``/data``, ``hdfs://...``, ``s3a://...``). Nothing here opens
a path with the machine's own file functions, so a shared store behaves like a local folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

COPY_BYTES = 1 << 20


@dataclass(frozen=True)
class FileEntry:
    path: str
    length: int
    modified: int


def _open(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path, fs = _open(spark, path)
    return bool(fs.exists(jvm_path))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; nothing happens if there is none."""
    jvm_path, fs = _open(spark, path)
    fs.delete(jvm_path, True)


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, from the file system's own summary; 0 if there is none."""
    jvm_path, fs = _open(spark, path)
    return int(fs.getContentSummary(jvm_path).getLength()) if fs.exists(jvm_path) else 0


def listing(spark: SparkSession, path: str) -> list[FileEntry]:
    """Every file under ``path``, by path; hidden ones (``_`` or ``.`` in front) are left out."""
    jvm_path, fs = _open(spark, path)
    if not fs.exists(jvm_path):
        return []
    found, files = [], fs.listFiles(jvm_path, True)
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append(FileEntry(str(status.getPath()), int(status.getLen()), int(status.getModificationTime())))
    return sorted(found, key=lambda f: f.path)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Moves a staged file or folder to ``path`` and so replaces what is there. A file is replaced in one
    rename; a folder's predecessor is deleted right before it."""
    source, fs = _open(spark, staged)
    target, _ = _open(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getFileStatus(source).isDirectory() or (fs.exists(target) and fs.getFileStatus(target).isDirectory()):
        fs.delete(target, True)
    java = spark._jvm.org.apache.hadoop.fs
    overwrite = spark._sc._gateway.new_array(java.Options.Rename, 1)
    overwrite[0] = java.Options.Rename.OVERWRITE
    context = java.FileContext.getFileContext(fs.makeQualified(source).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(source), fs.makeQualified(target), overwrite)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None if there is none."""
    jvm_path, fs = _open(spark, path)
    if not fs.exists(jvm_path):
        return None
    stream = fs.open(jvm_path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


#: A header line is looked for in this many bytes.
HEADER_BYTES = 1 << 20
#: File systems answer several requests at a time.
THREADS = 16


def _first_line(spark: SparkSession, path: str) -> str | None:
    jvm_path, fs = _open(spark, path)
    java = spark._jvm
    codec = java.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(jvm_path)
    stream = fs.open(jvm_path)
    try:
        data = stream if codec is None else codec.createInputStream(stream)
        bounded = java.org.apache.commons.io.input.BoundedInputStream(data, HEADER_BYTES)
        return java.java.io.BufferedReader(java.java.io.InputStreamReader(bounded, "UTF-8")).readLine()
    finally:
        stream.close()


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """The first line of each file (None if it is empty), packed files unpacked. Only the beginning of a file is
    read, as a listing reads its metadata."""
    with ThreadPoolExecutor(THREADS) as pool:
        return dict(zip(paths, pool.map(lambda p: _first_line(spark, p), paths)))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, complete or absent: it is written aside and moved in place."""
    aside = f"{path}.new"
    jvm_path, fs = _open(spark, aside)
    stream = fs.create(jvm_path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    publish(spark, aside, path)


def join_files(spark: SparkSession, parts: list[str], path: str) -> None:
    """The parts, in their order, as one file at ``path``.

    A file system that can join files does so without moving a byte (HDFS ``concat``); elsewhere they are
    copied through one buffer of ``COPY_BYTES``, so memory does not grow with them. The parts are gone
    or may be deleted afterwards.
    """
    if not parts:
        raise ValueError("no parts to join")
    first, fs = _open(spark, parts[0])
    target, _ = _open(spark, path)
    if len(parts) > 1 and fs.getScheme() == "hdfs":
        rest = [p for p in parts[1:] if total_bytes(spark, p)]
        array = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(rest))
        for i, part in enumerate(rest):
            array[i] = spark._jvm.org.apache.hadoop.fs.Path(part)
        try:
            if rest:
                fs.concat(first, array)
            publish(spark, parts[0], path)
            return
        except Py4JJavaError as exc:
            if "UnsupportedOperationException" not in str(exc.java_exception):
                raise
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = fs.create(target, True)
    try:
        for part in parts:
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(part))
            try:
                copy(stream, out, COPY_BYTES, False)
            finally:
                stream.close()
    finally:
        out.close()
