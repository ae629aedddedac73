"""Files as an activity: through Hadoop's file system, so that a path may be anywhere that Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def bits(mode: str, default: int = 0o644) -> int:
    """A file mode as scalars.permissions reads it."""
    try:
        return int(mode, 8 if mode.startswith("0") else 10)
    except ValueError:
        return default


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def read_all(self, path: str) -> DataFrame:
        """(value) a row for each file, whole."""
        return self.spark.read.text(path, wholetext=True)

    def _write(self, path: str, content: str, append: bool, mkdirs: bool, mode: str) -> None:
        fs, p = self._at(path)
        if not mkdirs and not fs.exists(p.getParent()):
            raise FileNotFoundError(str(p.getParent()))
        there = append and fs.exists(p)
        had = fs.getFileStatus(p).getPermission() if there else None
        try:
            stream = fs.append(p) if there else fs.create(p, True)
        except Exception as e:  # a file system that can't append, as the local one of Hadoop
            if not there or "Unsupported" not in f"{type(e).__name__} {e}":
                raise
            content = self.read(path) + content
            stream = fs.create(p, True)
        try:
            stream.write(bytearray(content.encode("utf-8")))
        finally:
            stream.close()
        if had is not None and not mode:
            fs.setPermission(p, had)
        if mode:
            fs.setPermission(p, self.spark._jvm.org.apache.hadoop.fs.permission.FsPermission(bits(mode)))

    def write(self, path: str, content: str, mkdirs: bool = False, mode: str = "") -> None:
        """mode: octal if it begins with 0, else decimal; what is no number counts as 0644."""
        self._write(path, content, False, mkdirs, mode)

    def append(self, path: str, content: str, mkdirs: bool = False, mode: str = "") -> None:
        self._write(path, content, True, mkdirs, mode)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdir(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        """One file or empty directory."""
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        fs.delete(p, False)

    def delete_all(self, path: str) -> None:
        """A file or directory with all in it; what isn't there is no error."""
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._at(new)[1]):
            raise OSError(f"{old} can't be renamed to {new}")

    def list(self, path: str) -> list[str]:
        """Names, sorted; a directory's ends with /."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() + ("/" if s.isDirectory() else "") for s in fs.listStatus(p))
