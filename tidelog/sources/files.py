"""Files through Spark's own file systems: small texts that appear whole or not at all, listings, removals."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        path = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        path, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a new file and give it its name in one step; false if that name is taken."""
        temporary, fs = self._at(f".{name.replace('/', '-')}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}")
        final, _ = self._at(name)
        stream = fs.create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.mkdirs(final.getParent())
        rename = self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(temporary, final, options)
        except Exception as error:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        path, fs = self._at(name)
        fs.delete(path, True)
