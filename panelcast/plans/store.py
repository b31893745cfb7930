"""A store of fitted state by content: the same rows and parameters are fitted once, whichever session asks.

A key is a hash of a fingerprint of the rows, of the parameters and of the version of the code. What is stored for it
is written to a folder of its own; a pointer file, put in place by one rename, then makes it visible, so that a reader
meets all of it or nothing and two writers do not disturb each other.
"""

from __future__ import annotations

import getpass
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import CHECKPOINT_KEY, shared_dir

#: Setting that names the folder of the store; without it, one beside the session's checkpoints.
STORE_KEY = "spark.panelcast.models.dir"
#: Raised when what is fitted from the same rows and parameters changes.
VERSION = 3


def store_dir(spark: SparkSession) -> str:
    """Where fitted state is kept. A local session without any setting uses a folder of its user, on the one machine
    it has; a cluster has to name a shared one."""
    named = spark.conf.get(STORE_KEY, None)
    if named:
        return named.rstrip("/")
    conf = spark.sparkContext.getConf()
    if spark.sparkContext.master.startswith("local") and not (conf.get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)):
        return f"{tempfile.gettempdir()}/panelcast-models-{getpass.getuser()}"
    return f"{shared_dir(spark)}/panelcast-models"


def fingerprint(df: DataFrame) -> str:
    """A text that depends on the columns and on the rows of ``df`` but not on their order, in one pass."""
    columns = sorted(df.columns)
    one, two = F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in columns])
    got = df.select(one.alias("one"), two.alias("two")).agg(
        F.count(F.lit(1)), F.bit_xor("one"), F.sum(F.col("one").cast("decimal(20,0)")), F.sum(F.col("two").cast("decimal(20,0)"))
    ).first()
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in columns]
    return hashlib.sha256(json.dumps([kinds, *map(str, got)]).encode()).hexdigest()


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or store_dir(spark)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def key(self, kind: str, content: str, **params: Any) -> str:
        """The key of what ``kind`` with ``params`` makes of rows with the fingerprint ``content``."""
        whole = json.dumps([VERSION, kind, content, params], sort_keys=True, default=str)
        return f"{kind}-{hashlib.sha256(whole.encode()).hexdigest()[:40]}"

    def find(self, key: str) -> str | None:
        """The folder stored under a key."""
        path, fs = self._path(f"{self.root}/keys/{key}")
        if not fs.exists(path):
            return None
        name = self.spark.read.text(f"{self.root}/keys/{key}").first()[0]
        folder, fs = self._path(f"{self.root}/objects/{name}")
        return f"{self.root}/objects/{name}" if fs.exists(folder) else None

    def put(self, key: str, write: Callable[[str], None]) -> str:
        """Let ``write`` fill a new folder, then point the key to it. The folder of a pointer that it replaces stays,
        as others may be reading it."""
        name = f"{key}-{uuid.uuid4().hex[:12]}"
        write(f"{self.root}/objects/{name}")
        fresh, fs = self._path(f"{self.root}/keys/.{name}")
        out = fs.create(fresh, True)
        out.write(bytearray(name.encode()))
        out.close()
        pointer, _ = self._path(f"{self.root}/keys/{key}")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        onto = gateway.new_array(kind, 1)
        onto[0] = kind.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(files.makeQualified(fresh), files.makeQualified(pointer), onto)
        return f"{self.root}/objects/{name}"

    def get(self, key: str, write: Callable[[str], None]) -> str:
        """The folder stored under a key, filled first if there is none."""
        return self.find(key) or self.put(key, write)
