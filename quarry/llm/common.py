"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but these six ASCII white-space characters.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8 ``text``: ``bytes`` methods know
    exactly the ASCII letters and the six ASCII white-space characters."""
    return text.lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local session without that setting gets a temporary folder; a cluster
    without it is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf and sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="quarry-llm-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def once_each(rows: list) -> list:
    """A block's rows in order of their slices, each of which comes once."""
    rows = sorted(rows, key=lambda x: x["slice"])
    if any(a["slice"] == b["slice"] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("two blocks have one name: a slice came twice")
    return rows


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again:
    its lineage is cut, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: CRC-32 for oracles in DuckDB SQL, which has none: a CTE with the table of
#: its 256 remainders (made from the reversed polynomial), and an expression
#: over an ASCII text in a query that also selects from ``crc_table``.
CRC_TABLE_SQL = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)))"""
