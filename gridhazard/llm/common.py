"""Session settings and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridhazard.session import configure

#: Rows and bytes of an Arrow batch sent to Python; texts are long, so batches are kept well below the defaults.
BATCH_ROWS, BATCH_BYTES = "2000", "16m"
#: For operators whose tasks hold what they make of a whole batch.
SMALL_BATCH_BYTES = "4m"
#: Bytes of text such an operator works on at once.
SMALL_CHUNK_BYTES = 1 << 20


def prepare(spark: SparkSession, batch_bytes=BATCH_BYTES) -> SparkSession:
    """The library's settings and smaller Arrow batches. Functions for tasks travel with the jobs."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    return spark


def held_out(id_col="doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 2 modulo 4. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def draw(column):
    """A number from 0 up to 1 out of 53 bits of a hash, even enough for rates of one in 1e12 rows."""
    return F.shiftrightunsigned(column, 11).cast("double") * F.lit(2.0 ** -53)
