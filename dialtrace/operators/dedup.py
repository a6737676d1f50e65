"""Retransmissions: copies of a message share a checksum."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialtrace.functions.hashing import message_checksum
from dialtrace.operators.ranking import first_per


def without_retransmissions(capture: DataFrame, null_collapses: bool = False) -> DataFrame:
    """Earliest row per checksum, with the checksum as ``chsumm``.

    Copies meet only after each task has cut its own to one, so many copies of one
    message are no hot spot. With ``null_collapses`` all rows with a missing part
    count as copies of one another.
    """
    hashed = capture.withColumn("chsumm", message_checksum(null_collapses))
    return first_per(hashed, ["chsumm"], [F.col("datetime"), F.col("id")])
