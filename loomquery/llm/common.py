"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomquery.sources.stored import stored

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Write to the shared folder and read back: a lost executor costs a reread, not a recomputation.
cut = stored


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the byte-wise built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def id_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) UTF-8 words. bytes.split cuts at 0x20 and 0x09-0x0D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def levels(n: int, fan_in: int) -> int:
    """Rounds that merge n runs fan_in at a time."""
    return max(1, math.ceil(math.log(max(n, 2), fan_in)))
