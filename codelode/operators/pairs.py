"""All pairs of members under a key, dealt in blocks so that a hot key is never one task's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import sent_if_small

#: Members of a block; two blocks meet in one task.
BLOCK = 2000


def pairs_within(rows: DataFrame, keys: Sequence[str], member: str, block: int = BLOCK) -> DataFrame:
    """(keys..., x, y), x < y: all pairs of different members under one key; ``rows`` holds each (keys, member) once.

    A key of more than ``block`` members is cut into blocks by a hash of the member, and each member
    meets every block of its key, so rows are repeated by one for ``block`` pairs that come out. The
    result is the pairs asked for, whose number grows with the square of a key's members. Null keys and
    members pair with nothing; an empty table gives an empty result.
    """
    named = [F.col(f"`{k}`") for k in keys]
    few = sent_if_small(rows.groupBy(*named).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = rows.join(few, list(keys), "left").select(*named, F.col(f"`{member}`").alias("m"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    left = dealt.select(*named, F.col("m").alias("x"), F.pmod(F.xxhash64("m"), "blocks").cast("int").alias("block"))
    right = dealt.select(*named, F.col("m").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, [*keys, "block"]).where("x < y").select(*named, "x", "y")
