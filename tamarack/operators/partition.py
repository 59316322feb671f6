"""Work shared by hash, and resumed by what is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_partition(id_col: Column, n: int) -> Column:
    """SHA-256 of the id as a 256-bit number modulo n, 16 bits at a time."""
    digest = F.sha2(id_col, 256)
    piece = lambda i: F.conv(F.substring(digest, i * 4 + 1, 4), 16, 10).cast("bigint")
    rest = F.lit(0).cast("bigint")
    for i in range(16):
        rest = (rest * 65536 + piece(i)) % n
    return rest


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done."""
    return todo.join(done.select(key), key, "left_anti")


def owned(todo: DataFrame, key: str, owners: list[str], owner: str, mop_up: bool = False) -> DataFrame:
    """Rows of one owner by hash; all rows in a mop-up run, none for an unlisted owner."""
    if mop_up:
        return todo
    if owner not in owners:
        return todo.limit(0)
    return todo.where(hash_partition(F.col(key), len(owners)) == owners.index(owner))
