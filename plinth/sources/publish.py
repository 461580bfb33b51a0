"""Publishing a staged folder: whole or not at all."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import BLOCKED_ARTIFACT, PlinthError
from ..scratch import delete, hadoop


def publish(spark: SparkSession, staged: str, target: str, *, replace: bool = False) -> None:
    """Renames a staged folder to its target.

    A target that holds anything is refused, or with ``replace`` moved away first and deleted
    once the new one is there.
    """
    to, fs = hadoop(spark, target)
    old = None
    if fs.exists(to) and fs.listStatus(to):
        if not replace:
            raise PlinthError(BLOCKED_ARTIFACT, "target is not empty; published artifacts are immutable")
        old = f"{staged}.old"
        fs.rename(to, hadoop(spark, old)[0])
    else:
        fs.delete(to, True)
    fs.mkdirs(to.getParent())
    if not fs.rename(hadoop(spark, staged)[0], to):
        if old is not None:
            fs.rename(hadoop(spark, old)[0], to)
        raise PlinthError(BLOCKED_ARTIFACT, "target can't be published")
    if old is not None:
        delete(spark, old)
