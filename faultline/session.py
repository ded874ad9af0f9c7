"""What operators with Python parts need from a session."""

from __future__ import annotations

import atexit
import inspect
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "__faultline_shipped"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    d = tempfile.mkdtemp(prefix="faultline-package-")  # the driver serves it to executors as long as it lives
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, "faultline_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("faultline", os.path.relpath(full, root)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def python_column(f: Callable, kind: str) -> Callable:
    """A vectorised column function of f, made when it is used: f takes pandas series and returns one (a frame for a kind of several columns), and its module reaches the executors."""
    import pandas as pd  # not at the top: workers that need no pandas do not load it

    ship(SparkSession.active())
    f.__annotations__ = {name: pd.Series for name in inspect.signature(f).parameters} | {"return": pd.DataFrame if "," in kind and "<" not in kind else pd.Series}
    return F.pandas_udf(f, kind)


def checkpoints(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder: the one that spark.checkpoint.dir names, or one of this machine for a local master.

    On a cluster a folder of one machine would be lost with it, so a cluster without a shared folder is an error.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared checkpoint folder and read again, without its lineage.

    A table that is read has the size of its files. What checkpoint() returns keeps the estimate of its plan instead, and
    estimates of joins are products: in a loop of joins they soon have more digits than can be multiplied.
    """
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
