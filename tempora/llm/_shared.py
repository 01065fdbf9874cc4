"""Places and tables that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import tempora
from tempora import staging
from tempora.staging import discard, drop_path, new_path, release, settled, shared_dir

__all__ = ["NO_ID", "beside", "discard", "drop_path", "new_path", "plain", "release", "settled", "shared_dir", "ship", "stage"]

#: Stands for a null document id inside the operators and sorts before all others.  It is reserved: a real id of this value counts as null.
NO_ID = -(2**63)


def plain(df: DataFrame) -> DataFrame:
    """df with the columns c0, c1, ...: inside an operator no name of the caller's can clash or need quoting."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("column names repeat")
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def beside(names: list[str], added: list[str]) -> list[str]:
    """names for a table that gets the columns `added`: one that is in use there ends in _input."""
    taken, out = {*names, *added}, []
    for n in names:
        if n in added:
            while n in taken:
                n += "_input"
            taken.add(n)
        out.append(n)
    return out


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: if it is not on PYTHONPATH, send it along with the job's files, once."""
    root = Path(tempora.__file__).resolve().parent.parent
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tempora_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tempora-")) / "tempora_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((root / "tempora").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(at))
    sc._tempora_shipped = True


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    return staging.stage(df, name, codec)
