"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import checkpoint_dir


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str = "t") -> tuple[DataFrame, str]:
    """Cut lineage: write a parquet table to the shared folder; it, read back, and its path."""
    out = work_dir(df.sparkSession, what)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out), out


def save(df: DataFrame, what: str = "t") -> DataFrame:
    return store(df, what)[0]


def share(spark: SparkSession, thing):
    """Broadcast an object of this package by value; ``held`` gives it back, one copy a worker."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast({"bytes": cloudpickle.dumps(thing)})


def held(shared):
    import pickle

    box = shared.value
    if "thing" not in box:
        box["thing"] = pickle.loads(box.pop("bytes"))
    return box["thing"]


def fold_of(doc_id) -> "F.Column":
    """Fold 0..4 of a document: crc32 of its id as text, mod 5 (fold 0 is held out)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) reduced to one link per node, to the least node of its group.

    The reduction keeps connectivity and is at most as long as the node list,
    so a dense tile of k x k links leaves its task as fewer than 2k rows.
    """
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def sealed(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns ``used`` under these names and the others as given_0, given_1, ..., so that no name can clash.

    Also the inner name of each given one, in the given order.
    """
    inner = {c: c if c in used else f"given_{n}" for n, c in enumerate(docs.columns)}
    return docs.toDF(*inner.values()), inner


def unsealed(inner: dict[str, str], results=()) -> list["F.Column"]:
    """The given columns back under their names, without those named like ``results`` in any case."""
    taken = {r.lower() for r in results}
    return [F.col(i).alias(c) for c, i in inner.items() if c.lower() not in taken]
