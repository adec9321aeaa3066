"""What several corpus operators need: shared folders, files on them, state of Python workers."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.plans.sizing import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    if root.startswith("file:/") and not root.startswith("file:///"):
        root = "file:///" + root.removeprefix("file:").lstrip("/")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """File system and path of a URI, inside a task; any store that pyarrow can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def replace_file(uri: str, write) -> None:
    """Write a file under a name of its own, then move it into place.

    Repeated and speculative attempts of a task write the same bytes, so that whichever
    move comes last leaves a whole file.
    """
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft, compression=None) as out:
        write(out)
    store.move(draft, path)


def worker_state(key: tuple, make):
    """An object kept for all tasks of one Python worker (functions are sent by value).

    A worker keeps one object at a time: that of another key goes when a new one is made, so that the
    stages of a pipeline don't add up in memory.
    """
    name = "_strandline_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    kept = sys.modules[name].kept
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Return memory a task no longer uses to the system, for the JVM and workers beside this one."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(batches):
    """The output of a task's generator, with unused memory given back when it ends."""
    try:
        yield from batches
    finally:
        give_back()


def schema_text(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
