"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# The white space that line keys and words are cut at: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, so that Python workers can import it.

    Batches for Python get 16 MB at most unless the session says otherwise: texts can be long.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # Spark's default
        spark.conf.set(BATCH_BYTES, 16 << 20)
    if getattr(sc, "_cohortspark_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cohortspark-"), "cohortspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._cohortspark_sent = True


def give_back() -> None:
    """Return freed memory to the system: allocators keep it otherwise, in idle workers and on the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving memory back to the system when its task ends.

    Workers are used again by later stages, and idle ones would hold on to what they freed.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def sized_chunks(texts: list[str], most: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``most`` characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class WordIds:
    """Ids of words in flat arrays, kept between batches of a task.

    ``encode`` gives the ids of unknown words in a row and how many each has. The table is
    emptied when it holds ``most`` words or ``most_chars`` characters, which bounds a worker's
    memory.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most=400_000, most_chars=16_000_000):
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.sizes, self.chars = array("I"), array("I"), 0

    def ids_of(self, docs: pa.ListArray) -> list[np.ndarray]:
        """For every list of words, the ids of its words in a row."""
        if len(self.slot) > self.most or self.chars > self.most_chars:
            self.clear()
        slot = self.slot
        coded = docs.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in slot]
        if new:
            ids, sizes = self.encode(new)
            slot.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.ids.frombytes(np.asarray(ids, np.uint32).tobytes())
            self.sizes.frombytes(np.asarray(sizes, np.uint32).tobytes())
            self.chars += sum(map(len, new))
        sizes = np.array(self.sizes, np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.array(self.ids, np.uint32)))
        at = np.fromiter(map(slot.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        flat = lists.take(pa.array(at)).flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[at])))
        cuts = ends[np.cumsum(pc.list_value_length(docs).to_numpy())]
        return np.split(flat, cuts[:-1]) if len(docs) else []


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as a list; null is the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def skew_safe_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, share: int = 1000) -> DataFrame:
    """Inner join of ``left`` with one row per key in ``right``, safe for hot keys.

    ``rows`` names the column of ``right`` with the number of left rows of its key. Keys with
    more than one in ``share`` of those rows are fewer than ``share``, so they are broadcast;
    only the rest is shuffled. Both sides should be staged, as they are read more than once.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * share > total
    heavy = F.broadcast(right.where(hot))
    light = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(heavy, keys).unionByName(light.join(right.where(~hot), keys))
