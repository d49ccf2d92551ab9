"""Helpers shared by the corpus operators: words, column names, landed tables, hashing."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom.session import ensure_checkpoint_dir, shuffles_dropped

#: bytes of a text -> lower-cased ASCII letters, digits and non-ASCII bytes; everything else becomes a blank
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: the same words as a pattern for Spark and DuckDB, on a text whose A-Z are lower-cased
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: words between white space
TOKEN_PATTERN = r"[^\x20\x09-\x0D]+"
#: A-Z only, so that the number of code points stays
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text's UTF-8 bytes (null: none)."""
    return text.translate(WORD_BYTES).split() if text else []


def bytes_of(column):
    """A text column as UTF-8 bytes; Python then needs no decoding (null: empty)."""
    return F.coalesce(column, F.lit("")).cast("binary")


def fresh(table: DataFrame, *bases: str) -> list[str]:
    """Column names that the table does not have yet, whatever extra columns it carries."""
    taken, out = {c.lower() for c in table.columns}, []
    for base in bases:
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def refused(table: DataFrame, *names: str) -> None:
    """Refuses output names that the table already has, whatever their case."""
    taken = {c.lower() for c in table.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the table already has {', '.join(sorted(taken))}; name another output column")


def landed(table: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the table to the shared checkpoint folder and reads it again."""
    spark = table.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def mixed(values: np.ndarray) -> np.ndarray:
    """A strong 64-bit mix of each value (wraps silently)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= _MIX[0]
        x ^= x >> np.uint64(27)
        x *= _MIX[1]
        x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __init__(self, keep: int = 400_000):
        self.keep, self.known = keep, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(out)
