"""Byte-level tokenising and hashing shared by the text operators.

All of it works on Arrow batches inside Spark tasks. A batch is cut into slices of a
few megabytes, so memory in a Python worker doesn't depend on the batch size; only a
single text longer than the slice makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
U64 = np.uint64
#: Steps of a hash that chooses a share of rows, so fine that a share of any table's rows is never rounded to none.
FINE = 1 << 60


def lower_table(word: bytes | None = None) -> bytes:
    """A table for bytes.translate: A-Z to lower case and, where word is given, all bytes outside it to a space."""
    table = bytearray(range(256))
    for c in range(65, 91):
        table[c] = c + 32
    if word is not None:
        for c in range(256):
            if table[c] not in word:
                table[c] = 32
    return bytes(table)


LOWER = lower_table()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch, in order, with about limit bytes in column; at least a row each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths + 16) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def row_parts(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of packed rows, each with its texts as bytes: the text crosses to Python once, inside _row."""
    text = pc.struct_field(batch.column("_row"), "text").cast(pa.binary())
    for part in slices(batch.append_column("_text", text), "_text", limit):
        yield part, texts_of(part, "_text")


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A binary column as bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finisher)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(seed: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([seed], dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))[0]


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, kept between slices."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=U64)
            steps[:1] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of blob[start:end] for every span; equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(blob))
    sums = np.empty(len(blob) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTE[blob] * up[: len(blob)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def spaced_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(blob, starts, ends, text number) of the words between white space bytes."""
    blob = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    white = np.zeros(256, dtype=bool)
    white[list(SPACE)] = True
    edges = np.flatnonzero(np.diff(white[blob])) + 1
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends_of_texts = np.cumsum(lengths + 1)
    return blob, starts, ends, np.searchsorted(ends_of_texts, starts, side="right")


def shingle_hashes(words: np.ndarray, owner: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct k-word shingles of each text, by text; a text of fewer words has its whole sequence."""
    counts = np.bincount(owner, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    chain = words.copy()
    room = np.minimum(counts, k)[owner]  # words in this text's shingles
    at = np.arange(len(words)) - first[owner]
    for j in range(1, k):
        ok = (room > j) & (at + j < counts[owner])
        nxt = np.zeros_like(words)
        nxt[: len(words) - j] = words[j:]
        chain = np.where(ok, mix(chain * U64(0x9E3779B97F4A7C15) + nxt + U64(j)), chain)
    keep = at <= (counts - np.minimum(counts, k))[owner]
    chain, owner = mix(chain[keep] + room[keep].astype(U64)), owner[keep]
    bounds = np.searchsorted(owner, np.arange(n_texts + 1))
    parts = [np.unique(chain[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=n_texts)
    return (np.concatenate(parts) if parts else chain[:0]), np.repeat(np.arange(n_texts), sizes)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def n_words(text: Column) -> Column:
    """Number of words between white space, natively; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, _row: a caller's columns can't clash with an operator's own while they pass through it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def row_type(df: DataFrame) -> str:
    return f"_row {df.select(packed(df)).schema['_row'].dataType.simpleString()}"


def unpacked(df: DataFrame, *added: str) -> list[Column]:
    """The columns of _row, less those that added replace, and then added."""
    return [F.col(f"_row.`{c}`").alias(c) for c in df.schema["_row"].dataType.names if c not in added] + [F.col(c) for c in added]


def text_bytes(text: str = "text") -> Column:
    return F.col(text).cast("binary").alias(text)


def before(df: DataFrame, group: list[str], order: list[Column], value: str, out: str, per_bucket: int = 2_000, together: Column | None = None) -> DataFrame:
    """Add out: the sum of value over the rows of the same group that stand before, in a fixed order.

    A running sum in one window would put a hot group into one task. Here each group is
    dealt into buckets by a hash of the order columns, about per_bucket rows each; a sum
    per bucket and a small running sum over buckets give every bucket its start. The
    order is by bucket, then by the order columns, so it is fixed but not sorted overall.
    Rows that agree in together, where it is given, follow each other; they share a bucket,
    so they have to be few.
    """
    from pyspark.sql import Window

    held = df.withColumn("_order", F.xxhash64(*order) if together is None else F.xxhash64(together))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.ceil(F.col("_n") / per_bucket).alias("_buckets"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    held = held.join(sizes, on, "left").withColumn("_bucket", F.pmod("_order", F.greatest("_buckets", F.lit(1)))).drop("_buckets", *[f"_g_{g}" for g in group])
    starts = held.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(F.col("_order"), *order).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_bucket") == F.col("_b")]
    return held.join(starts, on, "left").withColumn(out, F.col("_start") + F.col("_in")).drop("_order", "_b", "_bucket", "_start", "_in", *[f"_g_{g}" for g in group])


def crc32_sql(column: str) -> str:
    """DuckDB expression: unsigned CRC-32 of an integer column's decimal text, bit by bit; null stays null."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    digits = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"CASE WHEN {column} IS NULL THEN NULL ELSE xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, b: {bits})) END"
