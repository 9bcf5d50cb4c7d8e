"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.session import cut

#: Bytes that stand in a word once A-Z is in lower case: digits, a-z and all of a non-ASCII character.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
TABLE = common.lower_table(WORD_BYTES)


def words(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of digits, letters and non-ASCII characters."""
    return (text or b"").translate(TABLE).split()


def word_hashes(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined texts with words lower-cased and all else blank, word starts, ends, text numbers, 64-bit hashes)."""
    joined = (b" " + b" ".join(texts) + b" ").translate(TABLE)
    blob = np.frombuffer(joined, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(blob != 32)) + 1
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    owner = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    return joined, starts, ends, owner, common.span_hashes(blob, starts, ends)


def chains(h: np.ndarray, owner: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) for n = 1 to width: the hash of the n words from every place from which the text has that many."""
    at = np.arange(len(h))
    now = common.mix(h)
    for n in range(1, width + 1):
        if n > 1:
            keep = np.flatnonzero(at + n - 1 < len(h))
            keep = keep[owner[at[keep] + n - 1] == owner[at[keep]]]
            at = at[keep]
            now = common.mix(now[keep] * np.uint64(0x9E3779B97F4A7C15) + h[at + n - 1] + np.uint64(n))
        yield n, at, now


class NGrams:
    """Windows of benchmark items, as arrays: sorted hashes to search, the words themselves to verify a hit, and the items of each window."""

    def __init__(self, windows: list[bytes], number: np.ndarray, items: np.ndarray, width: int) -> None:
        """windows: distinct, words joined by one space; window number[i] is one of item items[i]."""
        _, _, _, owner, h = word_hashes(windows)
        size = np.bincount(owner, minlength=len(windows))
        first = np.cumsum(size) - size
        codes = np.zeros(len(windows), dtype=np.uint64)
        for n, at, code in chains(h, owner, width):
            mine = np.flatnonzero(size == n)
            codes[mine] = code[np.searchsorted(at, first[mine])]
        self.width, self.lengths = width, set(np.unique(size).tolist())
        order = np.argsort(codes, kind="stable")
        self.codes, self.window = codes[order], order
        self.text = b"".join(windows)
        self.bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, windows), dtype=np.int64, count=len(windows)))))
        order = np.lexsort((items, number))
        self.items = items[order]
        self.item_bounds = np.searchsorted(number[order], np.arange(len(windows) + 1))
        #: One byte for each of 2^22 values of a hash's first bits rules most places out.
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(codes >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number of every word; place, length and window number of every occurrence), in words."""
        joined, starts, ends, owner, h = word_hashes(texts)
        found: list[tuple[int, int, int]] = []
        for n, at, code in chains(h, owner, self.width):
            if n not in self.lengths:
                continue
            likely = np.flatnonzero(self.seen[(code >> np.uint64(42)).astype(np.int64)])
            low = np.searchsorted(self.codes, code[likely])
            for i, j in zip(likely.tolist(), low.tolist()):
                c = code[i]
                said = None
                while j < len(self.codes) and self.codes[j] == c:  # verified on the words, not on the hash
                    w = int(self.window[j])
                    said = said or b" ".join([joined[starts[k] : ends[k]] for k in range(at[i], at[i] + n)])
                    if said == self.text[self.bounds[w] : self.bounds[w + 1]]:
                        found.append((int(at[i]), n, w))
                    j += 1
        place, length, window = (np.array(x, dtype=np.int64) for x in (zip(*found) if found else ([], [], [])))
        return owner, place, length, window

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[int]]]:
        """For each text: number of words, spans of hit words (start, end; those that touch are one), items with occurring windows, ascending."""
        owner, place, length, window = self.hits(texts)
        counts = np.bincount(owner, minlength=len(texts))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[list[int]] = [[] for _ in texts]
        if len(place):
            first = np.cumsum(counts) - counts
            steps = np.bincount(place, minlength=len(owner) + 1) - np.bincount(place + length, minlength=len(owner) + 1)
            hit = np.cumsum(steps)[:-1] > 0
            edge = np.concatenate(([True], owner[1:] != owner[:-1]))
            starts = np.flatnonzero(hit & (edge | ~np.concatenate(([False], hit[:-1]))))
            ends = np.flatnonzero(hit & (np.concatenate((edge[1:], [True])) | ~np.concatenate((hit[1:], [False])))) + 1
            for a, b in zip(starts.tolist(), ends.tolist()):
                i = int(owner[a])
                spans[i].append((a - int(first[i]), b - int(first[i])))
            pairs = np.unique(np.stack((owner[place], window), 1), axis=0)
            for i in np.unique(pairs[:, 0]).tolist():
                mine = pairs[pairs[:, 0] == i, 1].tolist()
                items[i] = np.unique(np.concatenate([self.items[self.item_bounds[w] : self.item_bounds[w + 1]] for w in mine])).tolist()
        return counts, spans, items


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, window array<binary>): width consecutive words, or the whole of a shorter item that has words."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids, out = [], []
                for item, text in zip(part.column("item_id").to_pylist(), common.texts_of(part, "text")):
                    tokens = words(text) if item is not None else []
                    for i in range(max(1, len(tokens) - width + 1) if tokens else 0):
                        ids.append(item)
                        out.append(b" ".join(tokens[i : i + width]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["item_id", "window"])

    return benchmark.select(F.col("item_id").cast("long"), common.text_bytes()).mapInArrow(cut_up, "item_id long, window binary").distinct()


SPANS = "array<struct<start:int,end:int>>"


def scanned(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """(_row, _n_words, _spans, _items): the rows of docs as they are, and what find_hits says of them.

    One block of windows is looked for where the rows are. With more blocks, each is a job of
    its own over the texts, so a worker holds one block's hash set at a time; hits are kept by
    the digest of the text, which is much less than the texts, and joined to the rows at the end.
    """
    spark = docs.sparkSession
    windows = cut(windows_of(benchmark, width), "windows")
    size = windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))

    def block(k: int):  # noqa: ANN202
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k).toArrow()
        coded = part.column("window").combine_chunks().dictionary_encode()
        return spark.sparkContext.broadcast(pickle.dumps(NGrams(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), part.column("item_id").to_numpy(), width)))

    said = f"{common.row_type(docs)}, _n_words bigint, _spans {SPANS}, _items array<bigint>"
    if n_blocks == 1:
        return docs.select(common.packed(docs)).mapInArrow(_scan(block(0)), said)
    key = F.sha2(F.col("text").cast("binary"), 256).alias("key")
    found = None
    for k in range(n_blocks):
        held = block(k)
        hits = docs.select(key, common.text_bytes()).where("text is not null").mapInArrow(_hits(held), f"key string, spans {SPANS}, items array<bigint>")
        hits = cut(hits.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")  # equal texts have equal hits
        held.destroy()
        found = hits if found is None else found.unionByName(hits)
    whole = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("_old"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))  # a row a block
    rows = docs.select(common.packed(docs), key.alias("_key")).join(whole, F.col("_key") == F.col("key"), "left").select("_row", "_old", F.coalesce("_items", F.expr("cast(array() as array<bigint>)")).alias("_items"))
    return rows.mapInArrow(_merged, said)


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans_of(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in found], _SPAN_TYPE)


def _scan(held):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = pickle.loads(held.value)
        for batch in batches:
            for part, texts in common.row_parts(batch):
                counts, spans, items = grams.scan(texts)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(counts.astype(np.int64)), _spans_of(spans), pa.array(items, pa.list_(pa.int64()))], names=["_row", "_n_words", "_spans", "_items"])

    return scan


def _hits(held):  # noqa: ANN001, ANN202
    """Only texts with hits of this block come out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = pickle.loads(held.value)
        for batch in batches:
            for part in common.slices(batch, "text"):
                _, spans, items = grams.scan(common.texts_of(part, "text"))
                hit = [i for i, x in enumerate(spans) if x]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(hit, pa.int64())), _spans_of([spans[i] for i in hit]), pa.array([items[i] for i in hit], pa.list_(pa.int64()))], names=["key", "spans", "items"])

    return scan


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, and the spans of all blocks, as one where they overlap or touch."""
    for batch in batches:
        for part, texts in common.row_parts(batch):
            spans = []
            for old in part.column("_old").to_pylist():
                out: list[tuple[int, int]] = []
                for x, y in sorted((s["start"], s["end"]) for s in old or ()):
                    if out and x <= out[-1][1]:
                        out[-1] = (out[-1][0], max(y, out[-1][1]))
                    else:
                        out.append((x, y))
                spans.append(out)
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([len(words(t)) for t in texts], pa.int64()), _spans_of(spans), part.column("_items")], names=["_row", "_n_words", "_spans", "_items"])


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """docs with _n_words, _spans and _items added (columns of these names give way).

    _spans are the places of words inside benchmark windows, array<struct<start, end>>, with
    spans that overlap or touch as one; _items are the ids of items with an occurring
    window, ascending. So a row's size doesn't grow with the number of occurrences.

    docs needs text; other columns pass through. The hash set is broadcast in blocks of at
    most about block_bytes of window text (with hashes and bounds about twice that), so
    no broadcast grows with the benchmark: one of a single block takes one pass over docs,
    a larger one a pass over the texts for each, one after another, and a join. Null and empty texts and items have no words, so no
    windows and no hits; items without an item_id are left out; repeated rows of either
    table change nothing else.
    """
    found = scanned(docs, benchmark, width, block_bytes)
    return found.select(*common.unpacked(found, "_n_words", "_spans", "_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, drop: str = "documents") -> DataFrame:
    """docs without benchmark text: drop='documents' leaves out every document with a hit, drop='spans' cuts the hit words out.

    A cut span is replaced by one line feed, and n_chars, where there is one, is counted
    anew. Columns, whatever their names, and types stay as they were, null and empty texts
    and repeated rows too; an empty benchmark takes nothing out. Rows are not reordered on
    purpose, but Spark promises no order.
    """
    found = scanned(docs, benchmark, width, 32 << 20)
    if drop == "documents":
        clean = found.where(F.size("_spans") == 0)
        return clean.select(*common.unpacked(clean))
    if drop != "spans":
        raise ValueError("drop is 'documents' or 'spans'")
    clean = found.withColumn("_text", F.pandas_udf(_cut_spans, "string")(F.col("_row.text"), F.col("_spans")))
    anew = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        anew["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[anew.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _cut_spans(text, hits):  # noqa: ANN001, ANN202
    import re

    import pandas as pd

    pattern = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    out = []
    for t, spans in zip(text, hits):
        if t is None or spans is None or not len(spans):
            out.append(t)
            continue
        data = t.encode()
        at = [m.span() for m in pattern.finditer(data)]
        pieces, last = [], 0
        for a, b in sorted((x["start"], x["end"]) for x in spans):
            if at[a][0] >= last:
                pieces.append(data[last : at[a][0]])
            last = max(last, at[b - 1][1])
        out.append(b"\n".join([*pieces, data[last:]]).decode())
    return pd.Series(out)


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of contract 10: words, hit words and occurring items of every document.

    A null document has no words; repeated rows get a row each; a null doc_id stays null;
    other columns are ignored; an empty table gives an empty result.
    """
    found = find_hits(docs.select(F.col("doc_id").cast("long"), "text"), benchmark)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
