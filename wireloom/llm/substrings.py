"""Substring dedup: words inside any window of 35 words that stands twice are found and taken out, whatever documents it stands in.

Windows travel by super-k-mers: consecutive windows that share a minimiser (the least
hash of the runs of MER words inside a window) go as one string of words to the
minimiser's bucket. Equal windows have equal minimisers, so all of them meet there,
where sorting counts them. Places are not carried along: a second scan of the texts looks
its strings up among those that came out repeated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.llm.common import U64, mix, signed
from wireloom.session import cut

WIDTH = 35
MER = 5
#: Windows in one string at most; a longer run (one word over and over) is cut.
MOST_WINDOWS = 256
#: Strings that a task combines before it sends them, and of one bucket that it counts itself, in bytes.
COMBINE_BYTES = 12 << 20
BUCKET_BYTES = 8 << 20
#: Documents looked at for minimisers that are frequent enough to be split.
SAMPLE_DOCUMENTS = 20_000
SPREAD = U64(0x9E3779B97F4A7C15)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, by doubling."""
    span, low = 1, v
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


class Pieces:
    """The super-k-mers of some texts: piece i is bytes [a[i]:b[i]] of blob, its first word is word at[i] of text owner[i], its bucket code[i]."""

    def __init__(self, texts: list[bytes], width: int, frequent: np.ndarray) -> None:
        blob, starts, ends, owner = common.spaced_words([b" ".join(t.split()) for t in texts])
        counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=np.int64)
        self.blob, self.counts, n = blob, counts, len(starts) - width + 1
        self.a = self.b = self.at = self.owner = np.zeros(0, dtype=np.int64)
        self.code = self.check = np.zeros(0, dtype=U64)
        self.single = np.zeros(0, dtype=bool)
        if n <= 0:
            return
        h = common.span_hashes(blob, starts, ends)
        mer = min(MER, width)
        chain = h[: len(h) - mer + 1]
        for j in range(1, mer):
            chain = mix(chain * SPREAD + h[j : len(h) - mer + 1 + j])
        least = sliding_min(chain, width - mer + 1)
        whole = owner[:n] == owner[width - 1 :]
        fresh = whole.copy()
        fresh[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
        begin = np.flatnonzero(fresh)
        if not len(begin):
            return
        run = np.cumsum(fresh) - 1
        inside = np.arange(n) - begin[np.maximum(run, 0)]
        hot = whole & np.isin(least, frequent)
        first = np.flatnonzero(whole & ((inside % MOST_WINDOWS == 0) | hot))
        piece = np.searchsorted(first, np.flatnonzero(whole), side="right") - 1
        size = np.bincount(piece, minlength=len(first))
        self.single = hot[first]
        self.a, self.b = starts[first], ends[first + size + width - 2]
        self.check = common.span_hashes(blob, self.a, self.b)
        self.code = np.where(self.single, mix(self.check + U64(1)), least[first])
        self.owner = owner[first]
        self.at = first - (np.cumsum(counts) - counts)[self.owner]
        self.size = size

    def text(self, i: int) -> bytes:
        return self.blob[self.a[i] : self.b[i]].tobytes()


def _slices(batches: Iterator[pa.RecordBatch], width: int, frequent: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Pieces]]:
    for batch in batches:
        for part in common.slices(batch, "text"):
            yield part, Pieces(common.texts_of(part, "text"), width, frequent)


def _strings(width: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(code, piece, n): equal strings of a task are combined, about COMBINE_BYTES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            keys, n = list(held), list(held.values())
            for i in range(0, len(keys), 10_000):
                code, piece = zip(*keys[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([signed(np.array(code, dtype=U64)), pa.array(piece, pa.binary()), pa.array(n[i : i + 10_000], pa.int64())], names=["code", "piece", "n"])
            held.clear()

        for _, p in _slices(batches, width, frequent):
            blob = p.blob.tobytes()
            for code, a, b in zip(p.code.tolist(), p.a.tolist(), p.b.tolist()):
                key = (code, blob[a:b])
                if key in held:
                    held[key] += 1
                else:
                    held[key] = 1
                    size += b - a + 150
            if size > COMBINE_BYTES:
                yield from emit()
                size = 0
        yield from emit()

    return run


def _places(width: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc, seal, at, code, check) of every string, from the same cutting as _strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p in _slices(batches, width, frequent):
            doc, seal = (part.column(c).take(pa.array(p.owner)) for c in ("doc", "seal"))
            yield pa.RecordBatch.from_arrays([doc, seal, pa.array(p.at.astype(np.int32)), signed(p.code), signed(p.check)], names=["doc", "seal", "at", "code", "check"])

    return run


COUNTED = "code long, check long, covered array<int>, at int, head long, tail long, n long"
_COUNTED = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def _windows(pieces: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(blob; piece number, first byte, last byte, hash of the first half, hash of the rest) of every window of the strings."""
    blob, starts, ends, owner = common.spaced_words(pieces)
    n = len(starts) - width + 1
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    a, b, half = starts[first], ends[first + width - 1], width // 2
    head = common.span_hashes(blob, a, ends[first + max(half - 1, 0)])
    tail = common.span_hashes(blob, starts[first + half], b)
    return blob.tobytes(), owner[first], a, b, head, tail


def _covers(codes: np.ndarray, pieces: list[bytes], n: np.ndarray, width: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """(piece number, words covered by repeated windows as [from, to, from, to, ...]) of whole buckets."""
    blob, owner, a, b, head, tail = _windows(pieces, width)
    order = np.lexsort((tail, head, codes[owner]))
    o, x, y = codes[owner][order], head[order], tail[order]
    same = (o[1:] == o[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    left, right = order[:-1][same].tolist(), order[1:][same].tolist()
    if all(blob[a[i] : b[i]] == blob[a[j] : b[j]] for i, j in zip(left, right)):  # counted on the words, not on their hashes
        edge = np.flatnonzero(np.concatenate(([True], ~same)))
        total = np.add.reduceat(n[owner][order], edge)
        twice = np.zeros(len(order), dtype=bool)
        twice[order] = np.repeat(total >= 2, np.diff(np.append(edge, len(order))))
    else:
        keys = [(c, blob[i:j]) for c, i, j in zip(codes[owner].tolist(), a.tolist(), b.tolist())]
        counts: Counter = Counter()
        for key, m in zip(keys, n[owner].tolist()):
            counts[key] += m
        twice = np.array([counts[k] >= 2 for k in keys], dtype=bool)
    bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
    for i in np.unique(owner[twice]).tolist():
        yield i, runs(np.flatnonzero(twice[bounds[i] : bounds[i + 1]]), width)


def runs(windows: np.ndarray, width: int) -> list[int]:
    """Words covered by windows that start at these words, as [from, to, from, to, ...]."""
    gap = np.flatnonzero(np.diff(windows) > width)
    first, last = np.concatenate((windows[:1], windows[gap + 1])), np.concatenate((windows[gap], windows[-1:])) + width
    return np.stack((first, last), 1).ravel().tolist()


def _counted(width: int, bucket_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Covered words of every string with repeated windows, from rows in order of code. A bucket of more than bucket_bytes is given on window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}  # strings of whole buckets and of the one that is being read, equal ones once
        size = bucket = 0  # bytes held, and of the bucket being read
        now, large = None, False
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(_COUNTED)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _COUNTED)], names=[x.split()[0] for x in COUNTED.split(", ")])

        def checks(pieces: list[bytes]) -> list[int]:
            blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
            return common.span_hashes(blob, np.concatenate(([0], ends[:-1])), ends).view(np.int64).tolist()

        def columns(rows: dict[tuple[int, bytes], int]) -> tuple[tuple, tuple, list]:
            codes, pieces = zip(*rows)
            return codes, pieces, list(rows.values())

        def count(rows: dict[tuple[int, bytes], int]) -> None:
            if not rows:
                return
            codes, pieces, n = columns(rows)
            known = checks(list(pieces))
            for i, covered in _covers(np.array(codes), list(pieces), np.array(n), width):
                out.append((codes[i], known[i], covered, None, None, None, None))

        def spread(rows: dict[tuple[int, bytes], int]) -> None:
            if not rows:
                return
            codes, pieces, n = columns(rows)
            known = checks(list(pieces))
            _, owner, a, _, head, tail = _windows(list(pieces), width)
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            for i, k, x, y in zip(owner.tolist(), place.tolist(), head.view(np.int64).tolist(), tail.view(np.int64).tolist()):
                out.append((codes[i], known[i], None, k, x, y, n[i]))

        for batch in batches:
            for code, piece, n in zip(*(batch.column(c).to_pylist() for c in ("code", "piece", "n"))):
                if code != now:
                    if large or size > bucket_bytes:
                        (spread if large else count)(held)
                        held, size = {}, 0
                    now, large, bucket = code, False, 0
                if (code, piece) in held:
                    held[code, piece] += n
                    continue
                held[code, piece] = n
                size += len(piece)
                bucket += len(piece)
                if bucket > bucket_bytes and not large:
                    large = True
                    count({k: v for k, v in held.items() if k[0] != now})
                    held = {k: v for k, v in held.items() if k[0] == now}
                if large and size > bucket_bytes:
                    spread(held)
                    held, size = {}, 0
                if len(out) > 5000:
                    yield emit()
        (spread if large else count)(held)
        yield emit()

    return run


def frequent_codes(keyed: DataFrame, width: int) -> np.ndarray:
    """Minimisers of at least a thousandth of the strings in a sample of SAMPLE_DOCUMENTS documents, so a thousand at most.

    Their windows travel one by one, each to a bucket of its own. The sample decides only
    which bucket a window goes to, never whether it counts.
    """
    n = keyed.count()
    part = keyed.sample(min(1.0, SAMPLE_DOCUMENTS / max(1, n)), seed=7)
    none = np.zeros(0, dtype=U64)
    counts = part.mapInArrow(_places(width, none), "doc long, seal long, at int, code long, check long").groupBy("code").agg(F.count(F.lit(1)).alias("m"))
    counts = cut(counts, "codes", rows=SAMPLE_DOCUMENTS)
    total = counts.agg(F.sum("m")).first()[0] or 0
    rows = counts.where(F.col("m") >= max(20, total / 1000)).select("code").collect()
    return np.array([r[0] for r in rows], dtype=np.int64).view(U64)


def covered_words(keyed: DataFrame, width: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, seal, places): where rows (doc, seal, text) have repeated windows, as array<struct<at, covered>>."""
    frequent = frequent_codes(keyed, width)
    strings = keyed.select("text").mapInArrow(_strings(width, frequent), "code long, piece binary, n long")
    counted = strings.repartition("code").sortWithinPartitions("code").mapInArrow(_counted(width, bucket_bytes), COUNTED)
    counted = cut(counted, "counted")
    found = counted.where("covered is not null").select("code", "check", "covered")
    windows = counted.where("covered is null")
    twice = windows.groupBy("code", "head", "tail").agg(F.sum("n").alias("n")).where("n >= 2").drop("n")
    more = windows.join(twice, ["code", "head", "tail"]).groupBy("code", "check").agg(F.collect_set("at").alias("ats"))  # MOST_WINDOWS at most
    more = more.select("code", "check", F.flatten(F.transform(F.sort_array("ats"), lambda i: F.array(i, i + width))).alias("covered"))
    places = keyed.mapInArrow(_places(width, frequent), "doc long, seal long, at int, code long, check long")
    hits = places.join(found.unionByName(more), ["code", "check"])
    return hits.groupBy("doc", "seal").agg(F.collect_set(F.struct("at", "covered")).alias("places"))  # no more than the text has strings


FOUND = "_n_words long, _spans array<struct<start:int,end:int>>, _kept string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part, texts in common.row_parts(batch):
            n_words, spans, kept = [], [], []
            for text, places in zip(texts, part.column("places").to_pylist()):
                words = text.split()
                hit = np.zeros(len(words) + 1, dtype=np.int64)
                for p in places or ():
                    edges = np.array(p["covered"], dtype=np.int64) + p["at"]
                    np.add.at(hit, edges[0::2], 1)
                    np.add.at(hit, edges[1::2], -1)
                gone = np.concatenate(([False], np.cumsum(hit)[:-1] > 0, [False]))
                edge = np.flatnonzero(np.diff(gone))
                last, pieces = 0, []
                for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                    pieces += words[last:a]
                    last = b
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())])
                kept.append(b" ".join([*pieces, *words[last:]]).decode())
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["_row", "_n_words", "_spans", "_kept"])


def _found(docs: DataFrame, width: int, bucket_bytes: int) -> DataFrame:
    """(_row, _n_words, _spans, _kept)."""
    seal = F.xxhash64(F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), seal.alias("seal"), common.text_bytes()).where("text is not null")
    hits = covered_words(keyed, width, bucket_bytes)
    rows = docs.select(common.packed(docs), F.col("doc_id").cast("long").alias("_doc"), seal.alias("_seal"))
    joined = rows.join(hits, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_seal") == F.col("seal")), "left").select("_row", "places")
    return joined.mapInArrow(_apply, f"{common.row_type(docs)}, {FOUND}")


def find_repeats(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with _n_words, _spans and _kept added (columns of these names give way).

    _spans are the words inside repeated windows, array<struct<start, end>>, _kept the
    other words joined by one space. Words stand between white space bytes and count as
    they are. A window repeats if its words also start at any other place of any row,
    the same text included, so a repeated row repeats all its windows. Null and empty
    texts have no words, texts of fewer than width words no windows. doc_id may be null,
    as rows are known by doc_id and a hash of the text; other columns pass through,
    whatever their names; an empty table gives an empty table.
    """
    found = _found(docs, width, bucket_bytes)
    return found.select(*common.unpacked(found, "_n_words", "_spans", "_kept"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the words of repeated windows taken out of text; n_chars, where there is one, is counted anew.

    A text that nothing is taken out of stays as it is, to the white space. See find_repeats().
    """
    found = _found(docs, width, BUCKET_BYTES)
    hit = F.size("_spans") > 0
    anew = {"text": F.when(hit, F.col("_kept")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        anew["n_chars"] = F.when(hit, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return found.select(*[anew.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op13_substrings(docs: DataFrame) -> DataFrame:
    """Contract 13: words, removed words and digest of the kept ones. What odd rows give is said in find_repeats()."""
    found = find_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("_n_words").alias("n_words"), gone.alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc)),
twice AS (SELECT g FROM spot GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM spot JOIN twice USING (g)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (
  SELECT word.r, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS k
  FROM word LEFT JOIN gone ON gone.r = word.r AND gone.p = word.p GROUP BY word.r
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON kept.r = doc.r
"""
