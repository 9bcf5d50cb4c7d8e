"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.session import cut, discard

U64 = np.uint64
DIM, NONZERO, WINDOW = 16, 4, 2
#: Documents of a block meet their word vectors together: about this much text, and at least MIN_BLOCKS of them.
BLOCK_BYTES, MIN_BLOCKS = 48 << 20, 8
#: Text that a task packs into blobs at a time.
PACK_BYTES = 16 << 20
#: Parts of the vocabulary for each block, so that a part holds a fraction of a block's words.
PARTS = 4
#: Classes of a byte: white space, word (letters, digits, parts of non-ASCII characters), marks.
_RUN = np.full(256, 2, dtype=np.uint8)
_RUN[list(common.SPACE)] = 0
_RUN[97:123] = _RUN[65:91] = _RUN[48:58] = _RUN[128:] = 1


def token_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of the tokens: words, and runs of marks, as they are written."""
    blob = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    run = _RUN[blob]
    edges = np.flatnonzero(np.diff(run)) + 1
    starts, ends = edges, np.concatenate((edges[1:], [len(blob)]))
    real = run[starts] > 0
    starts, ends = starts[real], ends[real]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return common.span_hashes(blob, starts, ends), np.searchsorted(np.cumsum(lengths + 1), starts, side="right")


def index_vectors(words: np.ndarray) -> np.ndarray:
    """The fixed random index vector of every word, from its hash: NONZERO draws of a place and a sign."""
    bits = common.mix(words + common.seeded(11))
    out = np.zeros((len(words), DIM), dtype=np.int8)
    at = np.arange(len(words))
    for j in range(NONZERO):
        out[at, ((bits >> U64(8 * j)) % U64(DIM)).astype(np.int64)] += ((bits >> U64(40 + j)) & U64(1)).astype(np.int8) * 2 - 1
    return out


def context_sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, ascending, and for each the sum of the index vectors of the tokens up to WINDOW places away in the same text."""
    tokens, owner = token_ids(texts)
    words, at = np.unique(tokens, return_inverse=True)
    if not len(words):
        return words, np.zeros((0, DIM), dtype=np.int64)
    own = index_vectors(words)[at]
    near = np.zeros_like(own)  # at most 2 * WINDOW * NONZERO in a place
    for gap in range(1, WINDOW + 1):
        same = (owner[gap:] == owner[:-gap])[:, None]
        near[:-gap] += own[gap:] * same
        near[gap:] += own[:-gap] * same
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(words)))
    sums = np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
    return words, sums.astype(np.int32) if len(at) < 1 << 26 else sums


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all parts, ascending, and the sums of their sums; held is used up, so that no part outlives its turn."""
    words = np.unique(np.concatenate([w for w, _ in held]))
    most = sum(max(int(s.max(initial=0)), -int(s.min(initial=0))) for _, s in held)
    out = np.zeros((len(words), DIM), dtype=np.int32 if most < 1 << 31 else np.int64)
    while held:
        w, s = held.pop()
        out[np.searchsorted(words, w)] += s.astype(out.dtype, copy=False)
    return words, out


def packed_sums(words: np.ndarray, sums: np.ndarray) -> bytes:
    """Ascending words (as steps) and their whole-number sums as compressed bytes: most are small, so their higher bytes cost next to nothing."""
    sums = sums.astype(np.int64)
    folded = ((sums << 1) ^ (sums >> 63)).T.reshape(-1).view(U64)
    steps = np.diff(words, prepend=U64(0))
    return pa.compress(np.ascontiguousarray(np.concatenate((steps, folded)).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked_sums(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n * (1 + DIM), codec="zstd", asbytes=True), dtype=np.uint8)
    numbers = np.ascontiguousarray(raw.reshape(8, -1).T).view(U64).ravel()
    folded = numbers[n:].reshape(DIM, n).T
    return np.cumsum(numbers[:n], dtype=U64), (folded >> U64(1)).view(np.int64) ^ -(folded & U64(1)).view(np.int64)


def packed_texts(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(_block, _blob): the rows of every block as one compressed Arrow stream."""
    table = pa.Table.from_batches(batches)
    table = table.take(pa.array(np.argsort(table.column("_block").to_numpy(), kind="stable"))).combine_chunks()
    blocks = table.column("_block").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    rows, blobs = table.drop_columns(["_block"]), []
    for a, b in zip(cuts, cuts[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
            out.write_table(rows.slice(a, b - a))
        blobs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["_block", "_blob"])


def unpacked_texts(blob: pa.Scalar) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a blob's rows, each with its texts."""
    for batch in pa.ipc.open_stream(blob.as_buffer()):
        for part in common.slices(batch, "text"):
            yield part, common.texts_of(part, "text")


def block_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(MIN_BLOCKS, -(-size // BLOCK_BYTES))


def document_features(docs: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(doc_id, text_key, features) of docs(doc_id, text), row by row: the pooled vectors of a document's words, as float32 bytes.

    Every word of all documents has a vector of its own, the sum of the index vectors of
    the tokens near it anywhere. Documents are dealt into blocks by a hash of the row, each
    a compressed Arrow stream. A block sums its own words; parts of the vocabulary add the
    blocks' sums up and send every block back the totals of its words, which meet its
    documents in a cogroup. The texts are shuffled once; neither the vocabulary nor a block
    passes through the driver, and a task holds the words of one block or one part. Sums
    are whole numbers, so results don't depend on the order of tasks. text_key is
    xxhash64 of the text. A null text is empty and has zero features.
    """
    n_blocks = n_blocks or block_count(docs)
    n_parts = PARTS * n_blocks
    key = F.xxhash64("text").alias("text_key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("_block"), common.text_bytes())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in (p for batch in batches for p in common.slices(batch, "text")):
            held.append(part)
            size += part.nbytes
            if size >= PACK_BYTES:
                yield packed_texts(held)
                held, size = [], 0
        if held:
            yield packed_texts(held)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, blob in zip(batch.column("_block").to_pylist(), batch.column("_blob")):
                if held and block != now:
                    yield shares(now, *merged(held))
                now = block
                for _, texts in unpacked_texts(blob):
                    held.append(context_sums(texts))
                    if len(held) > 8:
                        held = [merged(held)]
        if held:
            yield shares(now, *merged(held))

    def shares(block: int, words: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
        part = (((words >> U64(32)) * U64(n_parts)) >> U64(32)).astype(np.int64)  # ranges of the hash, in its order
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
        spans = list(zip(cuts, cuts[1:]))
        return sums_batch([(part[a], block, b - a, packed_sums(words[a:b], totals[a:b])) for a, b in spans])

    def sums_batch(made: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        cols = list(zip(*made)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["_part", "_block", "_n", "_sums"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, block, n, blob in zip(*[batch.column(c).to_pylist() for c in ("_part", "_block", "_n", "_sums")]):
                if held and part != now:
                    yield totals_of(now, held)
                    held = []
                now = part
                held.append((block, *unpacked_sums(blob, n)))
        if held:
            yield totals_of(now, held)

    def totals_of(part: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, totals = merged([(w, s) for _, w, s in held])
        return sums_batch([(part, block, len(w), packed_sums(w, totals[np.searchsorted(words, w)])) for block, w, _ in held])

    def pool(known: pa.Table, texts: pa.Table) -> pa.Table:
        words, table = lookup(known)
        out = [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], names=["doc_id", "text_key", "features"])]
        for blob in texts.column("_blob"):
            for part, found in unpacked_texts(blob):
                x = pooled(found, words, table)
                out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "text_key", "features"]))
        return pa.Table.from_batches(out)

    dealt = rows.mapInArrow(pack, "_block int, _blob binary").repartition("_block")
    kind = "_part long, _block int, _n long, _sums binary"
    asked = dealt.sortWithinPartitions("_block").mapInArrow(sums, kind)
    answers = asked.repartition("_part").sortWithinPartitions("_part").mapInArrow(answer, kind)
    return answers.groupBy("_block").cogroup(dealt.groupBy("_block")).applyInArrow(pool, "doc_id long, text_key long, features binary")


def lookup(known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(words, ascending; their vectors, as unit rows) of a block: its parts are ranges of words, so they follow each other by number."""
    size = sum(known.column("_n").to_pylist())
    words, table, at = np.empty(size, dtype=U64), np.empty((size, DIM), dtype=np.float32), 0
    for i in np.argsort(known.column("_part").to_numpy()).tolist():
        n = known.column("_n")[i].as_py()
        words[at : at + n], sums = unpacked_sums(known.column("_sums")[i].as_buffer(), n)
        unit = sums.astype(np.float32)
        table[at : at + n] = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        at += n
    return words, table


GAPS = (1, 2)
N_FEATURES = 2 * DIM + 6


def pooled(texts: list[bytes], words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean and deviation of its word vectors, likeness of neighbouring vectors at distance 1 and 2, norm, spread and size. words is ascending; a word that it lacks has the zero vector."""
    n = len(texts)
    tokens, owner = token_ids(texts)
    counts = np.bincount(owner, minlength=n)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))[some]
    at = np.searchsorted(words, tokens).clip(max=max(len(words) - 1, 0))
    v = np.zeros((len(tokens), DIM), dtype=np.float32)
    if len(words):
        known = words[at] == tokens
        v[known] = vectors[at[known]]
    size = counts[some][:, None]
    mean = np.add.reduceat(v, first, axis=0) / size
    out[some, :DIM] = mean
    out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, first, axis=0) / size - mean * mean, 0))
    for gap in GAPS:
        like = np.zeros(len(tokens), dtype=np.float32)
        if len(tokens) > gap:
            like[:-gap] = np.einsum("ij,ij->i", v[:-gap], v[gap:]) * (owner[:-gap] == owner[gap:])
        out[some, 2 * DIM + gap - 1] = np.add.reduceat(like, first) / np.maximum(counts[some] - gap, 1)
    out[some, 2 * DIM + 2] = np.linalg.norm(mean, axis=1)
    repeat = np.zeros(len(tokens), dtype=np.float32)
    repeat[1:] = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
    out[some, 2 * DIM + 3] = np.add.reduceat(repeat, first) / counts[some]
    out[some, 2 * DIM + 4] = np.log1p(counts[some])
    out[some, 2 * DIM + 5] = 1.0
    return out


class Network:
    """Two dense layers (tanh, then a logit), standardised inputs, Adam, weighted log loss; a temperature fitted on rows kept out of training."""

    def __init__(self, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> None:
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature, self.weights = 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """x and y in a fixed order. With one class alone (or no rows) the network says its rate everywhere."""
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        if len(np.unique(y)) < 2:
            rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
            self.weights = [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), np.log(rate / (1 - rate))]
            return self
        order = rng.permutation(len(x))
        aside, used = order[: len(x) // 5], order[len(x) // 5 :]
        if len(np.unique(y[used])) < 2:
            used = order
        z, t = ((x[used] - self.mean) / self.scale).clip(-8, 8), y[used].astype(float)
        shape = x.shape[1]
        params = [rng.normal(0, shape**-0.5, (shape, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(self.epochs):
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                a = np.tanh(z[rows] @ params[0] + params[1])
                err = (1 / (1 + np.exp(-(a @ params[2] + params[3]).clip(-60, 60))) - t[rows]) / len(rows)
                back = np.outer(err, params[2]) * (1 - a * a)
                grads = [z[rows].T @ back + self.decay * params[0], back.sum(0), a.T @ err + self.decay * params[2], err.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] = params[i] - self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = params
        if len(aside):
            raw, t = self.logits(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, -np.where(t == 1, raw, -raw) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def fit_quality(features: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> bytes:
    """A pickled network over at most about max_rows labelled rows (by a hash of doc_id; the bound on the sample).

    features is a table of document_features. labels has doc_id and quality; rows with a
    null in either are left out, repeated ones count once. The network has a fixed size.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y is not null").distinct()
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(common.FINE)) < F.lit(int(share * common.FINE)))
    rows = features.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "features").toPandas()
    x = np.frombuffer(b"".join(rows["features"]), dtype=np.float32).reshape(-1, N_FEATURES).astype(float)
    order = np.lexsort((*x.T[:3], rows["_y"].to_numpy(dtype=np.int64), rows["doc_id"].to_numpy(dtype=np.int64))) if len(rows) else np.empty(0, dtype=np.int64)
    return pickle.dumps(Network().fit(x[order], rows["_y"].to_numpy(dtype=np.int64)[order]))


def scored(features: DataFrame, network: bytes) -> DataFrame:
    """(doc_id, text_key, score): the calibrated probability of quality 1 of every row of features."""
    held = features.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(held.value)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(net.probabilities(x).astype(float).ravel())], names=["doc_id", "text_key", "score"])

    return features.mapInArrow(run, "doc_id long, text_key long, score double")


def fold(doc_id: str, n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier, fitted on all of labels, doesn't reject; columns, names and types as they were.

    Null and empty texts are scored as texts without words. Rows equal in doc_id and text
    have one score, so repeated rows stay or go together; a null doc_id is scored like
    any other. Without labels nothing is rejected (every score is 0.5). An empty table
    gives an empty one.
    """
    features = cut(document_features(docs), "features")
    good = scored(features, fit_quality(features, labels)).where(F.col("score") >= threshold)
    good = cut(good.select(F.col("doc_id").alias("_good_id"), F.col("text_key").alias("_good_key")).distinct(), "good")
    discard(features)
    held = docs.select(common.packed(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))
    kept = held.join(good, F.col("_id").eqNullSafe(F.col("_good_id")) & (F.col("_key") == F.col("_good_key")), "left_semi")
    return kept.select(*common.unpacked(kept))


def op9_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Contract 9: a score for every document, from labels outside the held-out fold.

    Null and empty texts get the score of a text without words. Repeated rows get a row
    each, with equal scores; a null doc_id is held out or not by the checksum of no bytes.
    Labels with nulls are left out, and without any every score is 0.5. Other columns of
    docs and labels are ignored. An empty table gives an empty result.
    """
    features = cut(document_features(docs), "features")
    found = scored(features, fit_quality(features, labels.where(fold("doc_id", 5) != 0)))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
