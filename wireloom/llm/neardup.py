"""Near duplicates: fast similarity sketches, banding, and verification of whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.operators.components import connected_components
from wireloom.session import cut, discard

U64 = np.uint64
BANDS, ROWS = 40, 5
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def sketch(values: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """n x size coordinates; two sets agree in one with a probability equal to their Jaccard similarity.

    Round i throws every element into one bin, with a value that any earlier round's
    beats. Once all bins of a set are full, its later rounds can't change it and are left
    out: about size * log(size) throws in all, and often one round for large sets. Rounds
    from size on send all elements to bin i - size, so each coordinate of a set that
    isn't empty fills, however small the set.
    """
    out = np.full((n, size), EMPTY, dtype=U64)
    live = np.unique(owner)  # texts with open bins, and their elements by place in live
    at_live = np.searchsorted(live, owner)
    state = np.full((len(live), size), EMPTY, dtype=U64)
    for i in range(2 * size):
        h = common.mix(values ^ common.seeded(i))
        place = ((h >> U64(32)) * U64(size) >> U64(32)).astype(np.int64) if i < size else i - size
        key = (U64(i) << U64(48)) | (common.mix(h) >> U64(16))
        at = at_live * size + place
        flat = state.reshape(-1)
        fresh = flat[at] == EMPTY
        np.minimum.at(flat, at[fresh], key[fresh])
        done = ~(state == EMPTY).any(axis=1)
        if not done.any():
            continue
        out[live[done]] = state[done]
        live, state, going = live[~done], state[~done], ~done[at_live]
        if not len(live):
            break
        at_live = (np.cumsum(~done) - 1)[at_live[going]]
        values = values[going]
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of rows coordinates; the band's number is part of it."""
    n, size = sketches.shape
    bands = sketches.reshape(n, size // rows, rows)
    key = np.broadcast_to(np.arange(size // rows, dtype=U64), (n, size // rows)).copy()
    for j in range(rows):
        key = common.mix(key * U64(0x9E3779B97F4A7C15) + bands[:, :, j])
    return key


MARKS = [f"m{i}" for i in range(8)]


def parity_marks(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x 8 longs, 512 bits a set: a bit is the parity of the elements that hash to it.

    The bits in which two sets differ are at most their symmetric difference, so a pair
    with too many is surely below the threshold: an exact filter, without the sets.
    """
    size = 64 * len(MARKS)
    odd = np.bincount(owner * size + (common.mix(values) & U64(size - 1)).astype(np.int64), minlength=n * size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(n, len(MARKS))


def may_reach(percent: int) -> Column:
    """Whether marks and sizes of a pair (columns na, nb, a0.., b0..) allow 100 * intersection >= percent * union."""
    apart = sum((F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in MARKS), F.lit(0))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys, marks): the size of a text's shingle set, a 128-bit digest of it, its band keys and parity marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                n = part.num_rows
                blob, starts, ends, owner = common.spaced_words([t.translate(common.LOWER) for t in common.texts_of(part, "text")])
                values, of = common.shingle_hashes(common.span_hashes(blob, starts, ends), owner, n, k)
                counts = np.bincount(of, minlength=n)
                digests = []
                for seed in (101, 202):
                    total = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(common.mix(values ^ common.seeded(seed)))))
                    upto = np.cumsum(counts)
                    digests.append(total[upto] - total[upto - counts])
                keys = band_keys(sketch(values, of, n, bands * rows), rows)
                offsets = np.concatenate(([0], np.cumsum(np.where(counts > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), common.signed(keys[counts > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), common.signed(digests[0]), common.signed(digests[1]), lists, *map(pa.array, parity_marks(values, of, n).T)], names=["doc_id", "n_shingles", "set_a", "set_b", "keys", *MARKS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes()).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, " + ", ".join(f"{m} long" for m in MARKS))


def shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The shingle set itself: k-word tuples of the lower-cased text, or its whole sequence if that is shorter."""
    words = text.translate(common.LOWER).split()
    return {tuple(words)} if 0 < len(words) < k else set(zip(*(words[i:] for i in range(k))))


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of pairs(a, b, ca, cb) whose shingle sets have 100 * intersection >= percent * union, as (u, v) = (ca, cb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            us, vs = [], []
            columns = [batch.column(c) for c in ("at", "bt", "ca", "cb")]
            for i in range(batch.num_rows):  # a batch may hold long texts: one row at a time
                at, bt = columns[0][i].as_py(), columns[1][i].as_py()
                if at != last:
                    last, left = at, shingles(at, k)
                right = shingles(bt, k)
                common_ = len(left & right)
                if common_ and 100 * common_ >= percent * (len(left) + len(right) - common_):
                    us.append(columns[2][i].as_py())
                    vs.append(columns[3][i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("bt"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("at"))
    return pairs.join(b, "b").join(a, "a").select("at", "bt", "ca", "cb").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    1. Every text gets its sketch and band keys. Equal shingle sets (exact copies) fall
       together by their digest and go on as one representative, the smallest doc_id.
    2. Representatives with an equal band key are candidates. In a bucket only leaders
       meet the other members; pairs that parity marks can't rule out are verified on the
       whole sets. Verified links merge components. A round's leaders have met all members,
       so they leave, and a bucket ends as soon as all it still holds is in one component.
       Leaders grow eightfold with each round (1, 8, 64, ...), so any bucket ends after
       logarithmically many rounds, and one of true copies after one or two, with one pair
       a member: no link between components is lost, and links inside a component are not
       looked for.
    3. component_id is the smallest doc_id reachable over links.

    A pair at the threshold shares no band key with probability (1 - 0.8^5)^40 = 1e-7.
    Null and empty texts have no shingles and are linked with nothing (component_id is
    their doc_id). Repeated rows get equal results, a row each. Rows sharing a doc_id count
    as one document. A row without doc_id gets the component of equal texts, or null, and
    isn't kept. Other columns are ignored.
    """
    signed = cut(signatures(docs, k, bands, rows), "sketches")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "keys", *MARKS)
    spread = reps.select("rep", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).where("_lo <> _hi").select("key")
    # sizes and marks join the few rows that are left, and don't travel with every key
    members = cut(spread.join(shared, "key").join(reps.select("rep", "n", *MARKS), "rep").select("key", "rep", "n", *MARKS, F.col("rep").alias("comp")), "members")
    size = members.count()
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes()).where("text is not null").join(wanted, "doc_id", "left_semi"), "texts")

    links: DataFrame | None = None
    found: DataFrame | None = None
    n_linked = 0
    start = members
    for turn in range(14):  # by the last of which every member has been a leader
        buckets = members.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("_m"), F.min("rep").alias("_first")).where("_lo <> _hi")
        coin = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 20)) * F.col("_m") < F.lit((8**turn - 1) << 20)
        active = cut(members.join(buckets, "key").select("key", "rep", "n", *MARKS, "comp", ((F.col("rep") == F.col("_first")) | coin).alias("lead")), "active", size)
        if active.isEmpty():
            break
        a = active.where("lead").select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), *[F.col(m).alias(f"a{m}") for m in MARKS])
        b = active.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), "lead", *[F.col(m).alias(f"b{m}") for m in MARKS])
        likely = (F.col("ca") != F.col("cb")) & may_reach(percent) & (~F.col("lead") | (F.col("a") < F.col("b")))
        pairs = a.join(b, "key").where(likely).select("a", "b", "ca", "cb").distinct()
        edges = cut(verified(pairs, texts, k, percent), "links")
        rest = active.where("not lead").drop("lead")
        if not edges.isEmpty():
            found = cut(connected_components(edges), "components")
            n_linked += 1
            links = edges if links is None else links.union(edges)
            rest = rest.join(found.select(F.col("node").alias("comp"), "component"), "comp", "left").select("key", "rep", "n", *MARKS, F.coalesce("component", "comp").alias("comp"))
        members = rest
    discard(start, texts)
    if links is None:
        result = classes.select("set_a", "set_b", "rep", F.col("rep").alias("component_id"))
    else:
        whole = found if n_linked == 1 else cut(connected_components(links), "components")
        result = classes.join(whole.select(F.col("node").alias("rep"), F.col("component").alias("_c")), "rep", "left").select("set_a", "set_b", F.coalesce("_c", "rep").alias("component_id"))
    result = result.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), "component_id")
    joined = signed.join(result, (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates; of repeated rows of a doc_id one stays.

    Rows without a doc_id stay as they are. Columns are those of docs.
    """
    from pyspark.sql import Window

    kept = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(common.packed(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    order = Window.partitionBy("_id").orderBy("_text")
    one = rows.join(kept, "_id").withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    one = one.select(*common.unpacked(one))
    return one.unionByName(docs.where("doc_id is null"))


def op2_near_duplicates(docs: DataFrame) -> DataFrame:
    """Contract 2: components of documents linked at Jaccard 0.8 on sets of 2-word shingles."""
    return near_duplicates(docs, k=2, percent=80)
