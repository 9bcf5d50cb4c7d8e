"""Language identification: scripts narrow the candidates, character n-grams score each word, Viterbi with a switching penalty labels spans."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common

U64 = np.uint64
BUCKETS = 1 << 16
UNKNOWN = "und"
#: First code points of script blocks; a script reaches up to the next entry. "" is any other.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, ""), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, ""), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, ""), (0x0E00, "thai"), (0x0E80, ""),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"),
    (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, ""), (0x20000, "han"), (0x30000, ""),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def lower() -> np.ndarray:
    """The lower case of every code point that has one of a single code point, so that lowering moves nothing."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), dtype=np.uint32, count=0x110000)


class Words:
    """Words (runs of letters, in lower case) of a list of texts: bounds in code points of the joined text, text number, script and n-grams."""

    def __init__(self, texts: list[bytes]) -> None:
        strings = [t.decode(errors="replace") for t in texts]
        code = lower()[np.frombuffer((" " + " ".join(strings) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        letter = letters()[code]
        edges = np.flatnonzero(np.diff(letter)) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.text_start = np.cumsum(lengths + 1) - lengths
        self.owner = np.searchsorted(np.cumsum(lengths + 1), self.starts, side="right")
        self.sizes = self.ends - self.starts
        self.code, self.letter = code, letter

    def scripts(self) -> np.ndarray:
        """Script number of each word's first letter."""
        return _SCRIPT[np.searchsorted(_STARTS, self.code[self.starts], side="right") - 1]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of the 3-gram and of the 4-gram around every letter, first letter of each word): what isn't a letter is one border mark."""
        c = np.where(self.letter, self.code, 0).astype(U64)
        at = np.flatnonzero(self.letter)
        a, b, d, e = c[at - 1], c[at], c[at + 1], c[np.minimum(at + 2, len(c) - 1)]
        e = np.where(d == 0, U64(0), e)
        three = (a * U64(0x1F123BB5) + b * U64(0x9E3779B97F4A7C15) + d * U64(0xC2B2AE3D27D4EB4F)) ^ U64(3)
        four = three * U64(0x100000001B3) + e * U64(0x165667B19E3779F9)
        first = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if len(self.sizes) else np.empty(0, dtype=np.int64)
        shift = U64(48)
        return ((three * U64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64), ((four * U64(0x94D049BB133111EB)) >> shift).astype(np.int64), first


class Model:
    """Log weights of n-gram buckets by language, and which languages use which script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, scale: float = 0.6, penalty: float = 8.0) -> None:
        """counts: languages x BUCKETS; scripts: languages x scripts, letters seen. A language uses a script that has 1 % of its letters."""
        self.langs, self.scale, self.penalty = langs, scale, penalty
        p = np.log((counts + 0.2) / (counts.sum(1, keepdims=True) + 0.2 * BUCKETS)) if len(langs) else np.zeros((0, BUCKETS))
        self.weights = np.ascontiguousarray((p - p.mean(0, keepdims=True)).T.astype(np.float32)) if len(langs) else np.zeros((BUCKETS, 0), dtype=np.float32)
        uses = scripts >= 0.01 * np.maximum(1, scripts.sum(1, keepdims=True))
        uses |= ~uses.any(axis=0, keepdims=True)  # a script nobody uses rules nobody out
        self.bar = np.where(uses.T, 0.0, -50.0).astype(np.float32)

    def word_scores(self, w: Words) -> np.ndarray:
        three, four, first = w.grams()
        if not len(first):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        sums = np.add.reduceat(self.weights[three] + self.weights[four], first, axis=0)
        return sums * np.float32(self.scale) + self.bar[w.scripts()]

    def decode(self, scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The label of each word on the best path of its text: word scores, less penalty for every switch. Texts go side by side, word by word."""
        counts = np.bincount(owner, minlength=n)
        order = np.argsort(-counts, kind="stable")
        first = (np.concatenate(([0], np.cumsum(counts)[:-1])))[order]
        alive = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")  # texts longer than t
        total = np.zeros((n, scores.shape[1]), dtype=np.float64)
        stay = np.ones(scores.shape, dtype=bool)
        best_at = np.zeros(len(scores), dtype=np.int16)
        for t, k in enumerate(alive.tolist()):
            at = first[:k] + t
            if t:
                top = total[:k].argmax(1)
                bar = total[np.arange(k), top] - self.penalty
                stay[at] = total[:k] >= bar[:, None]
                best_at[at] = top
                total[:k] = np.maximum(total[:k], bar[:, None])
            total[:k] += scores[at]
        label = np.zeros(len(scores), dtype=np.int16)
        state = total.argmax(1) if scores.shape[1] else np.zeros(n, dtype=np.int64)
        for t in range(len(alive) - 1, -1, -1):
            at = first[: alive[t]] + t
            label[at] = state[: alive[t]]
            here = state[: alive[t]]
            state[: alive[t]] = np.where(stay[at, here], here, best_at[at])
        return label

    def predict(self, texts: list[bytes], spans: bool = False) -> list[tuple]:
        """(language, score, spans): the language of most letters, the share of letters that it has, and (start, end, language) in code points."""
        w = Words(texts)
        n, k = len(texts), len(self.langs)
        if not k:
            return [(UNKNOWN, 0.0, []) for _ in texts]
        label = self.decode(self.word_scores(w), w.owner, n)
        share = np.bincount(w.owner * k + label, weights=w.sizes, minlength=n * k).reshape(n, k)
        total = share.sum(1)
        top = share.argmax(1)
        out = [(self.langs[j] if s else UNKNOWN, float(share[i, j] / s) if s else 0.0, []) for i, (j, s) in enumerate(zip(top.tolist(), total.tolist()))]
        if spans and len(label):
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(label) != 0) | (np.diff(w.owner) != 0))))
            last = np.concatenate((cut[1:], [len(label)])) - 1
            for a, b in zip(cut.tolist(), last.tolist()):
                i = int(w.owner[a])
                base = int(w.text_start[i])
                out[i][2].append((int(w.starts[a]) - base, int(w.ends[b]) - base, self.langs[label[a]]))
        return out


def fit_languages(docs: DataFrame, max_rows: int = 20_000) -> bytes:
    """A pickled Model from docs(doc_id, text, lang), where lang isn't null.

    At most about max_rows / languages whole texts of each language are used, chosen by a
    hash of doc_id (the documented bound on the sample). The driver gets at most BUCKETS
    sums for each language, so the model grows with the number of lang values (about 1 MB
    each while it is fitted), not with the documents.
    """
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    each = max_rows / max(1, len(langs))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, each / sizes[lang]) * common.FINE)))]) if langs else F.create_map(F.lit(""), F.lit(0))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(common.FINE)) < F.element_at(share, F.col("lang"))).select("lang", common.text_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(langs), len(NAMES)), dtype=np.int64)
        number = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for part in common.slices(batch, "text"):
                of = np.array([number[x] for x in part.column("lang").to_pylist()])
                w = Words(common.texts_of(part, "text"))
                three, four, _ = w.grams()
                lang = of[w.owner]
                per_letter = np.repeat(lang, w.sizes)
                for g in (three, four):
                    grams += np.bincount(per_letter * BUCKETS + g, minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(lang * len(NAMES) + w.scripts(), weights=w.sizes, minlength=scripts.size).reshape(scripts.shape).astype(np.int64)
        both = np.concatenate((grams, scripts), axis=1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(both[i, j])], names=["i", "j", "n"])

    both = np.zeros((len(langs), BUCKETS + len(NAMES)))
    if langs:
        rows = sample.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
        both[rows["i"].to_numpy(dtype=np.int64), rows["j"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return pickle.dumps(Model(langs, both[:, :BUCKETS], both[:, BUCKETS:]))


def label_languages(docs: DataFrame, model: bytes, spans: bool = True) -> DataFrame:
    """docs with _lang, _lang_score and, if asked for, _lang_spans: array<struct<start, end, lang>>. Null texts and texts without letters are 'und' with score 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ["_lang", "_lang_score", *["_lang_spans"] * spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(held.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for part, texts in common.row_parts(batch):
                rows = m.predict(texts, spans)
                cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
                if spans:
                    cols.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows], kind))
                yield pa.RecordBatch.from_arrays([part.column("_row"), *cols], names=["_row", *added])

    schema = f"{common.row_type(docs)}, _lang string, _lang_score double" + ", _lang_spans array<struct<start:int,end:int,lang:string>>" * spans
    found = docs.select(common.packed(docs)).mapInArrow(run, schema)
    return found.select(*common.unpacked(found, *added))


def op7_language(docs: DataFrame) -> DataFrame:
    """Contract 7: the language of every document, learnt outside the held-out fold.

    Null and empty texts and texts without letters are 'und' with score 0; so is every text
    where no lang is known. A null doc_id is in the fold of the checksum of no bytes. Ties go
    to the language first in code point order. Repeated rows get a row each; other columns
    are ignored; an empty table gives an empty result.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    model = fit_languages(docs.select("doc_id", "text", "lang").where(fold != 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 2).alias("held_out"), "text")
    return label_languages(texts, model, spans=False).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))
