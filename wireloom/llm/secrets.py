"""Secret scans: fixed patterns, and values in credential context that would take too many guesses."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm import common
from wireloom.session import cut, discard

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are greedy, so this is [0-9a-f]+ of 16 or more
#: Wider contexts than ASSIGN: more names, other separators, and values of any printable characters.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|auth|(?:api|access|private|secret)[_-]?key)["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*["']?([^\s"'<>,;]{8,})""",
    re.IGNORECASE | re.ASCII,
)

#: Common passwords and words of placeholders, most common first.
WORDS = (
    "password secret token admin welcome login letmein master monkey dragon sunshine princess football baseball shadow "
    "superman batman trustno iloveyou hello freedom whatever qwerty azerty asdf zxcv pass user root test demo example sample "
    "changeme change default guest public private access account system server database service internal key value string "
    "your here enter insert placeholder none null true false undefined todo fixme dummy fake mock foo bar baz abc summer "
    "winter spring autumn january february march april may june july august september october november december monday "
    "tuesday wednesday thursday friday saturday sunday love money hunter killer jordan michael charlie thomas robert daniel "
    "company project development production staging local host name email phone"
).split()
#: Rows of a keyboard, plain and shifted, for straight walks along and across them.
KEYS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", " QWERTYUIOP{}|", ' ASDFGHJKL:"', " ZXCVBNM<>?")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Steps of a straight walk: right, left, down along a slanted column, down to the left of it, and both back up.
STEPS = ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("013457@$!", "oleastasi")
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
SHORTEST = 3  # letters of a word in the ranked table
RUN = re.compile(f"[a-z]{{{SHORTEST},}}")
PLACE = {c: (r, i) for rows in (KEYS, SHIFTED) for r, row in enumerate(rows) for i, c in enumerate(row) if c != " "}
START_COST = 1.0  # log10 of choosing a kind of segment
THRESHOLD = 12.0


def brute(ch: str) -> float:
    """log10 of guesses for one character: the size of its class."""
    if "0" <= ch <= "9":
        return 1.0
    if "a" <= ch <= "z" or "A" <= ch <= "Z":
        return math.log10(26)
    return math.log10(33) if ch < "\x80" else 2.0


def walks(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, choices) of straight walks over three keys or more, and of runs of the alphabet."""
    keys = [PLACE.get(c) for c in value]
    moves = [(b[0] - a[0], b[1] - a[1]) if a and b else None for a, b in zip(keys, keys[1:])]
    letters = [ALPHABET.find(c) for c in value.lower()]
    turns = [b - a if a >= 0 and b >= 0 and abs(b - a) == 1 else None for a, b in zip(letters, letters[1:])]
    for steps, choices in (([m if m in STEPS else None for m in moves], len(PLACE) // 2 * len(STEPS)), (turns, 2 * len(ALPHABET))):
        i = 0
        while i < len(steps):
            j = i
            while j < len(steps) and steps[j] is not None and steps[j] == steps[i]:
                j += 1
            if j - i >= 2:
                yield i, j + 1, choices
            i = max(j, i + 1)


class Ranks(dict):
    """Guess ranks by word, and the lengths that its words have: only these are looked up."""

    def __init__(self, ranks: dict[str, int]) -> None:
        super().__init__(ranks)
        self.lengths = sorted({len(w) for w in ranks if len(w) >= SHORTEST})


def repeats(low: str, most: float = math.inf) -> Iterator[tuple[int, int, int]]:
    """(start, end, length of the unit) of runs in which a unit of up to most characters, itself no repeat, stands twice or more, as long as they go.

    The text at i and at i + size agrees over a stretch of size characters or more; each
    size takes a pass over the value.
    """
    n = len(low)
    if n < 3:
        return
    codes = np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)
    found: dict[int, list[tuple[int, int]]] = {}
    for size in range(1, int(min(most, n // 2)) + 1):
        same = codes[size:] == codes[:-size]
        if np.count_nonzero(same) < size:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            if b - a < max(size, 2):
                continue
            if any(size % unit == 0 and i <= a and b + size <= j for unit, runs in found.items() for i, j in runs):
                continue  # the unit is a shorter one, again and again
            found.setdefault(size, []).append((a, b + size))
            yield a, b + size, size


def segments(value: str, ranks: dict[str, int] = RANK, limit: float = math.inf) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the words of the ranked table, dates, repeats and walks in value."""
    low = value.lower()
    lengths = ranks.lengths if isinstance(ranks, Ranks) else Ranks(ranks).lengths
    for form, extra in ((low, 0.0), (low.translate(LEET), 0.5)):
        for i in range(len(form)):
            for n in lengths:
                j = i + n
                if j > len(form):
                    break
                rank = ranks.get(form[i:j])
                if rank:
                    case = 0.0 if value[i:j].islower() else 0.3 if value[i:j].istitle() or value[i:j].isupper() else (j - i) * 0.3
                    yield i, j, math.log10(rank + 1) + extra + case
    for m in DATE.finditer(low):
        yield m.start(), m.end(), 2.1 if m.end() - m.start() == 4 else 4.6
    units = list(itertools.accumulate(map(brute, low), initial=0.0))
    for i, j, size in repeats(low, limit):
        for start in range(i, min(i + size, j - 2 * size + 1)):  # whole units, from any of their characters
            times = (j - start) // size
            yield start, start + times * size, units[start + size] - units[start] + math.log10(times)
    for i, j, choices in walks(value):
        yield i, j, math.log10(choices) + math.log10(j - i)


def guess_cost(value: str, ranks: dict[str, int] = RANK, limit: float = math.inf) -> float:
    """log10 of the guesses that the cheapest cut of value into segments takes.

    Only whether a cost is below limit matters to the caller, and how much it is then: the
    unit of a repeat costs 1 for each character at least, so units of limit characters or
    more can't bring a value below it and aren't looked for. Words have any length.

    Dynamic programming over end positions: a position costs the least of its segments'
    start plus guesses; single characters extend a brute-force span, which pays for its
    start once. Time is in proportion to the length.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in segments(value, ranks, limit):
        ends.setdefault(j, []).append((i, cost))
    best = [0.0] + [math.inf] * len(value)  # after a finished segment
    span = [math.inf] * (len(value) + 1)  # inside a brute-force span
    for j in range(1, len(value) + 1):
        one = brute(value[j - 1])
        span[j] = min(span[j - 1], best[j - 1] + START_COST) + one
        best[j] = min([span[j], *(best[i] + START_COST + cost for i, cost in ends.get(j, ()))])
    return best[-1] if value else 0.0


def scan(text: str, threshold: float = THRESHOLD, cost: Callable[[str], float] = guess_cost) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind: base matches, and values in credential context of 10^threshold guesses or more."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("guess", *m.span(1)) for m in CONTEXT.finditer(text) if cost(m[1]) >= threshold]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def word_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(word, n): the number of texts in which each run of SHORTEST letters a-z or more, in any case, stands; words of one text alone are left out.

    Words inside a credential context, where secrets are looked for, aren't counted, and
    copies of one text are one text to the rule that a word has to stand in two: a leaked
    value doesn't become a word because it, or its document, was copied.

    A task adds its words up before they are shuffled, and hands its sums on whenever it
    holds more than most words, so its memory doesn't grow with the vocabulary. The least
    and greatest digest of a word's texts say whether there are two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def sums() -> pa.RecordBatch:
            n, low, high = zip(*seen.values()) if seen else ((), (), ())
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(x, pa.int64()) for x in (n, low, high))], names=["word", "n", "low", "high"])
            seen.clear()
            return out

        for batch in batches:
            for part in common.slices(batch, "text"):
                for text, seal in zip(common.texts_of(part, "text"), part.column("seal").to_pylist()):
                    for w in set(RUN.findall(CONTEXT.sub(" ", text.decode(errors="replace")).lower())):
                        held = seen.get(w)
                        if held is None:
                            seen[w] = [1, seal, seal]
                            continue
                        held[0] += 1
                        if seal < held[1]:
                            held[1] = seal
                        elif seal > held[2]:
                            held[2] = seal
                if len(seen) > most:
                    yield sums()
        yield sums()

    found = docs.select(common.text_bytes(), F.xxhash64("text").alias("seal")).mapInArrow(run, "word string, n long, low long, high long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("word", "n")


def learned_ranks(docs: DataFrame, size: int = 20_000) -> Ranks:
    """Guess ranks of words: WORDS, and then the size most frequent words of all texts (a Spark count; ties by the word).

    size is the documented bound of the table that is broadcast; see word_counts() for what counts.
    How many words have each count tells the least count that the table needs, so that only
    words of that count or more come to the driver, not the first words of every partition.
    Ranks depend on the corpus, so a document's guess spans may change as it grows: fit them
    once and pass them to find_secrets() where that isn't wanted.
    """
    counts = cut(word_counts(docs), "words")
    steps = counts.groupBy("n").agg(F.count("*").alias("words"))  # the square root of the corpus' size at most
    upto = steps.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("upto"))
    least = upto.where(F.col("upto") >= size).agg(F.max("n")).first()[0] or 0
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    discard(counts)
    out = dict(RANK)
    for r in top:
        out.setdefault(r["word"], len(out) + 1)
    return Ranks(out)


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, ranks: dict[str, int] | None = None) -> DataFrame:
    """docs with _spans added (a column of that name gives way): array<struct<kind, start, end>> of the whole text, in code points.

    Words that are cheap to guess are learned from docs, unless ranks are given. A null or
    empty text has no spans, repeated rows have the same ones, other columns pass through,
    and an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(dict(learned_ranks(docs) if ranks is None else ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        known = Ranks(held.value)
        cost = lru_cache(maxsize=50_000)(lambda value: guess_cost(value, known, threshold))
        for batch in batches:
            for part, texts in common.row_parts(batch):
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.decode(errors="replace"), threshold, cost)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(spans, kind)], names=["_row", "_spans"])

    found = docs.select(common.packed(docs)).mapInArrow(run, f"{common.row_type(docs)}, _spans array<struct<kind:string,start:int,end:int>>")
    return found.select(*common.unpacked(found, "_spans"))


def op3_secrets(docs: DataFrame) -> DataFrame:
    """Contract 3: counts of the base kinds, and the spans, of every document.

    A null or empty text has no spans (the digest is that of no bytes). Spans that start at
    one place are in the order of KINDS. Repeated rows get a row each, a null doc_id stays
    null, other columns are ignored, and an empty table gives an empty result.
    """
    # the text itself goes no further than the scan
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(lean).drop("text")

    def n(kind: str) -> F.Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = joined(F.filter("_spans", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
