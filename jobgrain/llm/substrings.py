"""Substring dedup: passages that repeat are found as runs of consecutive sentences, and as windows of words wherever they begin."""

import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import packed, settle

# A sentence, or a clause of one, ends behind a punctuation mark before white space, and at a line break.
END = re.compile(r"(?<=[.!?…,;:。！？])\s+|\s*\n\s*")
MARKS = frozenset(".!?…,;:。！？")
WORD = re.compile(r"\S+")
RUN = 3
MIN_WORDS = 8
# Words of a window, and of an anchor: the anchor of a window is the gram of least hash in it, so equal windows have equal anchors.
WINDOW = 50
ANCHOR = 25
# Bits of the sketch of repeated anchors and runs; a full sketch costs time, never a run.
SKETCH_BITS = 1 << 28
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BASES = (0xD6E8FEB86659FD95, 0xA0761D6478BD642D)
# Ids of documents without one lie above all others, told apart by their text.
UNNAMED = 1 << 62
# Places that stand for a text: it may have runs twice, or an earlier document has all of it.
INSIDE, COPY = -(1 << 31), 1 - (1 << 31)
# Keys of later copies that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sentences(text: str) -> list[tuple[int, int]]:
    """Where the sentences of a text begin and end, the white space behind each one included."""
    ends = [m.end() for m in END.finditer(text)]
    starts = [0, *ends]
    return [(a, b) for a, b in zip(starts, [*ends, len(text)]) if b > a]


def words_and_ends(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and for each of its sentences how many words of the text lie up to its end.

    The same sentences as `sentences` finds: white space before the first word is
    one of its own if it has a line break.
    """
    words, ends = [], []
    for line in text.split("\n"):
        here = line.split()
        if here:
            ends += [i for i, w in enumerate(here, len(words) + 1) if w[-1] in MARKS]
            words += here
            if ends[-1:] != [len(words)]:
                ends.append(len(words))
        elif not ends and text:
            ends.append(0)
    return words, ends


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(SEEDS[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(SEEDS[1])
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=32)
def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _sums(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the codes times powers of `base`, modulo 2 ** 64, and the powers of its inverse."""
    n = len(codes)
    room = 1 << n.bit_length()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(base, room)[:n], out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), room)


def _grams(sums: np.ndarray, back: np.ndarray, size: int) -> np.ndarray:
    """A hash of every gram of `size` codes."""
    n = len(sums) - 1
    return _mixed((sums[size:] - sums[:n + 1 - size]) * back[:n + 1 - size])


def word_codes(words: list[str]) -> np.ndarray:
    """A code of each word."""
    try:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    except UnicodeEncodeError:  # half of a surrogate pair
        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


class Passages:
    """The runs of a text: of `run` sentences with at least `min_words` words, and of any WINDOW words.

    Words are compared in lower case and without regard to white space. A digest is
    two numbers; the second one is only made when it is asked for.
    """

    def __init__(self, text: str, run: int, min_words: int):
        words, ends = words_and_ends(text.lower())
        self.run, self.codes, self.bounds = run, word_codes(words), np.array([0, *ends], np.int64)
        self.first_sentence = np.flatnonzero(self.bounds[run:] - self.bounds[:-run] >= min_words) if len(ends) >= run else np.empty(0, np.int64)
        self._one = _sums(self.codes, BASES[0])
        self._two = None
        self.sentence_half, self.window_half = self._halves(BASES[0], *self._one)

    def _halves(self, base: int, sums: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One number of each digest: of the runs of sentences, and of the windows."""
        runs = windows = np.empty(0, np.uint64)
        if len(self.first_sentence):
            starts, ends = self.bounds[:-1], self.bounds[1:]
            each = _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
            runs = _grams(*_sums(each, base), self.run)[self.first_sentence]
        if len(self.codes) >= WINDOW:
            windows = _grams(sums, back, WINDOW)
        return runs.view(np.int64), windows.view(np.int64)

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        if len(self.codes) < WINDOW:
            return np.empty(0, np.int64)
        low = _grams(*self._one, ANCHOR)
        reach, span = 1, WINDOW - ANCHOR + 1
        while reach < span:  # the least of `reach` grams each; steps may overlap
            step = min(reach, span - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        return low.view(np.int64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests, two numbers each, of the runs of sentences and of the windows in order."""
        if self._two is None:
            self._two = self._halves(BASES[1], *_sums(_mixed(self.codes), BASES[1]))
        return tuple(np.stack(x, axis=1) for x in zip((self.sentence_half, self.window_half), self._two))

    def repeats(self) -> bool:
        """Whether the text may have a run twice."""
        return any(len(_distinct(half)) < len(half) for half in (self.sentence_half, self.window_half))

    def places(self) -> np.ndarray:
        """The place of each run: its first sentence, or -1 - its first word."""
        return np.concatenate([self.first_sentence, -1 - np.arange(len(self.window_half))])

    def again(self) -> np.ndarray:
        """Places of the runs that come a second time in the text, or more often."""
        return self.places()[np.concatenate([_later(d) for d in self.digests()])]


def _distinct(codes: np.ndarray) -> np.ndarray:
    """The codes in order, each once."""
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])[:len(codes)]]


def _later(digests: np.ndarray) -> np.ndarray:
    """Which windows of a text come again in it: true for all but the first of each digest."""
    later = np.zeros(len(digests), bool)
    if len(np.unique(digests[:, 0])) < len(digests):
        order = np.lexsort((digests[:, 1], digests[:, 0]))  # stable: equal digests stay in order of place
        later[order[1:]] = (digests[order[1:]] == digests[order[:-1]]).all(axis=1)
    return later


def runs(text: str, run: int, min_words: int) -> list[tuple[int, bytes]]:
    """(place, digest) of every run of a text.

    A run is `run` sentences with at least `min_words` words, its place the first
    sentence, or any WINDOW consecutive words, its place -1 - the first word.
    """
    found = Passages(text, run, min_words)
    return [(int(at), d.tobytes()) for at, d in zip(found.places(), np.concatenate(found.digests()))]


def cut(text: str, places, run: int) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the sentences and words of the runs at `places`; how many sentences lost words, and the stretches that went."""
    spans = sentences(text)
    parts = sorted({s for at in places if at >= 0 for s in range(at, min(at + run, len(spans)))})
    parts = [spans[s] for s in parts]
    firsts = sorted(-1 - at for at in places if at < 0)
    if firsts:
        words = [m.start() for m in WORD.finditer(text)] + [len(text)]
        parts = sorted(parts + [(words[w], words[min(w + WINDOW, len(words) - 1)]) for w in firsts])
    if not parts:
        return text, 0, []
    stretches = []
    for a, b in parts:
        if stretches and stretches[-1][1] >= a:
            stretches[-1][1] = max(stretches[-1][1], b)
        else:
            stretches.append([a, b])
    kept, at, n = [], 0, 0
    for a, b in stretches:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    at = iter(stretches)
    here = next(at)
    for a, b in spans:
        while here and here[1] <= a:
            here = next(at, None)
        n += bool(here and here[0] < b)
    return "".join(kept).rstrip(), n, [tuple(x) for x in stretches]


def _order() -> Column:
    """The place of a document among all: its id, or above all ids a number made from its text."""
    by_text = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    return F.coalesce(F.col("doc_id").cast("long"), by_text)


def _mark() -> Column:
    """Tells rows of one id apart."""
    return F.hash("text")


def _sketch(codes: DataFrame, name: str) -> np.ndarray:
    """One bit for each of SKETCH_BITS classes of the codes in column `name`, of any number."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # as bytes: a million rows would fill the driver's memory
            yield pd.DataFrame({"part": [batch[["word", "bits"]].to_numpy(np.int64).tobytes()]})

    bits = (codes.select(F.col(name).bitwiseAND(F.lit(SKETCH_BITS - 1)).alias("bit")).groupBy(F.expr("bit >> 6").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")))
    sketch = np.zeros(SKETCH_BITS // 64, np.int64)
    for row in bits.mapInPandas(packed, "part binary").collect():
        words, values = np.frombuffer(row["part"], np.int64).reshape(-1, 2).T
        sketch[words] = values
    return sketch


def _in_sketch(sketch: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the codes whose class has its bit set: all that were put in, and a few more."""
    bit = codes & (SKETCH_BITS - 1)
    return np.flatnonzero((sketch[bit >> 6] >> (bit & 63)) & 1)


def _by_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for begin in range(0, len(batch), 256):  # a bounded number of texts at a time
            yield batch.iloc[begin:begin + 256]


def _checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` to be broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def later_copies(docs: DataFrame) -> DataFrame:
    """(place, mark) of the documents whose whole text an earlier document has."""
    slim = docs.where("text is not null").select("place", "mark", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    copied = settle(slim.groupBy("t1", "t2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                    .where("first < last").drop("last"))
    return settle(slim.join(_checked_broadcast(copied), ["t1", "t2"]).where("place > first").select("place", "mark").distinct())


def shared_codes(texts: DataFrame, run: int, min_words: int) -> np.ndarray:
    """A sketch of the anchors, and of the first numbers of the digests of runs of sentences, that documents of different places share."""
    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_parts(batches):
            found = []
            for text in part["text"]:
                here = Passages(text, run, min_words)
                found.append(_distinct(np.concatenate([here.sentence_half, here.anchors()])))
            yield pd.DataFrame({"place": np.repeat(part["place"].to_numpy(np.int64), [len(f) for f in found]), "code": np.concatenate(found)})

    shared = (texts.select("place", "text").mapInPandas(emitted, "place long, code long")
              .groupBy("code").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last"))
    return _sketch(shared, "code")


def repeated_runs(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(place, mark, at): in the document at `place` whose text has the hash `mark`, the run at `at` also occurs in an earlier document.

    `docs` has place, mark and text, and each text in its first documents only, which
    speak for the later ones. A row whose `at` is INSIDE stands for a text that may
    have runs twice. Runs are handed on once each, if another document has the same
    anchor, or for sentences the same half of a digest; no other can be repeated. They are written once and counted by digest, with
    partial sums, so a passage that a third of all documents share is one row per
    task; then they meet one row per digest in a join that keeps the documents behind
    the first one. The sketch has a fixed size; it only saves rows.
    """
    texts = docs.where("text is not null").select("place", "mark", "text")
    common = docs.sparkSession.sparkContext.broadcast(shared_codes(texts, run, min_words))

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_parts(batches):
            digests, places = [], []
            for text in part["text"]:
                here = Passages(text, run, min_words)
                shared = np.concatenate([_in_sketch(common.value, here.sentence_half),
                                         len(here.sentence_half) + _in_sketch(common.value, here.anchors())])
                at = here.places()[shared]
                halves = np.concatenate(here.digests())[shared] if len(shared) else np.empty((0, 2), np.int64)
                if here.repeats():
                    first = ~_later(halves)
                    at, halves = np.append(at[first], INSIDE), np.append(halves[first], [[0, 0]], axis=0)
                digests.append(halves)
                places.append(at)
            sizes = [len(x) for x in places]
            halves = np.concatenate(digests)
            yield pd.DataFrame({"place": np.repeat(part["place"].to_numpy(np.int64), sizes),
                                "mark": np.repeat(part["mark"].to_numpy(np.int32), sizes), "d1": halves[:, 0], "d2": halves[:, 1],
                                "at": np.concatenate(places).astype(np.int32)})

    rows = packed(texts.mapInPandas(emitted, "place long, mark int, d1 long, d2 long, at int"))
    common.unpersist()
    found = rows.where(F.col("at") != INSIDE)
    firsts = packed(found.groupBy("d1", "d2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                    .where("first < last").drop("last"))
    return (found.join(firsts, ["d1", "d2"]).where("place > first").select("place", "mark", "at")
            .union(rows.where(F.col("at") == INSIDE).select("place", "mark", "at")))


def dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, text without repeated passages, n_sentences, n_removed and the removed stretches.

    A run of `run` consecutive sentences, or of WINDOW words wherever it begins, is
    repeated if an earlier document, or an earlier place of the same text, has it
    too; all of a run that is not the first of its kind is removed. `n_removed`
    counts the sentences that lost all or some of their words. Documents are ordered by id. Rows with a null
    id come behind all others, in an order made from their text. Rows of equal id
    (or, without one, of equal text) do not take sentences from each other. Shorter
    texts, null and empty texts stay as they are (null gives ''). `removed`
    holds (start, stop) code points in the old text. An empty table gives an empty
    result; extra columns are not looked at.
    """
    named = docs.select("doc_id", F.col("text")).withColumns({"place": _order(), "mark": _mark()})
    copies = later_copies(named)
    hits = (repeated_runs(named.join(_checked_broadcast(copies), ["place", "mark"], "left_anti"), run, min_words)
            .union(copies.select("place", "mark", F.lit(COPY)))
            .groupBy("place", "mark").agg(F.collect_set("at").alias("places")))

    @F.pandas_udf("text string, n_sentences int, n_removed int, removed array<struct<start:int, stop:int>>")
    def kept(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, places):
            text = text or ""
            gone = set(at.tolist()) if at is not None else set()
            if INSIDE in gone or COPY in gone:
                here = Passages(text, run, min_words)
                gone.update((here.places() if COPY in gone else here.again()).tolist())
                gone -= {INSIDE, COPY}
            left, n, stretches = cut(text, gone, run) if gone else (text, 0, [])
            rows.append((left, len(words_and_ends(text)[1]), n, [{"start": a, "stop": b} for a, b in stretches]))
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "removed"])

    return (named.join(hits, ["place", "mark"], "left").select("doc_id", kept("text", "places").alias("k")).select("doc_id", "k.*"))
