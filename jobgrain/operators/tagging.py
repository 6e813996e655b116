"""Skill tagging of free text against a lexicon of (skill, keyword) rows."""

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.functions.text import lexicon_tags, union_lists
from jobgrain.operators.scale import BROADCAST_ROWS, small_join, spread_join
from jobgrain.schema import LEXICON, with_fields

# Up to this many keywords the lexicon becomes one generated expression.
INLINE_KEYWORDS = 1_000
# Characters of a text that go with a run to be verified.
VERIFY = 32
# Size of a filter of anchors: 32 MB.
MOST_BITS = 1 << 28
# An odd factor with well-mixed bits (the golden ratio times 2**64).
MIX = np.uint64(0x9E3779B97F4A7C15)


def name_lexicon(skills: list[str]) -> dict[str, list[str]]:
    """Every skill is found by its own lower-cased name."""
    return {s: [s.lower()] for s in skills}


def lexicon_from_table(lexicon: DataFrame, limit: int = INLINE_KEYWORDS) -> dict[str, list[str]] | None:
    """The lexicon as a dict, or None when it has more than `limit` keywords."""
    rows = usable(lexicon).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    table: dict[str, list[str]] = {}
    for r in sorted(rows):
        table.setdefault(r["skill"], []).append(r["keyword"])
    return table


def usable(lexicon: DataFrame) -> DataFrame:
    """Distinct (skill, keyword) rows; a null or empty keyword finds nothing."""
    return lexicon.select("skill", "keyword").where((F.col("keyword") != "") & F.col("skill").isNotNull()).distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon table from JSON Lines of {skill, keyword}."""
    return usable(spark.read.schema(LEXICON).option("mode", "FAILFAST").json(path))


def tag_skills(df: DataFrame, lexicon: dict[str, list[str]], texts=("requirement", "responsibility"),
               skills: str = "skills_list", mode: str = "substring") -> DataFrame:
    """Merge the skills found in each text into the skill list."""
    found = F.col(skills) if skills in df.columns else F.array().cast("array<string>")
    for text in texts:
        if text in df.columns:
            found = union_lists(found, lexicon_tags(F.col(text), lexicon, mode))
    return df.withColumn(skills, found)


def tag_texts(df: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, skill) pairs by literal substring, for a lexicon table of any size.

    A small lexicon is inlined. A large one is joined on keyword anchors, the
    leading characters of each keyword, against the distinct character runs of
    the text of that length; the full keyword is then checked. Pairs are distinct
    and empty keywords find nothing, whichever way is taken.
    """
    table = lexicon_from_table(lexicon)
    if table is not None:
        return df.select(key, F.explode(lexicon_tags(F.col(text), table)).alias("skill")).distinct()
    return tag_texts_by_anchor(df, lexicon, key, text)


def tag_texts_by_anchor(df: DataFrame, lexicon: DataFrame, key: str, text: str,
                        anchor: int = 6, broadcast_rows: int | None = None) -> DataFrame:
    """The way for large lexicons.

    Up to `broadcast_rows` (BROADCAST_ROWS) keywords are broadcast and the text stays on its row, so no text is
    shuffled and only runs that are an anchor meet it; for more see `tag_texts_by_filter`.
    """
    keywords = (usable(lexicon)
                .withColumn("_len", F.least(F.length("keyword"), F.lit(anchor)))
                .withColumn("_anchor", F.substring("keyword", F.lit(1), F.col("_len"))))
    lowered = df.select(key, F.lower(F.col(text)).alias("_text")).where(F.col("_text").isNotNull())
    sizes = [r["_len"] for r in keywords.select("_len").distinct().collect()]  # at most `anchor`
    # A look-ahead matches at every position, so runs overlap and cost is linear.
    runs = [F.regexp_extract_all("_text", F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sorted(sizes)]
    if not sizes:
        return df.select(key, F.lit("").alias("skill")).where("false")
    found = F.explode(F.array_distinct(F.concat(*runs))).alias("_anchor")
    most = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if keywords.limit(most + 1).count() <= most:
        hits = lowered.select(key, "_text", found).join(F.broadcast(keywords.drop("_len")), "_anchor")
        return hits.where(F.contains(F.col("_text"), F.col("keyword"))).select(key, "skill").distinct()
    return tag_texts_by_filter(lowered, keywords, sorted(sizes), key)


def _run_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` characters of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full(max(len(points) - size + 1, 0), size, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(31))) * MIX + points[i:i + len(out)]
    return (out ^ (out >> np.uint64(29))) * MIX


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits of each hash in a filter of `size` bits, a power of two."""
    return [(hashes >> np.uint64(shift)) & np.uint64(size - 1) for shift in (0, 32)]


def anchor_filter(anchors: DataFrame) -> np.ndarray:
    """A Bloom filter of the distinct `_anchor` texts: 16 to 32 bits for each, at most MOST_BITS in all.

    A fuller filter lets more runs through, which costs time but loses nothing.
    """
    wanted, size = 16 * anchors.count(), 1 << 10
    while size < min(wanted, MOST_BITS):
        size *= 2

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = np.array([_run_hashes(a, len(a))[0] for a in batch["_anchor"]], np.uint64)
            at = np.concatenate(_bits(hashes, size)).astype(np.int64)
            yield pd.DataFrame({"byte": at >> 3, "bits": 1 << (at & 7)})

    filled = np.zeros(size >> 3, np.uint8)
    # At most one row a byte of the filter.
    for byte, bits in anchors.select("_anchor").mapInPandas(placed, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits")).collect():
        filled[byte] = bits
    return filled


def tag_texts_by_filter(lowered: DataFrame, keywords: DataFrame, sizes: list[int], key: str) -> DataFrame:
    """The way for lexicons too large to broadcast: no text is shuffled, and texts are joined back only for long keywords.

    A Bloom filter of the anchors goes to the texts. Where a run passes it, the run and the characters behind it are handed
    on, VERIFY in all, and meet the keywords of that anchor. Keywords of more characters that agree so far, which are few,
    are then checked in their texts, for which `key` must be unique.
    """
    anchors = keywords.select("_anchor").distinct()
    bits = lowered.sparkSession.sparkContext.broadcast(anchor_filter(anchors))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = bits.value
        for batch in batches:
            keys, runs = [], []
            for name, text in zip(batch[key], batch["_text"]):
                met = set()
                for size in sizes:
                    places = _bits(_run_hashes(text, size), len(bitmap) << 3)
                    passed = np.logical_and(*[(bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in places])
                    met.update((text[i:i + size], text[i:i + VERIFY]) for i in np.flatnonzero(passed).tolist())
                keys += [name] * len(met)
                runs += sorted(met)
            yield pd.DataFrame({key: pd.Series(keys, dtype=batch[key].dtype), "_anchor": [r[0] for r in runs], "_run": [r[1] for r in runs]})

    runs = lowered.mapInPandas(found, with_fields(lowered.select(key).schema, _anchor="string", _run="string"))
    hits = (spread_join(runs, keywords.drop("_len"), "_anchor", "inner")
            .where(F.startswith(F.col("_run"), F.substring("keyword", F.lit(1), F.lit(VERIFY)))))
    short = hits.where(F.length("keyword") <= VERIFY).select(key, "skill")
    long = hits.where(F.length("keyword") > VERIFY).select(key, "skill", "keyword").distinct()
    checked = small_join(lowered, long, key).where(F.contains(F.col("_text"), F.col("keyword"))).select(key, "skill")
    return short.union(checked).distinct()
