"""Benchmark decontamination: training text that repeats a window of words of a benchmark item."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import ascii_lower, settle

# Words are runs of a-z, 0-9 and non-ASCII characters, after A-Z became lower case; this is what lies between them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# Windows in one broadcast hash table; more windows are searched block by block.
BLOCK = 100_000
# Contaminated documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN), "")


def _code(w: str, at: Column, length: int) -> Column:
    """A hash of up to four words spread over a run of `length` words; equal runs have equal codes."""
    picked = sorted({round(k * (length - 1) / 3) for k in range(4)})
    return F.xxhash64(F.lit(length), *[F.get(w, at + k) for k in picked])


def _codes(w: str, length: int) -> Column:
    """The codes of all runs of `length` words, by where they begin."""
    starts = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _code(w, i, length))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, gram, length, code) for every window of every item; an item of fewer words is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    spans = items.select("item_id", "w", F.explode(starts).alias("i")).select(
        "item_id", F.slice("w", F.col("i") + 1, window).alias("g")).distinct()
    coded = F.coalesce(*[F.when(F.size("g") == n, _code("g", F.lit(0), n)) for n in range(1, window + 1)])
    return spans.select("item_id", F.concat_ws(" ", "g").alias("gram"), F.size("g").alias("length"), coded.alias("code"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, n_words, copies, hits, items) per distinct document.

    `hits` lists (start, length) of windows found in the text, `items` the ids of the
    items they come from. `copies` counts equal rows.

    The windows are a hash set broadcast to every task, `block` of them at a time
    (about 20 MB); a hit is taken only if the words themselves are equal. A text is
    never shuffled: what leaves a scan is one row per document plus its hits.
    """
    found = settle(item_windows(benchmark, window))
    grams = found.groupBy("gram", "length", "code").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    sizes = grams.agg(F.count(F.lit(1)).alias("n"), F.collect_set("length").alias("lengths")).first()
    blocks = max(1, -(-sizes["n"] // block))
    lengths = sorted(sizes["lengths"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("d1"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("d2"),
                        words(F.col("text")).alias("w"))
    # One row per run of words, run lengths one after another, behind one row (at 0, without a code) for the text itself.
    codes = F.concat(F.array(F.lit(None).cast("long")), *[_codes("w", n) for n in lengths])
    probed = keyed.select("doc_id", "d1", "d2", "w", F.posexplode(codes).alias("at", "code"))
    runs, before = F.lit(1), {}
    for n in lengths:
        before[n] = runs
        runs = runs + F.greatest(F.size("w") - n + 1, F.lit(0))
    begins = F.col("at") - F.coalesce(*[F.when(F.col("length") == n, before[n]) for n in lengths], F.lit(0))
    parts = []
    for b in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b).select(
            F.col("code").alias("code_"), "length", "gram", "items")
        # Only the codes are join keys; the words are compared for the few rows that the hash set lets through.
        joined = probed.join(F.broadcast(part), F.col("code") == F.col("code_"), "left" if b == 0 else "inner")
        verified = F.concat_ws(" ", F.slice("w", begins + 1, F.col("length"))) == F.col("gram")
        parts.append(joined.where((F.col("at") == 0) | (F.col("gram").isNotNull() & verified)).select(
            "doc_id", "d1", "d2", F.when(F.col("at") > 0, begins).alias("at"), "length", "items",
            F.when(F.col("at") == 0, F.size("w").cast("long")).alias("n_words")))
    rows = reduce(DataFrame.union, parts)
    return (rows.groupBy("doc_id", "d1", "d2").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "length")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))


def covered(hits: Column) -> Column:
    """The number of words that lie in any of the sorted (start, length) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, zero, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["at"] + x["length"] - F.greatest(acc["end"], x["at"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["end"], x["at"] + x["length"]).alias("end")))["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits. Equal rows are all returned. Rows
    with a null doc_id or with one doc_id and different texts are told apart by their
    text. An empty benchmark leaves everything clean; an empty table gives an empty
    result. Benchmark items without a word are ignored; items with a null id count as
    one item named ''. Extra columns are not looked at.
    """
    per = scan(docs, benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), window, block)
    rows = per.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """`docs` without the documents that hold any window of any item; all columns stay.

    Rows are matched by doc_id and text, so a null doc_id is handled like any other.
    """
    bad = settle(scan(docs.select("doc_id", "text"), benchmark.select(F.col("item_id").cast("string"), "text"), window, block)
                 .where(F.size("hits") > 0).select(F.col("doc_id").alias("_id"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2")))
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    same = (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_d1"))
            & (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) == F.col("_d2")))
    return docs.join(bad, same, "left_anti")


def drop_hit_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, n_hit): every document with its hit words taken out, the words left joined by spaces.

    A document without a hit keeps its text as it is.
    """
    per = scan(docs.select("doc_id", "text"), benchmark.select(F.col("item_id").cast("string"), "text"), window, block)
    hit = per.where(F.size("hits") > 0).select(F.col("doc_id").alias("_id"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "hits")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_d1")) & (
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")) == F.col("_d2"))
    w = words(F.col("text"))
    kept = F.filter(w, lambda x, i: ~F.exists("hits", lambda s: (i >= s["at"]) & (i < s["at"] + s["length"])))
    return docs.select("doc_id", "text").join(hit, same, "left").select(
        "doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.concat_ws(" ", kept)).alias("text"),
        F.coalesce(covered(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"))
