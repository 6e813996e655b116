"""Line dedup: an exact set-similarity join over the lines of all documents.

A line is the set of its lower-cased words. The words are ordered by rarity, and
only lines whose prefixes in that order share a word can be similar. Lines that pass
the length and positional filters are compared word by word, and the later one of a
similar pair is removed.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.llm.common import packed, settle

PERCENT = 80
# Words looked for among the frequent ones, and the ends of their classes, most frequent first.
FREQUENT = 6_000
CLASSES = (100, 1_000, FREQUENT)
TRACKED = 100_000
# Keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
UNNAMED = 1 << 62
HASH_BITS = 59
# Sets of this many words and more have sketches of four numbers: 64 bits fill up, and any two such sets would look alike.
LONG = 72
SKETCH = ("s0", "s1", "s2", "s3")


def _ordered(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ord, mark): documents are ordered by ord, texts of one ord are told apart by mark."""
    return docs.select("doc_id", "text", *more).withColumns({
        "ord": F.coalesce(F.col("doc_id").cast("long"), F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("text"), 3)),
        "mark": F.shiftleft(F.hash("text").cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), 32)})


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """Lower-cased words between white space; most lines only have blanks, which are cut without a pattern."""
    low = F.lower(line)
    other = [line.contains(F.lit(c)) for c in "\t\n\x0b\f\r"]
    return F.array_remove(F.when(other[0] | other[1] | other[2] | other[3] | other[4], F.split(low, r"\s+")).otherwise(F.split(low, " ")), "")


def frequent_words(docs: DataFrame, limit: int = FREQUENT) -> list[str]:
    """The most frequent words of all texts, most frequent first; at most `limit` come to the driver.

    A frequent-items sketch of bounded size, merged from all tasks, instead of a
    shuffle of the vocabulary. The list only sets the order of the words; any list
    gives the same result.
    """
    top = (docs.select(F.explode(_words(F.col("text"))).alias("w"))
           .agg(F.expr(f"approx_top_k(w, {limit}, {TRACKED})").alias("top")).first()["top"])
    return [r["item"] for r in sorted(top or [], key=lambda r: (-r["count"], r["item"]))]


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _keys(words: str, frequent: list[str]) -> Column:
    """Sorted distinct numbers of the words: the class of rarity above the bits of a hash, so rare words come first.

    Written as SQL text, since thousands of literals are slow to hand over one by one.
    """
    bounds = [0, *CLASSES]
    classes = [(len(CLASSES) - i, frequent[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if frequent[a:b]]
    cases = " ".join(f"WHEN w IN ({', '.join(map(_quoted, some))}) THEN {rank}L" for rank, some in classes)
    rank = f"CASE {cases} ELSE 0L END" if cases else "0L"
    key = f"shiftleft({rank}, {HASH_BITS}) | (xxhash64(w) & {(1 << HASH_BITS) - 1}L)"
    return F.expr(f"sort_array(array_distinct(transform({words}, w -> {key})))")


def _parity(words: str) -> str:
    """The parity of the words of each of 64 hash classes."""
    return f"aggregate({words}, 0L, (acc, x) -> acc ^ shiftleft(1L, cast(x & 63L AS int)))"


def line_classes(docs: DataFrame, frequent: list[str], percent: int = PERCENT) -> DataFrame:
    """One row per distinct set of words: (ord, spot) of its first line, n, sketch and prefix, and its number.

    `spot` is the mark of the text above the number of the line. `sketch` has one bit
    for the parity of the words of each of 64 hash classes, in sets of LONG words of
    each of 256: two sets differ in at least as many words as their sketches do in
    bits, and the four parts of a long one add up to one of 64 bits. Numbers rise
    with (ord, spot).
    """
    lines = (_ordered(docs).select("ord", "mark", F.posexplode(_lines(F.col("text"))).alias("line", "raw"))
             .where(F.col("raw").rlike(r"\S")))  # on the line itself, so that its words are not made twice
    keyed = lines.select("ord", F.col("mark").bitwiseOR(F.col("line").cast("long")).alias("spot"),
                         _words(F.col("raw")).alias("words")).select("ord", "spot", _keys("words", frequent).alias("k"))
    n = F.size("k")
    rows = keyed.select(
        "ord", "spot", F.xxhash64("k").alias("c1"), F.xxhash64(F.lit(1), "k").alias("c2"), n.alias("n"),
        F.expr(f"if(size(k) < {LONG}, array({_parity('k')}), transform(sequence(0, 3), j -> "
               f"{_parity('filter(k, x -> (shiftright(x, 6) & 3L) = j)')}))").alias("sketch"),
        F.slice("k", 1, n - F.ceil(n * percent / 100).cast("int") + 1).alias("prefix"))
    classes = (rows.groupBy("c1", "c2").agg(F.min(F.struct("ord", "spot")).alias("at"), F.first("n").alias("n"),
                                            F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
               .select("at.ord", "at.spot", "n", "sketch", "prefix"))
    return (classes.repartitionByRange("ord", "spot").sortWithinPartitions("ord", "spot")
            .withColumn("number", F.monotonically_increasing_id()))


def _parts(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}")) for s in SKETCH]


def _apart(a: str, b: str) -> Column:
    """In how many bits the parts of two sketches differ."""
    return reduce(Column.__add__, map(F.bit_count, _parts(a, b)))


def _may_match(a: str, b: str, percent: int) -> Column:
    """Length, positional and sketch filters for two postings of one word; `a` and `b` go before their columns.

    `np` holds the size of the set above the place of the word in its prefix. Two
    long sets are compared in all parts of their sketches, others in the sum of these.
    """
    n1, n2 = (F.shiftright(f"{x}np", 32) for x in (a, b))
    place = [F.col(f"{x}np").bitwiseAND(F.lit(0xFFFFFFFF)) for x in (a, b)]
    rest = F.least(n1 - place[0], n2 - place[1])
    apart = F.bit_count(reduce(Column.bitwiseXOR, _parts(a, b)))
    apart_long = _apart(a, b)
    return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * rest >= percent * (n1 + n2))
            & ((100 + percent) * apart <= (100 - percent) * (n1 + n2))
            & ((F.least(n1, n2) < LONG) | ((100 + percent) * apart_long <= (100 - percent) * (n1 + n2))))


def _postings(classes: DataFrame) -> DataFrame:
    """(word, number, np, parts of the sketch) for each word of each prefix."""
    parts = [F.coalesce(F.get("sketch", F.lit(i)), F.lit(0)).alias(s) for i, s in enumerate(SKETCH)]
    rows = classes.select("number", "n", *parts, F.posexplode("prefix").alias("place", "word"))
    return rows.select("word", "number", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("np"), *SKETCH)


def _checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` to be broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Numbers of the pairs (number, other) whose whole sets of words reach the similarity; the lines are read again."""
    numbers = pairs.select(F.explode(F.array("number", "other")).alias("number")).distinct()
    spots = classes.select("number", "ord", "spot").join(_checked_broadcast(settle(numbers)), "number", "left_semi")
    per = settle(spots.groupBy("ord", F.col("spot").bitwiseAND(F.lit(-(1 << 32))).alias("mark")).agg(F.collect_list(F.struct(
        F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("line"), "number")).alias("wanted")))
    texts = _ordered(docs).join(_checked_broadcast(per), ["ord", "mark"])
    lines = (texts.select(_lines(F.col("text")).alias("all"), "wanted")
             .select(F.explode(F.transform("wanted", lambda x: F.struct(x["number"].alias("number"), F.get("all", x["line"]).alias("raw")))).alias("x")))
    sets = settle(lines.select("x.number", F.array_distinct(_words(F.col("x.raw"))).alias("w")))
    other = sets.select(F.col("number").alias("other"), F.col("w").alias("w2"))
    common = F.size(F.array_intersect("w", "w2"))
    # Equal rows of `docs` give a set twice, hence distinct().
    return settle(pairs.join(sets, "number").join(other, "other").withColumn("common", common)
                  .where(100 * F.col("common") >= percent * (F.size("w") + F.size("w2") - F.col("common")))
                  .select("number").distinct())


def later_matches(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Numbers of the classes whose first line is similar to an earlier line.

    A posting that passes the filters against the first line of its word's list only
    meets that line there, any other posting meets every earlier line of its list. Of
    all lines a line meets, the one of the nearest sketch is compared with it, so
    that a group of near copies is not compared in all pairs. Lines that were left
    with a failed comparison are compared with all other earlier lines of their lists.
    """
    # Dealt by word once: both sides of the join read the same shuffle.
    postings = _postings(classes).repartition("word")
    hub = F.first(F.struct("number", "np", *SKETCH)).over(Window.partitionBy("word").orderBy("number"))
    hubbed = postings.withColumn("hub", hub).where(F.col("hub.number") < F.col("number")).withColumn("near", _may_match("", "hub.", percent))
    other = [F.col("number").alias("other"), F.col("np").alias("onp"), *[F.col(s).alias(f"o{s}") for s in SKETCH]]
    alone = F.col("near") & (F.col("other") == F.col("hub.number"))
    every = ~F.col("near") & (F.col("other") < F.col("number")) & _may_match("", "o", percent)
    met = hubbed.join(postings.select("word", *other), "word").where(alone | every).select("number", "other", "near", _apart("", "o").alias("apart"))
    pairs = settle(met.groupBy("number").agg(F.min(F.struct("apart", "other")).alias("nearest"),
                                             (F.max("near") | (F.min("other") != F.max("other"))).alias("others"))
                   .select("number", "nearest.other", "others"))
    removed = _verified(pairs.drop("others"), classes, docs, percent)
    failed = settle(pairs.where("others").select("number").join(removed, "number", "left_anti"))
    if failed.isEmpty():
        return removed
    probes = settle(_postings(classes.join(_checked_broadcast(failed), "number", "left_semi")))
    # Not dealt by word: few probes are broadcast, and the postings stay where they are.
    more = settle(_postings(classes).select("word", *other).join(_checked_broadcast(probes), "word")
                  .where((F.col("other") < F.col("number")) & _may_match("", "o", percent))
                  .select("number", "other").distinct().join(pairs.select("number", "other"), ["number", "other"], "left_anti"))
    return removed if more.isEmpty() else removed.union(_verified(more, classes, docs, percent))


def _kept(docs: DataFrame, percent: int) -> DataFrame:
    """(ord, mark, kept): the numbers of the lines with words that stay, per text."""
    classes = packed(line_classes(docs, frequent_words(docs), percent))
    removed = later_matches(docs, classes, percent)
    return (classes.select("number", "ord", "spot").join(_checked_broadcast(removed), "number", "left_anti")
            .groupBy("ord", F.col("spot").bitwiseAND(F.lit(-(1 << 32))).alias("mark"))
            .agg(F.collect_list(F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("kept")))


def _rebuilt(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(row, text, all, stay) of every row: its columns, its new text, its old lines and the numbers of those that stay."""
    # The text goes through the join once, in its row.
    rows = (_ordered(docs.select(F.struct("*").alias("row"), "doc_id", "text"), "row").select("row", "ord", "mark")
            .join(kept, ["ord", "mark"], "left").withColumn("text", F.col("row.text")).withColumn("all", _lines(F.col("text"))))
    blank = F.filter(F.transform("all", lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("stay", F.array_sort(F.array_union(F.coalesce("kept", F.array().cast("array<int>")), blank)))
    text = F.when(F.size("stay") == F.size("all"), F.col("text")).otherwise(
        F.array_join(F.transform("stay", lambda i: F.get("all", i)), "\n"))
    return rows.select("row", text.alias("text"), "all", "stay")


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, text without later lines, n_lines and n_removed.

    Lines are cut at line feeds and ordered by doc_id and place. A line is removed if
    an earlier line of any document, itself removed or not, has the same set of words
    or one with a Jaccard similarity of at least `percent` %. Lines without a word
    stay. Documents with a null id come behind all others in an order made from their
    text. Rows of one id and different texts are ordered by a hash of the text; equal
    rows are one document and all come out alike. A null text gives a null text and
    no lines. An empty table gives an empty result; extra columns are not looked at.
    """
    slim = docs.select("doc_id", "text")
    rows = _rebuilt(slim, _kept(slim, percent))
    return rows.select("row.doc_id", "text", F.greatest(F.size("all"), F.lit(0)).alias("n_lines"),
                       F.greatest(F.size("all") - F.size("stay"), F.lit(0)).alias("n_removed"))


def drop_later_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` with later lines taken out of `text` and `n_chars`, if there is one, counted anew.

    A document of which no line with a word is left goes; one that had none stays.
    """
    rows = _rebuilt(docs, _kept(docs.select("doc_id", "text"), percent))
    rows = rows.where((F.size("stay") == F.size("all")) | F.col("text").rlike(r"\S") | F.col("text").isNull())
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
