"""N-gram Jaccard join: a grouped prefix join over the sets of word n-grams of documents.

Distinct sets are nodes. Each set is sorted by a fixed order of the grams, frequent
ones last; two sets can only reach the similarity if their prefixes share a gram.
Nodes of equal prefix and size form a group, group pairs are filtered by length and
position, and the pairs that pass are expanded to their members and verified.

A set of near copies is not expanded into all its pairs: first every group is
compared with the first group of each of its prefix grams, then only pairs that the
links found so far leave in different components are compared. No link between two
components is lost, so the components are exact.
"""

from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.llm.common import connected, settle, small_batches

N = 4
PERCENT = 85
# Grams that are ordered by their count; all others come before them in hash order.
FREQUENT = 500_000
FLUSH = 1_000_000
SEED = 20_240_229
# An odd factor with well-mixed bits (the golden ratio times 2**64).
MIX = np.uint64(0x9E3779B97F4A7C15)
# Texts handed to a Python worker at once: with the default of 10,000 they are most of its memory.
BATCH = 500
# Keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

SET = "node binary, n int, family binary, sketch array<long>, prefix array<long>"
# Least bits of a sketch: the parity of the grams of each hash class. Sets differ in at least as many grams as sketches in bits.
SKETCH = 1_024


def all_codes(text: str | None, n: int) -> np.ndarray:
    """64-bit codes of the n-grams of a text in order; of the whole sequence if it has fewer words.

    Words are separated by ASCII white space and lower-cased within ASCII, which is
    what bytes.split and bytes.lower do. A code mixes the codes of its words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    count = len(words)
    if not count:
        return np.empty(0, np.int64)
    codes = np.fromiter([xxhash.xxh3_64_intdigest(w, SEED) for w in words], np.uint64, count)
    size = min(n, count)
    mixed = np.full(count - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX + codes[k:count - size + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def gram_codes(text: str | None, n: int) -> np.ndarray:
    """The set of codes of a text, sorted."""
    return np.unique(all_codes(text, n))


def prefix_length(n: int, percent: int) -> int:
    """Two sets of similarity `percent` share one of this many first grams of the larger one, and of the smaller."""
    return n + (-percent * n) // 100 + 1 if n else 0


def sketch_bits(n: int) -> int:
    """Bits of the sketch of n grams, a power of two: half of n at least, else any two large sets would look alike."""
    return max(SKETCH, 1 << (n // 2).bit_length())


def frequent_grams(docs: DataFrame, n: int = N, limit: int = FREQUENT) -> np.ndarray:
    """Codes of the most frequent grams, the most frequent one last.

    Every task counts the grams of all its documents and hands on those it saw more
    than once; the sums are ordered and the first `limit` kept. The list only sets
    the order of the grams, so any list gives the same links; a good one keeps
    passages that many documents share out of the prefixes.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flushed():
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"gram": codes[counts > 1], "c": counts[counts > 1]})

        for batch in batches:
            for text in batch["text"]:
                held.append(all_codes(text, n))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    with small_batches(docs.sparkSession, BATCH):
        top = (docs.select("text").mapInPandas(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
               .where("c > 3").orderBy(F.desc("c"), "gram").limit(limit).select("gram").toPandas())
    return top["gram"].to_numpy(np.int64)[::-1]


def gram_sets(docs: DataFrame, frequent: np.ndarray, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id and mark (a hash of the text) with the set: node (128-bit digest), n, family (digest of size and prefix), sketch and prefix."""
    by_code = np.argsort(frequent, kind="stable")
    known = frequent[by_code]

    @F.pandas_udf(SET)
    def described(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            codes = gram_codes(text, n)
            if not len(codes):
                rows.append((None, 0, None, None, None))
                continue
            rank = np.zeros(len(codes), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                rank = np.where(known[at] == codes, by_code[at] + 1, 0)
            prefix = codes[np.lexsort((codes, rank))][:prefix_length(len(codes), percent)]
            node = xxhash.xxh3_128_digest(codes.tobytes())
            bits = sketch_bits(len(codes))
            parity = np.bincount(codes & (bits - 1), minlength=bits) & 1
            rows.append((node, len(codes), xxhash.xxh3_128_digest(np.append(prefix, len(codes)).tobytes()),
                         np.packbits(parity.astype(np.uint8)).view(np.int64), prefix))
        return pd.DataFrame(rows, columns=["node", "n", "family", "sketch", "prefix"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), described("text").alias("s")).select("doc_id", "mark", "s.*")


def _may_reach(n1, n2, at1, at2, percent: int):
    """Length and positional filters for sets of n1 and n2 grams that share one at at1 and at2."""
    rest = F.least(n1 - at1, n2 - at2)
    return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
            & ((100 + percent) * rest.cast("long") >= percent * (n1 + n2).cast("long")))


def _apart() -> Column:
    """In how many bits the sketches sa and sb differ; the larger one is folded, for parities of classes add up."""
    folded = "transform(sequence(0, {m} - 1), i -> aggregate(sequence(i, size({s}) - 1, {m}), 0L, (t, j) -> t ^ {s}[j]))"
    differing = "aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"
    less, more = (folded.format(s=s, m=f"size({m})") for s, m in (("sb", "sa"), ("sa", "sb")))
    return F.expr(f"case when size(sa) = size(sb) then {differing.format(a='sa', b='sb')} "
                  f"when size(sa) < size(sb) then {differing.format(a='sa', b=less)} else {differing.format(a=more, b='sb')} end")


def _checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` to be broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; the sets are read again, from one document of each node."""
    @F.pandas_udf("grams array<long>, node binary")
    def described(texts: pd.Series) -> pd.DataFrame:
        sets = [gram_codes(t, n) for t in texts]
        return pd.DataFrame({"grams": sets, "node": [xxhash.xxh3_128_digest(g.tobytes()) for g in sets]})

    # Else the test for null that a join implies is made on the function's result, for all documents, below the semi-join.
    described = described.asNondeterministic()
    marks = nodes.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = nodes.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    pairs = settle(pairs.join(marks, "a").join(other, "b")
                   .where((100 + percent) * _apart() <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b"))
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes, "nid").select("nid", "node", "id"))
    slim = docs.select("doc_id", "text")
    ids = wanted.where("id is not null").select(F.col("id").alias("doc_id")).distinct()
    texts = slim.join(_checked_broadcast(ids), "doc_id", "left_semi").select("text")
    if not wanted.where("id is null").isEmpty():  # nodes that only documents without an id have
        texts = texts.union(slim.where("doc_id is null").select("text"))
    # A repeated id may bring other texts along; the digest tells which set was read.
    with small_batches(docs.sparkSession, BATCH):
        read = texts.select(described("text").alias("s")).select("s.*")
        grams = settle(read.join(wanted.select("nid", "node"), "node").select("nid", "grams"))
    left = grams.select(F.col("nid").alias("a"), F.col("grams").alias("ga"))
    right = grams.select(F.col("nid").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return settle(pairs.join(left, "a").join(right, "b").withColumn("both", both)
                  .where(100 * F.col("both") >= percent * (F.size("ga") + F.size("gb") - F.col("both")))
                  .select("a", "b").distinct())


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds `root` to rows with a nid; a node without links is its own root."""
    return df.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))


def join_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, links, node, mark and root of every row.

    component_id is the smallest doc_id that links reach, its own row included; links
    counts the different sets verified as similar to the row's set on the way (0 for
    a set that is in no pair); node is the digest of the set, so exact copies share
    it; mark is a hash of the text; root names the component even where its id is
    null, and is null for an empty set. A null or empty text has an empty set and is linked with nothing: its
    component is its own id. Rows with a null doc_id take part and pass links on, but
    a component is only named null if it has no other. Repeated rows are all
    returned. Extra columns are not looked at. An empty table gives an empty result.
    """
    frequent = frequent_grams(docs, n)
    with small_batches(docs.sparkSession, BATCH):
        sets = settle(gram_sets(docs.select("doc_id", "text"), frequent, n, percent))
    nodes = settle(sets.where("n > 0").groupBy("node", "n", "family").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
                   .withColumn("nid", F.monotonically_increasing_id()))
    # Families of several members; the member of lowest number stands for all of them.
    crowded = nodes.groupBy("family", "n").agg(F.min("nid").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    crowded = settle(nodes.select("nid", "family", "n").join(crowded, ["family", "n"]).select("nid", "head"))
    heads = nodes.join(_checked_broadcast(crowded.where("nid != head").select("nid")), "nid", "left_anti")
    postings = heads.select("nid", "n", F.posexplode("prefix").alias("at", "gram"))
    per_gram = Window.partitionBy("gram")
    # Grams that only one family has in its prefix give no pair.
    shared = settle(postings.withColumn("lists", F.count(F.lit(1)).over(per_gram))
                    .withColumn("hub", F.first(F.struct("at", "nid", "n")).over(per_gram.orderBy("at", "n", "nid")))
                    .where("lists > 1").drop("lists"))

    stars = shared.where((F.col("hub.nid") != F.col("nid")) & _may_reach(F.col("n"), F.col("hub.n"), F.col("at"), F.col("hub.at"), percent))
    stars = settle(stars.select(F.least("nid", "hub.nid").alias("a"), F.greatest("nid", "hub.nid").alias("b"))
                   .union(crowded.where("nid != head").select(F.least("nid", "head"), F.greatest("nid", "head"))).distinct())
    links = _verified(stars, docs, nodes, n, percent)
    roots = connected(links, "a", "b")

    # What the first links leave apart: families of one gram that are in different components.
    lists = _rooted(shared.drop("hub"), roots)
    apart = lists.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gram")
    lists = settle(lists.join(apart, "gram"))
    met = _met(lists, lists, percent).where("nid < nid2")
    if not crowded.isEmpty():
        met = met.union(_members_apart(shared.drop("hub"), crowded, roots, percent))
    pairs = settle(met.select(F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b")).distinct()
                   .join(stars, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        more = _verified(pairs, docs, nodes, n, percent)
        if not more.isEmpty():
            links = links.union(more)
            roots = connected(links, "a", "b")
    degrees = links.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("links"))
    placed = _rooted(nodes.select("nid", "node", "id"), roots).join(degrees, "nid", "left")
    lowest = placed.groupBy("root").agg(F.min("id").alias("component"))
    found = placed.join(lowest, "root").select("node", "component", "links", "root")
    return (sets.select("doc_id", "n", "node", "mark").join(found, "node", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.coalesce("links", F.lit(0)).alias("links"), "node", "mark", "root"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each component: the one of smallest id, all columns unchanged.

    Documents without words stay. Documents with a null id only stay if their
    component has no other, then the one of smallest hash. Rows equal in id and text
    are one document.
    """
    placed = settle(join_components(docs, n, percent).where("root is not null").select("doc_id", "mark", "root"))
    keeper = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("kept"), F.count(F.lit(1)).alias("size"))
    losers = settle(placed.join(keeper.where("size > 1"), "root").where(
        ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("mark") == F.col("kept.mark"))))
        .select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_mark"))
    return docs.join(_checked_broadcast(losers), same, "left_anti")


def _met(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(nid, nid2) of rows of one gram in different components that pass the filters."""
    other = right.select("gram", *[F.col(c).alias(f"{c}2") for c in ("nid", "n", "at", "root")])
    return (left.join(other, "gram").where((F.col("root") != F.col("root2"))
                                           & _may_reach(F.col("n"), F.col("n2"), F.col("at"), F.col("at2"), percent))
            .select("nid", "nid2"))


def _members_apart(lists: DataFrame, crowded: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs with a member of a crowded family, in different components: expanded from group pairs to members.

    A member stands for its family in the lists of its grams; a family of one member is its own member.
    """
    members = _rooted(crowded, roots)
    within = (members.join(members.select("head", F.col("nid").alias("nid2"), F.col("root").alias("root2")), "head")
              .where("nid < nid2 and root != root2").select("nid", "nid2"))
    standing = lists.withColumnRenamed("nid", "head")
    many = standing.join(members, "head").select("gram", "nid", "n", "at", "root")
    alone = _rooted(lists.join(crowded.select(F.col("head").alias("nid")).distinct(), "nid", "left_anti"), roots)
    return _met(many, many.union(alone.select("gram", "nid", "n", "at", "root")), percent).where("nid != nid2").union(within)
