"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from jobgrain.llm import decontamination, html, lines, mtree, ngram_join, pieces, pii, quality, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHES = ["n", "w", "node", "nid", "ord", "mark", "size", "shard", "slot", "hits", "row", "root", "place", "found", "new", "b", "features", "_document"]
LONG = " ".join(f"word{i % 977} and" for i in range(30_000)) + "."
ROWS = [
    (1, "The cat sat on the mat, and the dog lay by the door. It was a warm day in May, so they slept. Nobody came to wake them up.", "en", "a", 100),
    (1, "The cat sat on the mat, and the dog lay by the door. It was a warm day in May, so they slept. Nobody came to wake them up.", "en", "a", 100),
    (2, "the cat sat on the mat, and the dog lay by the door. It was a warm day in May, so they slept. Nobody came to wake them up.", None, None, None),
    (None, "The cat sat on the mat, and the dog lay by the door. It was a warm day in May, so they slept. Nobody came to wake them up.", "en", "b", 7),
    (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, " \n\t ", "de", "a", 4), (6, "one", "de", "c", 3),
    (7, LONG, "en", "a", len(LONG)), (None, None, None, None, None), (3, "another text of the same id", "en", "a", 27),
    (8, "Ärger mit dem Café, naïve Leute, 名前 und U+2581 ▁ und \u0000 Null.\n\nZweite Zeile", "de", "a", 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a warm day in May"), (2, None), (3, ""), (4, "a warm day in May"), (None, "so they slept"),
                                  (5, "it was a warm day in may so they slept nobody came to wake them up")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_line_dedup(docs, none):
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(ROWS)
    texts = {r.doc_id: r for r in got if r.doc_id is not None}
    assert texts[1].n_removed == 0 and texts[2].text == "" and texts[2].n_removed == 1
    assert [r.text for r in got if r.doc_id == 1] == [ROWS[0][1]] * 2  # equal rows are one document
    assert sorted(repr(r.text) for r in got if r.doc_id is None) == ["''", "None"]
    assert texts[4].text == "" and texts[5].text == " \n\t " and texts[8].text == ROWS[11][1]
    assert lines.dedup_lines(none).count() == 0
    left = lines.drop_later_lines(docs)
    assert left.columns == docs.columns and left.where("doc_id = 2").isEmpty()
    assert left.where("n_chars != length(text) and text is not null").isEmpty()
    assert lines.drop_later_lines(none).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<article><p>a &amp; b <br> c</p><p>d"),
                                   (4, "u", "<article><p>a &amp; b <br> c</p><p>d"), (5, "u", "<article>" + "<p>long text</p>" * 20_000)],
                                  "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("clash")})
    got = html.extract(pages).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id == 4] == ["a & b c\n\nd"] * 2
    assert {r.page_id: r.text for r in got}[1] == "" and {r.page_id: r.n_chars for r in got}[2] == 0
    assert {r.page_id: r.text.count("\n\n") for r in got}[5] == 19_999
    assert html.extract(pages.where("false")).count() == 0


def test_pii(docs, none):
    got = pii.pseudonymise(docs, "k").collect()
    assert [(r.doc_id, r.text, r.n_pii) for r in got] == [(r[0], r[1], 0) for r in ROWS]
    assert pii.pseudonymise(none, "k").count() == 0


def test_pieces(docs, none):
    got = pieces.encode(docs).collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    assert all(r.ids == [] and r.others == [] for r, x in zip(got, ROWS) if not x[1])
    back = pieces.decode(pieces.encode(docs)).collect()
    assert [r.text for r in back] == [x[1] or "" for x in ROWS]
    assert pieces.encode(none).count() == 0


def test_substrings(docs, none):
    got = substrings.dedup(docs).collect()
    assert len(got) == len(ROWS)
    assert [r.text for r in got if r.doc_id == 1] == [ROWS[0][1]] * 2
    assert {r.doc_id: r.text for r in got}[2] == ""  # the same sentences in other letters
    assert {r.doc_id: r.text for r in got}[6] == "one" and {r.doc_id: r.text for r in got}[4] == ""
    assert sorted(r.text for r in got if r.doc_id == 3) == ["", "another text of the same id"]
    assert substrings.dedup(none).count() == 0


def test_decontamination(docs, none, benchmark):
    got = decontamination.contamination(docs, benchmark).collect()
    assert len(got) == len(ROWS)
    one = [r for r in got if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1] and one[0].n_items == 4 and one[0].n_hit == 16 and one[0].contaminated
    assert all(r.n_words == 0 and not r.contaminated for r in got if r.doc_id in (4, 5))
    assert decontamination.contamination(docs, benchmark.where("false")).where("contaminated").isEmpty()
    assert decontamination.contamination(none, benchmark).count() == 0
    clean = decontamination.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 4
    cut = {r.doc_id: r for r in decontamination.drop_hit_words(docs, benchmark).collect()}
    assert cut[2].n_hit == 16 and cut[2].text.startswith("the cat sat") and "warm" not in cut[2].text and cut[6].text == "one"
    blocks = decontamination.contamination(docs, benchmark, block=1)
    assert by_id(blocks, *blocks.columns) == by_id(decontamination.contamination(docs, benchmark), *blocks.columns)


def test_sharding(docs, none):
    got = sharding.hilbert_shards(docs, shards=5)
    rows = got.collect()
    counts = [sum(r.shard == s for r in rows) for s in range(5)]
    assert sum(counts) == len(ROWS) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in enumerate(counts))
    assert {r.doc_id: r.size for r in rows}[4] == 1
    assert sharding.hilbert_shards(none).count() == 0


def test_quality(docs, none, labels):
    for some in (labels, labels.where("false"), labels.where("quality = 1"), labels.where("quality = 0")):
        got = quality.score(docs, quality.fit(docs, some)).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    kept = quality.keep_good(docs, quality.fit(docs, labels.where("false")))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_ngram_join(docs, none):
    got = ngram_join.join_components(docs).collect()
    assert len(got) == len(ROWS)
    same = {r.doc_id: r for r in got}
    assert same[1].component_id == same[2].component_id == 1 and same[4].component_id == 4 and same[4].n_shingles == 0
    assert sorted(repr(r.component_id) for r in got if r.doc_id is None) == ["1", "None"]
    assert same[6].n_shingles == 1 and ngram_join.join_components(none).count() == 0
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in one.collect()) == sorted(["1", "1", "3", "3", "4", "5", "6", "7", "8", "None"])
    assert ngram_join.keep_one(none).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (None, [1.0, 0.0]), (0, [0.25, 0.0]), (3, None), (4, [1.0, None]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (50, []), (8, [1.0, 0.0, 1.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "rid", "dim", "id", "label", "rank")})
    got = [tuple(r) for r in mtree.top_k(df).collect()]
    first = sorted((r for r in got if r[0] == 0 and r[1] == 1), key=repr)
    assert len(first) == 2 and first[0][2:] == (1, 16384) and first[1][2:] == (0, 65536) or first[1][2:] == (1, 65536)
    assert [r for r in got if r[0] == 50] == [(50, 1, 7, 0)]
    assert any(r[2] is None for r in got) and not any(r[2] in (3, 4, 5, 6, 8) for r in got)
    assert mtree.top_k(df.where("false")).count() == 0
    with pytest.raises(ArithmeticError):
        mtree.top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"))
