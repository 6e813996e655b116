"""One large JSON array file read by all cores.

A file that is one array has no line structure to split on, so Spark reads it in one
task. Here the text reader cuts it after every closing brace, which works at any split
of the file. Whether a brace ends a record depends on what came before: on being inside
a string, and on the depth of brackets. A first pass sums both up for every split, once
for either case at its start; prefix sums over the splits give each its true state; a
second pass cuts the records at depth one. Records that cross splits are joined from
their pieces, of which a split has two at most.
"""

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.operators.scale import settle

WHOLE, TAIL, MIDDLE, HEAD = 0, 1, 2, 3
_ESCAPED = re.compile(r"\\.", re.DOTALL)
# What may stand before a record and after the last one; a file may begin with a byte order mark.
_BEFORE = re.compile(r"﻿?\s*[\[,]?\s*")
_END = re.compile(r"﻿?\s*\[?\s*\]\s*")


def _balance(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _steps(segment: str) -> tuple[int, int, int]:
    """Parity of the quotes of a segment, and the change of depth if it starts outside, or inside, a string."""
    pieces = _ESCAPED.sub("", segment).split('"')
    odd = (len(pieces) - 1) & 1
    outside, inside = _balance("".join(pieces[::2])), _balance("".join(pieces[1::2]))
    # The brace behind the segment counts if it is outside a string.
    return odd, outside - (0 if odd else 1), inside - (1 if odd else 0)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): the text between closing braces, in order within a split."""
    return (spark.read.option("lineSep", "}").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"))


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parity and both changes of depth of every split, or of the part of one that a batch holds, numbered in order."""
    part = 0
    for batch in batches:
        for (file, split), rows in batch.groupby(["file", "split"], sort=False):
            inside, depths = [False, True], [0, 0]
            for segment in rows["value"]:
                odd, out, into = _steps(segment)
                for case in (0, 1):
                    depths[case] += into if inside[case] else out
                    inside[case] ^= bool(odd)
            yield pd.DataFrame({"file": [file], "split": [split], "part": [part], "odd": [inside[0]], "outside": [depths[0]], "inside": [depths[1]]})
            part += 1


def _start_states(segments: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """(inside a string, depth) at the start of every split; raises if a file is not balanced."""
    found = segments.mapInPandas(_summed, "file string, split long, part long, odd boolean, outside long, inside long").collect()
    states, at = {}, {}
    for row in sorted(found, key=lambda r: (r["file"], r["split"], r["part"])):
        inside, depth = at.get(row["file"], (False, 0))
        states.setdefault((row["file"], row["split"]), (inside, depth))
        at[row["file"]] = inside ^ row["odd"], depth + (row["inside"] if inside else row["outside"])
    for file, (inside, depth) in at.items():
        # The reader's last piece has no brace behind it, but one was counted.
        if inside or depth != -1:
            raise ValueError(f"{file} does not hold one whole JSON array")
    return states


def _cut(states: dict[tuple[str, int], tuple[bool, int]]):
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, inside, depth, held, kind = None, False, 0, [], HEAD
        for batch in batches:
            out = []
            for file, split, segment in zip(batch["file"], batch["split"], batch["value"]):
                if (file, split) != here:
                    if held:
                        out.append((*here, kind, "".join(held)))
                    here, (inside, depth) = (file, split), states[file, split]
                    held, kind = [], MIDDLE  # until a record ends, the split may be the middle of one
                odd, outside, into = _steps(segment)
                if depth <= 1 and not inside:
                    start = segment.find("{")
                    before = segment if start < 0 else segment[:start]
                    if not (_BEFORE if start >= 0 else _END).fullmatch(before):
                        if before.strip():
                            raise ValueError(f"{file}: {before.strip()[:80]!r} is not a record of the array")
                    held, kind = ([segment[start:] + "}"] if start >= 0 else []), HEAD
                else:
                    held.append(segment + "}")
                depth += into if inside else outside
                inside ^= bool(odd)
                if held and depth == 1 and not inside:
                    out.append((file, split, WHOLE if kind == HEAD else TAIL, "".join(held)))
                    held, kind = [], HEAD
            if out:
                yield pd.DataFrame(out, columns=["file", "split", "kind", "text"])
        if held:
            yield pd.DataFrame([(*here, kind, "".join(held))], columns=["file", "split", "kind", "text"])
    return records


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every object of files that are one JSON array each, whatever their layout.

    Three passes over the text, all of them split. An array of anything but objects, or a file that is cut off, raises.
    """
    segments = _segments(spark, path)
    cut = segments.mapInPandas(_cut(_start_states(segments)), "file string, split long, kind int, text string")
    whole = cut.where(F.col("kind") == WHOLE).select("file", "text")
    pieces = settle(cut.where(F.col("kind") != WHOLE))
    # The pieces behind a head, up to the next one, belong to it. Only places are put in order, not the text.
    last = F.last(F.when(F.col("kind") == HEAD, F.col("split")), ignorenulls=True)
    order = W.partitionBy("file").orderBy("split", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    owner = pieces.select("file", "split", "kind", last.over(order).alias("head"))
    ordered = F.array_sort(F.collect_list(F.struct("split", "kind", "text")))
    joined = (pieces.join(owner, ["file", "split", "kind"]).groupBy("file", "head")
              .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text")))
    return whole.union(joined.select("file", "text"))


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of array files as rows of `schema`; a malformed one fails the read."""
    parsed = F.from_json("text", schema, {"mode": "FAILFAST"})
    return array_records(spark, path).select(parsed.alias("r")).select("r.*")
