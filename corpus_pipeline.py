"""Corpus cleaning in stages; each stage works on what its predecessor kept."""

from jobgrain.llm import decontamination, lines, ngram_join, pieces, quality
from jobgrain.llm.common import settle, table


def keep_quality(spark, docs, sf_dir):
    """Documents that the learned quality ranking accepts; the others go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark, docs, sf_dir):
    """Documents without the lines that repeat an earlier line; a document with nothing left goes."""
    return lines.drop_later_lines(docs)


def dedup_documents(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, Jaccard similarity of at least 0.8."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def decontaminate(spark, docs, sf_dir):
    """Documents without any window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Pieces of the four best segmentations of every document."""
    return pieces.encode(docs)


STAGES = [("quality", keep_quality), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents),
          ("decontamination", decontaminate), ("SentencePiece", encode)]

# Learned weights and piece lattices are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; each result but the last is written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
