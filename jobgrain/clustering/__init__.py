"""Grouping of postings by mixed features, scored by silhouette.

All steps work on distinct feature tuples with their row counts. A posting's
features have few distinct values, so the tuples are far fewer than the rows;
nothing here depends on that for correctness.
"""
