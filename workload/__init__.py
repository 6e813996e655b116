"""Checked queries: the operators over postings derived from the supplied tables."""


def _load():
    from workload import cleaning, filtering, statistics, clusters, files, registry  # noqa: F401
    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
