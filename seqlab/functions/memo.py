"""Memoise expression builders per SparkContext.

Column trees built only from column names and literals are reusable across DataFrames of one session; building
them again costs one JVM round trip per node. The cache is keyed by the active SparkContext so a new session never
sees stale JVM references.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def session_cached(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (id(sc), args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]

    wrapper.cache_clear = cache.clear
    return wrapper
