"""Values that nobody may change, and the caches that keep few of them."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Hashable, Mapping
from types import MappingProxyType
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that each cache keeps.
CACHE_SIZES = {"embeddings": 256, "titles": 2048, "ontology": 1, "graph": 4}


def freeze(value: Any) -> Any:
    """A copy that can't be changed, all the way down: read-only maps and tuples; only what JSON knows, text keys."""
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys must be text")
        return MappingProxyType({k: freeze(v) for k, v in value.items()})
    if isinstance(value, list | tuple):
        return tuple(map(freeze, value))
    if value is None or isinstance(value, str | int | float | bool):
        return value
    raise TypeError(f"JSON has no {type(value).__name__}")


def thaw(value: Any) -> Any:
    """The same as plain dicts and lists."""
    if isinstance(value, Mapping):
        return {k: thaw(v) for k, v in value.items()}
    return [*map(thaw, value)] if isinstance(value, tuple) else value


def frozen_json(x: Column | str) -> Column:
    """JSON texts with sorted keys and no blanks, as values that hold only what JSON knows; what is no JSON is an error."""
    return F.to_json(F.parse_json(x))


class Recent:
    """The results of a function for the keys that were asked last, so many at most."""

    def __init__(self, make: Callable[[Hashable], Any], size: int):
        self.make, self.size, self.kept, self.hits = make, size, OrderedDict(), 0

    def get(self, key: Hashable) -> Any:
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
        else:
            self.kept[key] = self.make(key)
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        return self.kept[key]


def caches(makers: dict[str, Callable[[Hashable], Any]]) -> dict[str, Recent]:
    """A cache of its fixed size for each name."""
    return {name: Recent(make, CACHE_SIZES[name]) for name, make in makers.items()}


def recent_hits(keys: pd.Series, size: int) -> list[bool]:
    """Of each key in turn, whether a cache of that size holds it."""
    cache, out = Recent(lambda k: k, size), []
    for k in keys:
        before = cache.hits
        cache.get(k)
        out.append(cache.hits > before)
    return out
