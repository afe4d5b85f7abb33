"""Key expressions: partition keys, group keys, local names, kinds of language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termindex import rules


def root_key(path: Column | str, filetype: Column | str | None = None) -> Column:
    """Partition key of a root path: ``/`` becomes ``__``, optional ``_<filetype>``."""
    key = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("/"), F.lit("__"))
    return key if filetype is None else F.concat_ws("_", key, filetype)


def group_key(filetype: Column | str, kind: Column | str) -> Column:
    """``<filetype>#<kind>``."""
    return F.concat_ws("#", filetype, kind)


def output_key(filetype: Column | str, kind: Column | str, group: Column | str) -> Column:
    """Name of the produced group: filetype, kind and target group."""
    return F.concat_ws("_", F.replace(group_key(filetype, kind), F.lit("#"), F.lit("_")), group)


def local_name(name: Column | str, kind: Column | str) -> Column:
    """Part after the scope prefix of a function name, ``s:foo`` -> ``foo``."""
    name = F.col(name) if isinstance(name, str) else name
    kind = F.col(kind) if isinstance(kind, str) else kind
    scoped = (kind == "f") & F.contains(name, F.lit(":"))
    return F.when(scoped, F.regexp_replace(name, "^[^:]*:", "")).otherwise(name)


def language_family(language: Column | str) -> Column:
    """Canonical language key: C and C++ share one catalogue."""
    low = F.lower(language)
    return F.when(low.isin(rules.C_FAMILY), F.lit("c_family")).otherwise(low)
