"""Column functions on names and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def seq_name(node: Column) -> Column:
    """Dotted name of a method signature for sequences; null if it is not one."""
    t = F.trim(node)
    owner = F.translate(F.regexp_extract(t, r"^L([^;]*);", 1), "/", ".")
    method = F.regexp_replace(F.regexp_extract(t, r"->([^(]*)\(", 1), r"^<(.*)>$", "$1")
    return F.when(t.rlike(r"^L") & t.contains(";->") & t.contains("("), F.concat(owner, F.lit("."), F.substring_index(method, "$", 1)))


def feature_name(node: Column) -> Column:
    """Dotted name for features; other strings stay as they are."""
    owner = F.translate(F.regexp_extract(node, r"^L([^;]*);->", 1), "/", ".")
    method = F.regexp_extract(node, r";->([^(]*)", 1)
    method = F.when(method == "<init>", "init").otherwise(method)
    return F.when(node.rlike(r"^L") & node.contains(";->"), F.concat(owner, F.lit("."), method)).otherwise(node)


def node_name(node: Column) -> Column:
    return F.coalesce(seq_name(node), node)


def label_any(path: Column, bad: str = "malware", good: str = "benign") -> Column:
    """The bad key wins wherever both are in the path."""
    parts = F.split(F.lower(path), "/")
    return F.when(F.array_contains(parts, bad), 1).when(F.array_contains(parts, good), 0)


def label_nearest(path: Column, bad: str = "malware", good: str = "benign") -> Column:
    """The key nearest to the file wins."""
    last = F.try_element_at(F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(bad, good)), F.lit(-1))
    return F.when(last == bad, 1).when(last == good, 0)


def labels_exact(path: Column, bad: str = "malware", good: str = "benign") -> Column:
    """All labels whose key is in the path, in its own letter case."""
    parts = F.split(path, "/")
    return F.array_compact(F.array(F.when(F.array_contains(parts, good), 0), F.when(F.array_contains(parts, bad), 1)))


def sample_stem(file: Column) -> Column:
    base = F.substring_index(file, "/", -1)
    gexf = r"(?i)\.gexf(\.gz)?$"
    return F.when(base.rlike(gexf), F.regexp_replace(base, gexf, "")).otherwise(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))


def normal_label(label: Column) -> Column:
    n = label.try_cast("double")
    return F.when(n.isin(0.0, 1.0), n.cast("int"))


def suffix(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_") or "src"
