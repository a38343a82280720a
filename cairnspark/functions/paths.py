"""File paths, packages and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    """Without the last segment; '.' for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(base(path), r"(\.[^.]*)$", 1)


def path_of_id(node_id: Column) -> Column:
    return F.substring_index(node_id, "::", 1)


def is_test_path(path: Column) -> Column:
    """Test code by its path: Go and Python suffixes, test_ prefixes, TypeScript .test., .spec. and __tests__."""
    ts = path.rlike(r"\.tsx?$") & (base(path).contains(".test.") | base(path).contains(".spec.") | path.contains("__tests__/"))
    return path.endswith("_test.go") | path.endswith("_test.py") | (path.endswith(".py") & base(path).startswith("test_")) | ts


def is_test_file(path: Column) -> Column:
    """Test files by their base name, for domain maps: a wider rule than is_test_path."""
    return base(path).rlike(r"(?:_test\.go|_test\.py|\.test\.ts|\.spec\.ts|Tests?\.java)$|^test_")


def subsystem(package: Column, path: Column) -> Column:
    """Package, else directory, else (root)."""
    d = directory(path)
    return F.coalesce(F.nullif(package, F.lit("")), F.when((d != "") & (d != "."), d), F.lit("(root)"))


def domain(package: Column, path: Column, depth: int = 2) -> Column:
    """The first segments of the package, or else of the path, split on dots and slashes, lower-cased."""
    source = F.coalesce(F.nullif(package, F.lit("")), path, F.lit(""))
    parts = F.filter(F.split(F.lower(source), "[./]"), lambda s: s != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, max(1, depth)), "/"), F.lit("")), F.lit("external"))


def segments(package: Column) -> Column:
    return F.filter(F.split(package, "[./]"), lambda s: s != "")


def common_prefix(packages: DataFrame, column: str = "package") -> DataFrame:
    """One row (prefix array): the segments that all packages begin with, from the least and the largest."""
    ends = packages.agg(F.min(segments(F.col(column))).alias("a"), F.max(segments(F.col(column))).alias("b"))
    size = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size("a"), F.size("b"))), F.lit(0), lambda n, k: F.when((k > 0) & (n == k - 1) & (F.try_element_at("a", F.greatest(k, F.lit(1))) == F.try_element_at("b", F.greatest(k, F.lit(1)))), k).otherwise(n)
    )
    return ends.select(F.slice("a", 1, size).alias("prefix"))


def test_sources(path: Column) -> Column:
    """Where the source of a TypeScript test may be: beside it without .test or .spec, or above __tests__."""
    flat = F.regexp_replace(path, r"\.(?:test|spec)(\.[^./]*)$", "$1")
    above = F.regexp_replace(flat, r"(^|/)__tests__/([^/]*)$", "$1$2")
    found = F.array(F.when(flat != path, flat), F.when(above != flat, above))
    return F.filter(found, lambda x: x.isNotNull())
