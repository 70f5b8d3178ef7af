"""Comparing DataFrames in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.testing import assertDataFrameEqual


def assert_same(actual: DataFrame, expected: DataFrame, message: str | None = None, **options) -> None:
    try:
        assertDataFrameEqual(actual, expected, **options)
    except AssertionError as error:
        raise AssertionError(f"{message}: {error}" if message else str(error)) from error


def same(a: DataFrame, b: DataFrame, **options) -> bool:
    try:
        assertDataFrameEqual(a, b, **options)
    except AssertionError:
        return False
    return True
