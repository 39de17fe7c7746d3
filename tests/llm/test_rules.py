"""Verdicts of the quality rules on junk that loose cutoffs or non-robust starts let through."""

import pytest
from pyspark.sql import functions as F

from memloom.llm import quality_rules


def counted(spark, rows):
    """rows: source, n_words, word_chars, n_symbols, n_lines, n_dup_lines."""
    df = spark.createDataFrame([(i, "en", *r, 0, False) for i, r in enumerate(rows)], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, _n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    return [r["kept"] for r in quality_rules.verdicts(df).orderBy("doc_id").collect()]


def plain(n, source="s"):
    return [(source, 100 + (37 * i) % 150, 5 * (100 + (37 * i) % 150) + i % 60, i % 3, 10, 0) for i in range(n)]


def test_distribution():
    assert quality_rules.chi_squared(20.515, 5) == pytest.approx(0.999, abs=1e-5) and quality_rules.consistency(0.5, 5) == pytest.approx(1.912, abs=0.01)


def test_symbols_and_repeated_lines_are_rejected(spark):
    junk = [("s", 150, 750, 75, 10, 0)] * 4 + [("s", 150, 750, 1, 10, 5)] * 4
    kept = counted(spark, plain(200) + junk)
    assert all(kept[:200]) and not any(kept[200:])


def test_clustered_junk_and_small_groups(spark):
    """40 % of a source is junk of one kind; another source is too small for an estimate of its own."""
    junk = [("s", 100 + (37 * i) % 150, 5 * (100 + (37 * i) % 150) + i % 60, 90 + i % 9, 10, 5) for i in range(120)]
    kept = counted(spark, plain(180) + junk + plain(5, "t") + [("t", 150, 750, 95, 10, 5)])
    assert all(kept[:180]) and not any(kept[180:300]) and all(kept[300:305]) and not kept[305]
