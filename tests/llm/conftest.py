import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from helpers_llm import words  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from srcframe.session import get_spark
    yield get_spark(master="local[4]", shuffle_partitions=4)


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp string, key int, size double, "
          "score double, block int, number int, bucket string, held_out string, word string, start int")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, and
    extra columns with names that operators use inside."""
    long = words(40_000, 1)
    rows = [(1, words(60, 2), "en", "a"), (2, words(60, 2), "en", "b"), (3, words(60, 2) + " more", "en", "a"),
            (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", "fr", None), (7, long, "en", "c"),
            (8, long + " tail", None, "c"), (None, words(30, 3), "de", "b"), (9, "one", "en", "a"), (10, "One", "en", "é"),
            (11, words(50, 4), "en", "a"), (11, words(50, 4), "en", "a"), (12, "!!! 123 ???", "en", "a"),
            (13, "ü é ß", "de", "Z"), (None, None, None, None)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, 0.5, 0.1, 7, 3, "b", "h", "w", 2)
                                  for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="session")
def labels(spark):
    """Two classes, a null id, null labels, a repeated row and unknown documents."""
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(None, 1, 1), (1, 1, None), (2, None, 0), (3, 1, 0),
                                                               (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
