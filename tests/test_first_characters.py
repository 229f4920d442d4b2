"""Patterns of many forms look at a character before they try the forms there, and find the same pieces."""

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.arrays import pieces_of
from cloakframe.operators import masking, unmask

ODD = [
    "", "plain", 'a = "x # y"  # z\n\'\'\'doc\'\'\'\n  """more\nlines""" # "open', "// x\n/* y\n*/ <!-- z --> 'c' \"d\"",
    '"""[gk_001]""" \'\'\'[gk_002]\'\'\' /* [gk_003] */ // [gk_004] <!-- [gk_005] --> # [gk_006] [gk_007] [gk_8] x[gk_0009]',
]


def same_without_look(texts, pattern):
    look, rest = pattern.split("])", 1)
    assert look.startswith("(?=[")
    rows = texts(*ODD, None).select(pieces_of(F.col("text"), pattern).alias("a"), pieces_of(F.col("text"), rest).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert any(r.a for r in rows)


@pytest.mark.parametrize("language", ["python", "cpp", "html"])
def test_comments(texts, language):
    same_without_look(texts, masking._comment_pattern(language))


def test_placeholders(texts):
    same_without_look(texts, unmask._WRAPPED)
