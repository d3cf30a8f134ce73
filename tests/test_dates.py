import pytest
from pyspark.sql import functions as F

from caseloom.functions.dates import days, first_range


@pytest.mark.parametrize("text, want", [
    ("2025年7月3日至5日", [(2025, 7, 3, True, False), (2025, 7, 5, True, True)]),
    ("2025-7-3至2025-07-05", [(2025, 7, 3, False, False), (2025, 7, 5, False, True)]),
    ("7月28-8月3日", [(None, 7, 28, False, False), (None, 8, 3, True, True)]),
    ("14日08时，2024年12月3号", [(None, None, 14, True, False), (2024, 12, 3, True, False)]),
    ("2024年12月30日到2025年1月2日", [(2024, 12, 30, True, False), (2025, 1, 2, True, True)]),
    ("无", []), (None, []), ("99999999999999日", [(None, None, None, True, False)]),
])
def test_days(spark, text, want):
    found = spark.range(1).select(days(F.lit(text).cast("string")).alias("x"), first_range(days(F.lit(text).cast("string"))).alias("r")).first()
    assert [tuple(d) for d in found.x] == want
    assert (found.r is not None) == any(w[4] for w in want)
