"""The merged runs of the normalisation against the separate steps they stand for."""
from pyspark.sql import functions as F

from finlex.functions import text as TX


def test_runs_equal_the_separate_steps(spark):
    marks = "".join(chr(c) for c in [*range(1, 0x250), 0x660, 0x966, 0x2160, 0x200B, *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0x3001, 0xB2, 0x1F600])
    d = spark.createDataFrame([(f"Ab{m} 1{m}{m}x_{m}",) for m in marks] + [("",), (None,)], "t STRING")
    for lower in (True, False):
        for punct in (True, False):
            for nums in (True, False):
                c = F.coalesce("t", F.lit(""))
                c = F.lower(c) if lower else c
                c = F.regexp_replace(c, TX.PUNCT, " ") if punct else c
                c = F.regexp_replace(c, f"{TX.DIGIT}+", " ") if nums else c
                want = F.trim(F.regexp_replace(c, f"{TX.SPACE}+", " "))
                assert d.filter(TX.normalize("t", lower, punct, nums) != want).count() == 0
    assert "regexp_replace(regexp_replace" not in str(TX.normalize("t"))  # one scan
