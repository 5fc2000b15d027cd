import pytest
from pyspark.sql import functions as F

from catalens.functions.stem import stem_text, stem_word

PAIRS = """caresses caress|ponies poni|ties tie|cats cat|agreed agre|plastered plaster|motoring motor|hopping hop|falling fall
filing file|happy happi|sky sky|relational relat|conditional condit|vietnamization vietnam|triplicate triplic
formative form|hopeful hope|goodness good|revival reviv|adjustment adjust|probate probat|rate rate|controll control
roll roll|discovered. discovered.|dying die|news news|by by|enjoy enjoy|feed feed|sized size|failing fail|bled bled
sing sing|digitizer digit|rationally ration|analogy analog|this thi|was wa|skies sky|died die|cried cri|say say
adoption adopt|replacement replac|effective effect|cease ceas|hesitanci hesit|radicalli radic|proceed proceed"""


@pytest.mark.parametrize("pair", PAIRS.replace("\n", "|").split("|"))
def test_pairs(pair):
    word, stem = pair.split(" ")
    assert stem_word(word) == stem


def test_text(spark):
    df = spark.createDataFrame([("The ponies were  hopping.\tHappy cats",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(stem_text(F.col("t"))).collect()]
    assert got == ["the poni were hopping. happi cat", None, ""]
