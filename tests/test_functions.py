import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequery.functions import numbers, pictures, text


def folded(s):
    plain = unicodedata.normalize("NFD", s.casefold().replace("đ", "d"))
    return "".join(c for c in plain if unicodedata.category(c) != "Mn")


def test_fold_matches_its_definition(spark):
    rng = random.Random(3)
    alphabet = "abcXYZ ÀÁẤậớĐđ ßÖäé ёЙ ไทย 日本 ガ हि 0²٣ .-_'’"
    texts = ["Bến Thành", "79H-6072", "  --  ", "", "STRASSE straße", "Ｆｕｌｌ"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [folded(t) for t in texts]


def test_tokens(spark):
    rows = spark.createDataFrame([("79H-6072",), ("Bến Thành",), ("  --  ",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.tokens(F.col("t"))).collect()] == [["79h", "6072"], ["ben", "thanh"], [], None]


def test_tidy_and_phrases(spark):
    df = spark.createDataFrame([("  Cảm  ơn\n bạn ",), ("khác",)], "t string")
    got = df.select(text.tidy(F.col("t")).alias("a"), text.contains_phrase(F.col("t"), ["cảm ơn"]).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("Cảm ơn bạn", True), ("khác", False)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, numbers.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, numbers.cosine(a, zero)) is None
    assert one(spark, numbers.unit(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, numbers.unit(zero)) == [0.0, 0.0]


def test_hamming_over_all_64_bits(spark):
    assert one(spark, numbers.hamming(F.lit("ffffffffffffffff"), F.lit("0"))) == 64
    assert one(spark, numbers.hamming(F.lit("00FF"), F.lit("00fe"))) == 1


def test_times_round_half_to_even(spark):
    null = F.lit(None).cast("long")
    assert one(spark, numbers.frame_time_ms(null, F.lit("1/12800"), F.lit(5).cast("long"), F.lit("2000"))) == 2
    assert one(spark, numbers.frame_time_ms(null, F.lit("1/12800"), F.lit(7).cast("long"), F.lit("2000"))) == 4
    assert one(spark, numbers.frame_time_ms(F.lit(146432).cast("long"), F.lit("1/12800"), F.lit(0).cast("long"), F.lit("25"))) == 11440
    assert one(spark, numbers.frame_time_ms(null, F.lit(None).cast("string"), F.lit(1001).cast("long"), F.lit("30000/1001"))) == 33400
    assert one(spark, numbers.keyframe_id(F.lit("V"), F.lit(7))) == "V_000007"


def test_picture_measures():
    flat = np.full((9, 9), 7, np.uint8)
    assert pictures.measure(flat) == {"sharpness": 0.0, "brightness": 7.0, "entropy": 0.0}
    assert pictures.measure(np.tile(np.array([0, 255], np.uint8), (8, 8)))["entropy"] == 1.0
    ramp = np.tile(np.arange(0, 90, 10, dtype=np.uint8), (8, 1))
    assert pictures.difference_hash(ramp) == "f" * 16
    assert pictures.difference_hash(ramp[:, ::-1]) == "0" * 16
    assert pictures.difference_hash(np.repeat(np.repeat(ramp, 5, 0), 3, 1)) == "f" * 16
    assert np.array_equal(pictures.shrink(ramp, 8, 9), ramp)  # nothing to resample
    assert (pictures.shrink(np.full((30, 50), 77, np.uint8), 8, 9) == 77).all()


def test_segment_times(spark):
    assert one(spark, numbers.segment_ms(F.lit(1.2345), F.lit(10))) == 1244
    assert one(spark, numbers.segment_ms(F.lit(0.5), F.lit(0.5))) == 500
