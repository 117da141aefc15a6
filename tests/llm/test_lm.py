"""Names of n-grams: words that share 40 bits stay apart, and names travel whole."""

import numpy as np

from digestlake.llm import lm
from digestlake.llm.words import SHINGLE_BYTES, Words, mix
from tests.llm.test_llm import brute_lm


def test_lm_scores_of_words_whose_names_share_40_bits(spark):
    a, b = "w915831", "w493405"
    single = mix(Words([f"{a} {b}".encode()], SHINGLE_BYTES).name ^ lm.SINGLE)
    assert single[0] >> np.uint64(24) == single[1] >> np.uint64(24) and single[0] != single[1]
    rows = [(1, f"{a} q"), (2, f"{b} q r"), (3, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r[0], r[1], round(r[2], 6)) for r in lm.lm_scores(df).collect()), key=repr) == brute_lm(rows)


def test_lm_names_travel_whole():
    rng = np.random.default_rng(1)
    for names in (np.unique(rng.integers(0, 2**64, 50_000, np.uint64)), np.array([7], np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        assert (lm.widen(lm.narrow(names)) == names).all()
