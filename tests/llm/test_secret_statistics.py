"""The statistics behind secret scans against plain Python: surprise under text, and false-discovery cuts."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import secret_scan


def test_text_probability(spark):
    rng = random.Random(5)
    counts = [10**9 + rng.randrange(9 * 10**9) for _ in secret_scan.BASE64]  # so many that the prior weighs nothing
    share = dict(zip(secret_scan.BASE64, (c / sum(counts) for c in counts)))
    alphabets = ["0123456789", "0123456789abcdef", "ABCDEF0123456789", secret_scan.LOWER, secret_scan.LOWER + "0123456789", secret_scan.BASE64[:62], secret_scan.BASE64]
    values = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (20, 41, 90) for _ in range(4)]

    def plain(v):
        alphabet = next(a for p, a in secret_scan.ENCODINGS if re.match(p, v))
        total = sum(share[c] for c in alphabet)
        mean = sum(share[c] / total * -math.log(share[c]) for c in alphabet)
        spread = math.sqrt(sum(share[c] / total * (math.log(share[c]) + mean) ** 2 for c in alphabet))
        surprise = sum(-math.log(share[c]) for c in v) / len(v)
        return 0.5 * math.erfc((surprise - mean) * math.sqrt(len(v)) / spread / math.sqrt(2))

    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", secret_scan.text_probability(F.col("v"), counts).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in rows] == [pytest.approx(plain(v), rel=0.005, abs=1e-9) for v in values]


@pytest.mark.parametrize("rate", [0.01, 0.1])
def test_false_discovery_cuts(spark, rate):
    """The cuts report no string that the exact procedure does not, and all that it reports at a rate one bin lower."""
    rng = random.Random(8)
    p = {b: [rng.random() for _ in range(400)] + [10 ** -rng.uniform(1, 12) for _ in range(60 * b)] for b in range(4)}
    every = [(b, x) for b in p for x in p[b]]
    rng.shuffle(every)
    runs = [([(0, 30, b, x, [(0, 25, *part)])],) for (b, x), part in zip(every[::2], every[1::2])]
    got = secret_scan.cuts(spark.createDataFrame(runs, f"runs {secret_scan._RUNS}"), rate)

    def exact(values, level):
        ordered = sorted(values)
        return max((k for k, x in enumerate(ordered, 1) if x <= k * level / len(ordered)), default=0)

    for band, cut in enumerate(got):
        reported = sum(x <= cut for x in p[band])
        assert exact(p[band], rate / 10 ** (1 / secret_scan.BIN)) <= reported <= exact(p[band], rate)
    assert got[0] < 0.01 and got[3] > 1e-6
    assert secret_scan.cuts(spark.createDataFrame([([],)], f"runs {secret_scan._RUNS}"), rate) == [0.0] * 4
