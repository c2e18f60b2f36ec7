"""Secret scans with regular expressions and a randomness test battery.

All work is done row by row in SQL functions, without shuffling any text; the
only things gathered are the number of times each of 64 symbols occurs and a
histogram of test results (length band x bin), whose sizes do not depend on the
data.

*Base rules* find assignments, access keys and hexadecimal runs.  The *battery*
looks at every run of 20 or more token characters outside their spans, and at
the parts of 20 or more letters and digits between the separators of a longer
run, so that a key behind a path is judged by itself.  The encoding is inferred
from the characters (decimal, hexadecimal, base 32, one case, base 36, base 62
or base 64).  Two questions are asked:

* Could it be uniformly random?  A two-sided chi-squared test of even symbols,
  a runs test and a lag-1 serial correlation; they depend on each other, so the
  least of the three probabilities counts three times (Bonferroni).  A string
  refused at ``LEVEL`` is out; of random ones that share is lost.
* Could it be ordinary text?  The mean surprisal of its symbols under the
  frequencies of the whole corpus has a known mean and spread for text; the
  probability of one as large is what false discoveries are counted by.

Within each length band (longer strings carry more evidence, so each band has
its own cut) the Benjamini-Hochberg procedure over all strings of the corpus
decides which are *not* text; these are reported as kind ``random``, and at
most ``FALSE_DISCOVERY_RATE`` of what is reported is expected to be text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import documents, table

# Patterns of the base rules, in the order of kinds.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
RUN, PART = r"[A-Za-z0-9+/_=-]{20,}+", r"[A-Za-z0-9]{20,}+"
# Encodings, the first that fits counts: pattern, alphabet.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE64 = UPPER + LOWER + DIGITS + "+/"
ENCODINGS = (
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+=*$", UPPER + "234567"),
    ("^[a-z0-9]+$", LOWER + DIGITS),
    ("^[A-Z0-9]+$", UPPER + DIGITS),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("", BASE64),
)
# Letters by frequency in English text, and how often each of them comes in a hundred thousand.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
FREQUENCIES = (12700, 9060, 8170, 7510, 6970, 6750, 6330, 6090, 5990, 4250, 4030, 2780, 2760, 2410, 2360, 2230, 2020, 1970, 1930, 1490, 980, 770, 150, 150, 100, 70)
#: Symbols that are counted as seen before the corpus: lower case like English, upper case and digits in these shares.
PRIOR_SYMBOLS, PRIOR_UPPER, PRIOR_DIGITS, PRIOR_SIGNS = 10_000, 0.04, 0.03, 0.002
BANDS = (20, 28, 40, 64)
#: Share of random strings that the battery may refuse.
LEVEL = 0.01
#: Share of text among the strings that are reported.
FALSE_DISCOVERY_RATE = 0.01
BIN = 20  # bins per power of ten
_BLOCK = 256


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(steps: Column) -> Column:
    """Running sums of an array, by blocks, so that no array is summed from its start for each element."""

    def from_blocks(blocks: Column) -> Column:
        bases = _let(F.transform(blocks, _total), lambda totals: F.transform(totals, lambda t, b: _total(F.slice(totals, F.lit(1), b))))
        return F.flatten(F.zip_with(blocks, bases, lambda xs, base: F.transform(xs, lambda x, i: base + _total(F.slice(xs, F.lit(1), i + 1)))))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.slice(xs, b * F.lit(_BLOCK) + 1, F.lit(_BLOCK)))
    return _let(steps, lambda xs: _let(cut(xs), from_blocks))


_SPANS = "array<struct<start:bigint,kind_ord:int,kind:string,end:bigint,value:string>>"


def _spans(text: Column, kind_ord: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one pattern as spans in code points; those with a shorter ``group`` go."""

    def located(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        lengths = F.transform(found, lambda x: F.length(x).cast("long"))
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x).cast("long"))
        ends = _running(F.zip_with(gaps, lengths, lambda g, n: g + n))
        return F.transform(
            F.arrays_zip(ends.alias("e"), lengths.alias("n"), values.alias("v")),
            lambda x: F.struct((x["e"] - x["n"]).alias("start"), F.lit(kind_ord).alias("kind_ord"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["v"].alias("value")),
        )

    rows = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    kept = F.filter(rows, lambda x: F.length(x["value"]) >= least)
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[_spans(text, i, *k) for i, k in enumerate(KINDS)]))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with the characters under ``spans`` (by start, may overlap) as spaces."""
    upto = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s["end"])), F.lit(0).cast("long"))
    parts = F.transform(
        spans,
        lambda s, i: _let(F.struct(upto(i).alias("a"), F.greatest(upto(i), s["start"]).alias("b"), F.greatest(upto(i), s["end"]).alias("c")), lambda e: F.concat(F.substring(text, (e["a"] + 1).cast("int"), (e["b"] - e["a"]).cast("int")), F.repeat(F.lit(" "), (e["c"] - e["b"]).cast("int")))),
    )
    rest = _let(upto(F.size(spans)), lambda e: F.substring(text, (e + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to 0.3 % however far out."""
    far = lambda a: F.exp(-a * a / 2) / (((1 - 0.339) * a + 0.339 * F.sqrt(a * a + 5.510)) * math.sqrt(2 * math.pi))
    return F.when(z >= 0, far(z)).otherwise(1 - far(-z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), _upper_tail(F.abs(z)) * 2)


def _tests(size: Column, codes: Column) -> Column:
    """Probabilities of the three tests for codes 0 to ``size`` - 1 under uniform random symbols."""
    n, k = F.size(codes).cast("double"), size.cast("double")
    pairs = lambda xs: F.arrays_zip(F.slice(xs, F.lit(1), F.size(xs) - 1).alias("a"), F.slice(xs, F.lit(2), F.size(xs) - 1).alias("b"))
    squares = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(codes, lambda c: c == s)).cast("double"), F.lit(2.0)))

    def uniform(chi2: Column) -> Column:
        df = k - 1
        return _two_sided((F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (df * 9))) / F.sqrt(2 / (df * 9)))

    def runs(high: Column) -> Column:
        n1 = F.size(F.filter(high, lambda h: h)).cast("double")
        seen = F.size(F.filter(pairs(high), lambda p: p["a"] != p["b"])).cast("double") + 1
        spread = lambda cross: F.sqrt(F.greatest(F.lit(1e-9), cross * (cross - n) / (n * n * (n - 1))))
        one_sided = F.pow(F.lit(2.0), 1 - n)  # the chance of all symbols on one side
        return _let(n1 * (n - n1) * 2, lambda cross: F.when(cross > n, _two_sided((seen - (cross / n + 1)) / spread(cross))).otherwise(one_sided))

    def serial(centred: Column) -> Column:
        power = F.aggregate(centred, F.lit(0.0), lambda a, c: a + c * c)
        lag = F.aggregate(pairs(centred), F.lit(0.0), lambda a, p: a + p["a"] * p["b"])
        same = F.pow(k, 1 - n)  # the chance of one symbol throughout
        return _let(power, lambda w: F.when(w > 0, _two_sided((lag / w + 1 / n) * F.sqrt(n))).otherwise(same))

    return F.array(
        _let(squares * k / n - n, uniform),
        _let(F.transform(codes, lambda c: c >= k / 2), runs),
        _let(_let(F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n, lambda mean: F.transform(codes, lambda c: c - mean)), serial),
    )


def _plain(value: Column) -> Column:
    return F.translate(F.rtrim(value, F.lit("=")), "-_", "+/")


def _encoding(value: Column) -> Column:
    """Place of the encoding in ``ENCODINGS``."""
    return F.coalesce(*[F.when(F.rlike(value, F.lit(p)), F.lit(i)) for i, (p, _) in enumerate(ENCODINGS[:-1])], F.lit(len(ENCODINGS) - 1))


def _codes(value: Column, alphabet: Column) -> Column:
    """Places of the symbols in ``alphabet``; other characters are left out."""
    return F.filter(F.transform(F.split(_plain(value), ""), lambda c: F.position(c, alphabet).cast("double") - 1), lambda c: c >= 0)


def battery(value: Column) -> Column:
    """Probability of the three tests together if ``value`` is uniformly random."""

    def judged(alphabet: Column) -> Column:
        return _let(_codes(value, alphabet), lambda codes: F.when(F.size(codes) > 1, F.least(F.lit(1.0), F.array_min(_tests(F.length(alphabet), codes)) * 3)).otherwise(F.lit(0.0)))

    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    return _let(F.element_at(alphabets, _encoding(value) + 1), judged)


def symbol_counts(docs: DataFrame) -> list[int]:
    """How often each symbol of ``BASE64`` occurs in all texts; one row reaches the driver."""
    text = F.col("text")
    n = [F.sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).cast("long")).alias(f"n{i}") for i, c in enumerate(BASE64)]
    return [x or 0 for x in documents(docs).agg(*n).first()]


def _text_model(counts: list[int]) -> tuple[list[float], list[tuple[float, float]]]:
    """(surprisal of each symbol, mean and variance of it in text of each encoding), from counts on top of the prior."""
    share = dict(zip(LETTERS, (f / sum(FREQUENCIES) for f in FREQUENCIES)))
    prior = {c: s * (1 - PRIOR_UPPER - PRIOR_DIGITS - PRIOR_SIGNS) for c, s in share.items()} | {c.upper(): s * PRIOR_UPPER for c, s in share.items()} | {d: PRIOR_DIGITS / 10 for d in DIGITS} | {x: PRIOR_SIGNS / 2 for x in "+/"}
    seen = [n + PRIOR_SYMBOLS * prior[c] for n, c in zip(counts, BASE64)]
    p = dict(zip(BASE64, (n / sum(seen) for n in seen)))
    moments = []
    for _, alphabet in ENCODINGS:
        total = sum(p[c] for c in alphabet)
        mean = sum(p[c] / total * -math.log(p[c]) for c in alphabet)
        moments.append((mean, sum(p[c] / total * (math.log(p[c]) + mean) ** 2 for c in alphabet)))
    return [-math.log(p[c]) for c in BASE64], moments


def text_probability(value: Column, counts: list[int]) -> Column:
    """Probability that text of the corpus in the encoding of ``value`` has symbols as surprising as its."""
    surprisal, moments = _text_model(counts)
    held = F.array(*[F.lit(x) for x in surprisal])
    table_ = F.array(*[F.struct(F.lit(m).alias("mean"), F.lit(math.sqrt(v)).alias("spread")) for m, v in moments])

    def judged(places: Column) -> Column:
        n = F.size(places).cast("double")
        total = F.aggregate(places, F.lit(0.0), lambda a, c: a + F.element_at(held, c.cast("int") + 1))
        return _let(F.element_at(table_, _encoding(value) + 1), lambda m: F.when(m["spread"] > 0, _upper_tail((total / n - m["mean"]) * F.sqrt(n) / m["spread"])).otherwise(F.lit(1.0)))

    return _let(_codes(value, F.lit(BASE64)), judged)


def _band(length: Column) -> Column:
    return sum((F.when(length >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))


_TESTED = "array<struct<start:bigint,end:bigint,band:int,p:double>>"
_RUNS = f"array<struct<start:bigint,end:bigint,band:int,p:double,parts:{_TESTED}>>"


def candidates(text: Column, base: Column, counts: list[int], level: float = LEVEL) -> Column:
    """Runs outside the base spans with band and p, and the same for the ``parts`` between their separators.

    p is that of :func:`text_probability`, and 1 for strings that the battery refuses.
    """

    def tested(s: Column, shift: Column) -> list[Column]:
        value = s["value"]
        p = F.when(battery(value) < level, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(1e-30), text_probability(value, counts))))
        return [(s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"), _band(F.length(value)).alias("band"), p.alias("p")]

    zero = F.lit(0).cast("long")
    inner = lambda r: F.filter(_spans(r["value"], 0, "part", PART, 0, BANDS[0]), lambda q: q["end"] - q["start"] < r["end"] - r["start"])
    parts = lambda r: F.transform(inner(r), lambda q: F.struct(*tested(q, r["start"])))
    runs = F.transform(_spans(_masked(text, base), len(KINDS), "random", RUN, 0, BANDS[0]), lambda r: F.struct(*tested(r, zero), parts(r).alias("parts")))
    return F.when(F.rlike(text, F.lit(RUN)), runs).otherwise(F.array().cast(_RUNS)).cast(_RUNS)


def cuts(runs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> list[float]:
    """Per length band the probability up to which a string counts as no text, from all ``runs`` (column runs of candidates).

    Benjamini-Hochberg over a histogram of -log10(p); a bin counts with its
    largest probability.  At most ``len(BANDS)`` rows reach the driver.
    """
    from pyspark.sql import Window as W

    every = F.explode(F.concat(F.transform("runs", lambda r: F.struct(r["band"].alias("band"), r["p"].alias("p"))), F.flatten(F.transform("runs", lambda r: F.transform(r["parts"], lambda q: F.struct(q["band"].alias("band"), q["p"].alias("p")))))))
    bins = runs.where(F.size("runs") > 0).select(every.alias("r")).select("r.band", F.floor(-F.log10(F.col("r.p")) * BIN).cast("int").alias("bin"))
    hist = bins.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    k = F.sum("n").over(W.partitionBy("band").orderBy(F.desc("bin")))
    m = F.sum("n").over(W.partitionBy("band"))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BIN)
    rows = hist.select("band", edge.alias("edge"), (edge <= k * rate / m).alias("found")).where("found").groupBy("band").agg(F.max("edge").alias("cut")).collect()
    found = {r["band"]: r["cut"] for r in rows}
    return [found.get(b, 0.0) for b in range(len(BANDS))]


def random_spans(runs: Column, cut: list[float]) -> Column:
    """Spans of the runs up to the cut of their band, else of their parts up to theirs."""
    level = F.array(*[F.lit(float(c) * (1 + 1e-9)) for c in cut])
    low = lambda r: r["p"] <= F.element_at(level, r["band"] + 1)
    span = lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS)).alias("kind_ord"), F.lit("random").alias("kind"), r["end"].alias("end"), F.lit("").alias("value"))
    return F.flatten(F.transform(runs, lambda r: F.when(low(r), F.array(span(r))).otherwise(F.transform(F.filter(r["parts"], low), span)))).cast(_SPANS)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base, runs: base spans and tested runs of each row, stored once."""
    text = F.col("text")
    rows = documents(docs)
    counts = symbol_counts(rows)
    return table(rows.select("doc_id", text, base_spans(text).alias("base")).select("doc_id", "base", candidates(text, F.col("base"), counts).alias("runs")), "secret-runs")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per input row.

    Null text is empty and has no spans (base_sha256 of the empty string).
    Offsets are code points, the end is exclusive.  Repeated rows are judged
    row by row.  Only doc_id and text are read, whatever else the table has;
    an empty table gives no rows.
    """
    found = scanned(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_sort(F.concat("base", random_spans(F.col("runs"), cuts(found, rate))))
    return found.select("doc_id", *[count(k[0]) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """``docs`` with every span's characters replaced by ``mark``.

    Overlapping spans are merged.  Null texts stay null, texts without spans
    stay as they are; columns keep their names and order.  Repeated rows and
    rows without a doc_id are treated row by row; an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = symbol_counts(docs)
    own = [f"__{name}_{uuid.uuid4().hex}" for name in ("base", "spans", "merged")]  # no column of docs has these names
    base = base_spans(text)
    found = docs.withColumn(own[0], base)
    hits = docs.select(text.alias("text")).where(F.rlike("text", F.lit(RUN)))
    cut = cuts(table(hits.select("text", base_spans(F.col("text")).alias("base")).select(candidates(F.col("text"), F.col("base"), counts).alias("runs")), "secret-runs"), rate)
    found = found.withColumn(own[1], F.array_sort(F.concat(own[0], random_spans(candidates(text, F.col(own[0]), counts), cut))))
    merged = F.aggregate(
        F.col(own[1]),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        ),
    )
    found = found.withColumn(own[2], merged)
    kept_from = F.concat(F.array(F.lit(0).cast("long")), F.transform(own[2], lambda s: s["end"]))
    kept_to = F.concat(F.transform(own[2], lambda s: s["start"]), F.array(F.length("text").cast("long")))
    pieces = F.zip_with(kept_from, kept_to, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    redacted = F.when(F.size(own[2]) > 0, F.array_join(pieces, mark)).otherwise(F.col("text"))
    return found.withColumn("text", redacted).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
