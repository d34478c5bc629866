"""Secret scan, in DataFrame operations alone: patterns, and a battery of randomness tests.

Pattern spans ("assign", "access", "hex") are leftmost and do not overlap within a kind. The battery adds
spans of kind "random": runs of 20 or more characters that encodings use, outside pattern spans. For each run
the narrowest encoding is inferred (hex, base32, base36, base64, base64url, or their union) and three tests ask
whether its characters are uniform draws of that alphabet:

* chi-squared over the alphabet's counts (upper tail, by the cube-root approximation),
* runs of its lower and upper half (two-sided),
* serial correlation of neighbours (two-sided).

Their least p-value, corrected for three tests, is ranked among those of random strings of the same alphabet
size and length (the tests are discrete: by themselves short runs are not uniform). That rank is uniform in (0, 1) for random
strings, ties being dealt out by a hash of the run; words and identifiers crowd near zero. False discoveries are controlled by
length: within each class of length, the random strings are estimated from the upper half of the ranks, and the
threshold is the least at which no more than `fdr` of all that passes is estimated to be something else (step-up: a
noisy bin further up doesn't matter). Short runs, where the tests have less power, thus need a higher rank than long
ones. A class of fewer than FEW runs takes the threshold of all classes together; where these are fewer too, a run counts unless the tests
reject it at `fdr`, as nothing can be estimated. The histogram behind it covers every run of the corpus and has at most
classes x bins rows, whatever the corpus.

Positions are code points, ends exclusive. They come from the lengths between and inside matches, summed per document by
windows, so a text with any number of matches takes linear time. Null texts are empty; repeated rows keep a row
each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents, staged, table

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base scan. Lengths that belong to a maximal run are part of the pattern;
#: that of an assigned value is checked after the match, as a match too short still uses up its text.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
ASSIGNED = 6

CLASSES = (20, 24, 28, 32, 40, 48, 64, 96, 128)
BINS = 100
FDR = 0.05
#: Runs below which a class of length has no threshold of its own.
FEW = 100
#: Lengths whose random strings are drawn to rank p-values; other lengths use the next below. Draws of each.
DRAWN = (*range(20, 65), 72, 80, 96, 112, 128, 192, 256, 384)
DRAWS = 3000

_HEX, _LOWER, _UPPER = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, narrowest first: what their strings match, and their alphabets in order.
ENCODINGS = (
    ("^[0-9a-f]+$", _HEX),
    ("^[0-9A-F]+$", _HEX.upper()),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[a-z0-9]+$", _LOWER + "0123456789"),
    ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + "0123456789+/"),
    ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + "0123456789-_"),
    (".", _UPPER + _LOWER + "0123456789+/-_"),
)


def _matches(kind: int, pattern: str, passes: Column | None = None, keep: bool = False) -> Column:
    """Of each match: kind, number, characters since the match before, its length, whether it counts."""
    found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    passing = passes if passes is not None else F.transform(found, lambda m: F.lit(True))
    listed = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), passing.alias("p")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("length"),
            x["p"].alias("counts"), (x["m"] if keep else F.lit(None).cast("string")).alias("run"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,number:int,gap:int,length:int,counts:boolean,run:string>>")
    return F.when(F.col("text").rlike(pattern), listed).otherwise(none)


def _normal(z: str) -> str:
    """The standard normal distribution's upper tail, to about 1e-4."""
    return f"1 / (1 + exp(least(1.5976 * ({z}) + 0.07056 * power({z}, 3), 700)))"


def _normal_of(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(1.5976 * z + 0.07056 * z**3, 700)))


def _drawn(letters: int, n: int, random: np.random.Generator) -> np.ndarray:
    """p, as `tested` gives it, of DRAWS random strings."""
    x = random.integers(0, letters, (DRAWS, n))
    counts = np.bincount((x + letters * np.arange(DRAWS)[:, None]).ravel(), minlength=DRAWS * letters).reshape(DRAWS, letters)
    chi = np.maximum(letters / n * (counts**2).sum(axis=1) - n, 0)
    z1 = (np.cbrt(chi / (letters - 1)) - (1 - 2 / (9 * (letters - 1)))) / np.sqrt(2 / (9 * (letters - 1)))
    high = x >= letters / 2
    runs, two = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1), 2.0 * high.sum(axis=1) * (~high).sum(axis=1)
    few = two <= n
    z2 = np.where(few, 9, (runs - (two / n + 1)) / np.sqrt(np.where(few, 1, two * (two - n)) / (n * n * (n - 1))))
    y = x - x.mean(axis=1, keepdims=True)
    var, cov = (y * y).sum(axis=1), (y[:, 1:] * y[:, :-1]).sum(axis=1)
    z3 = np.where(var <= 0, 9, (cov / np.where(var <= 0, 1, var) + 1 / n) * np.sqrt(n))
    least = np.minimum(_normal_of(z1), 2 * np.minimum(_normal_of(np.abs(z2)), _normal_of(np.abs(z3))))
    return 1 - (1 - np.minimum(least, 1)) ** 3


@lru_cache(maxsize=1)
def _ranks() -> list[tuple[int, int, list[float]]]:
    """Letters, length, the BINS - 1 quantiles of p between bins: the same at each call."""
    random = np.random.default_rng(20)
    at = np.arange(1, BINS) * DRAWS // BINS
    return [(k, n, np.sort(_drawn(k, n, random))[at].round(9).tolist()) for k in sorted({len(a) for _, a in ENCODINGS}) for n in DRAWN]


def ranked(rows: DataFrame) -> DataFrame:
    """rows with bin: the rank of p among random strings of as many letters and the same length."""
    table_ = F.broadcast(rows.sparkSession.createDataFrame(_ranks(), "letters int, drawn int, ranks array<double>"))
    longer = ", ".join(str(n) for n in DRAWN if n >= 64)
    drawn = F.expr(f"IF(length <= 64, length, try_element_at(filter(array({longer}), d -> d <= length), -1))")
    rows = rows.withColumn("drawn", drawn).join(table_, ["letters", "drawn"], "left").withColumn("__p", F.round("p", 9))
    below, until = "size(filter(ranks, r -> r < __p))", "size(filter(ranks, r -> r <= __p))"
    dealt = f"{below} + cast(floor(pmod(xxhash64(run), 1000) / 1000D * ({until} - {below} + 1)) AS int)"
    return rows.withColumn("bin", F.expr(f"IF(p IS NULL OR ranks IS NULL, NULL, {dealt})")).drop("ranks", "drawn", "letters", "__p")


def tested(rows: DataFrame, run: str = "run") -> DataFrame:
    """rows with p, how well a run passes for uniform draws, and the letters of its alphabet; null where `run` is."""
    alphabet = F.lit(None).cast("string")
    for matches, letters in reversed(ENCODINGS):
        alphabet = F.when(F.col(run).rlike(matches), F.lit(letters)).otherwise(alphabet)
    rows = rows.withColumn("__a", alphabet).withColumn("__k", F.length("__a").cast("double")).withColumn("__n", F.length(run).cast("double"))
    rows = rows.withColumn("__x", F.expr(f"transform(split({run}, ''), c -> cast(instr(__a, c) - 1 AS double))"))
    squares = f"aggregate(split(__a, ''), 0D, (s, a) -> s + power(length({run}) - length(replace({run}, a, '')), 2))"
    rows = rows.withColumn("__chi", F.expr(f"greatest(__k / __n * {squares} - __n, 0D)"))
    rows = rows.withColumn("__z1", F.expr("(power(__chi / (__k - 1), 1/3D) - (1 - 2 / (9 * (__k - 1)))) / sqrt(2 / (9 * (__k - 1)))"))
    rows = rows.withColumn("__hi", F.expr("cast(size(filter(__x, x -> x >= __k / 2)) AS double)"))
    rows = rows.withColumn("__runs", F.expr("1D + size(filter(zip_with(slice(__x, 1, size(__x) - 1), slice(__x, 2, size(__x)), (x, y) -> (x >= __k / 2) <> (y >= __k / 2)), d -> d))"))
    rows = rows.withColumn("__two", F.expr("2 * __hi * (__n - __hi)"))
    rows = rows.withColumn("__z2", F.expr("IF(__two <= __n, 9D, (__runs - (__two / __n + 1)) / sqrt(__two * (__two - __n) / (__n * __n * (__n - 1))))"))
    rows = rows.withColumn("__mean", F.expr("aggregate(__x, 0D, (s, x) -> s + x) / __n"))
    rows = rows.withColumn("__var", F.expr("aggregate(__x, 0D, (s, x) -> s + power(x - __mean, 2))"))
    rows = rows.withColumn("__cov", F.expr("aggregate(zip_with(slice(__x, 1, size(__x) - 1), slice(__x, 2, size(__x)), (x, y) -> (x - __mean) * (y - __mean)), 0D, (s, x) -> s + x)"))
    rows = rows.withColumn("__z3", F.expr("IF(__var <= 0, 9D, (__cov / __var + 1 / __n) * sqrt(__n))"))
    least = f"least({_normal('__z1')}, 2 * {_normal('abs(__z2)')}, 2 * {_normal('abs(__z3)')})"
    scratch = ("__a", "__k", "__n", "__x", "__chi", "__z1", "__hi", "__runs", "__two", "__z2", "__mean", "__var", "__cov", "__z3")
    return rows.withColumn("p", F.expr(f"1 - power(1 - least({least}, 1D), 3)")).withColumn("letters", F.length("__a")).drop(*scratch)


def spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, counts, class, bin, free: a row for each match, and one of nulls for texts without.

    free: a run that no pattern span touches.
    """
    rows = documents(docs).withColumn("row", F.monotonically_increasing_id())
    values = F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGNED)
    matches = F.concat(_matches(0, ASSIGN, values), _matches(1, ACCESS), _matches(2, HEX), _matches(3, RUN, keep=True))
    each = rows.select("row", "doc_id", F.explode_outer(matches).alias("m")).select("row", "doc_id", "m.*")
    each = ranked(tested(each)).withColumn("class", F.expr(f"size(filter(array({', '.join(map(str, CLASSES))}), c -> c <= length))")).drop("run")
    of_kind = Window.partitionBy("row", "kind").orderBy("number")
    until, before = of_kind.rowsBetween(Window.unboundedPreceding, 0), of_kind.rowsBetween(Window.unboundedPreceding, -1)
    placed = each.repartition("row").withColumn("start", (F.sum("gap").over(until) + F.coalesce(F.sum("length").over(before), F.lit(0)))).withColumn("end", F.col("start") + F.col("length"))
    base = (F.col("kind") < 3) & F.col("counts")
    # Both frames only grow: what follows a run is summed from the text's end.
    whole = Window.partitionBy("row")
    earlier, later = (whole.orderBy(by).rangeBetween(Window.unboundedPreceding, 0) for by in (F.asc("start"), F.desc("start")))
    touched = (F.max(F.when(base, F.col("end"))).over(earlier) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(later) < F.col("end"))
    placed = placed.withColumn("free", (F.col("kind") == 3) & ~F.coalesce(touched, F.lit(False)))
    return placed.select("row", "doc_id", "kind", "start", "end", "counts", "class", "bin", "free")


def thresholds(found: DataFrame, fdr: float = FDR) -> DataFrame:
    """class, least_bin: for each class of length, the least bin at which all that passes keeps the rate; null: none does."""
    own = found.where("free").groupBy("class", "bin").agg(F.count("*").alias("n"))
    # Class 0 is all runs.
    counted = own.unionByName(own.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(0).alias("class"), "bin", "n"))
    up, whole = Window.partitionBy("class").orderBy("bin"), Window.partitionBy("class")
    down = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    random = 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(whole)
    # Bins that no run has pass what the next above passes: the first of them stands for all. Bin 0 is where nothing but the tests' failures lies.
    edge = F.greatest(F.coalesce(F.lag("bin").over(up) + 1, F.lit(1)), F.lit(1))
    rated = counted.withColumn("passing", F.sum("n").over(down)).withColumn("rate", 1 - random * (1 - edge / BINS) / F.col("passing"))
    least = F.min(F.when((F.col("rate") <= fdr) & (F.col("bin") > 0), F.col("bin")))
    judged = rated.groupBy("class").agg(F.sum("n").alias("runs"), least.alias("least"))
    together = judged.where(F.col("class") == 0).select(F.col("runs").alias("all_runs"), F.col("least").alias("all_least"))
    chosen = F.when(F.col("runs") >= FEW, F.col("least")).when(F.col("all_runs") >= FEW, F.col("all_least")).otherwise(F.lit(max(1, round(fdr * BINS))))
    return judged.where(F.col("class") > 0).crossJoin(F.broadcast(together)).select("class", chosen.alias("least_bin"))


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: a row for each document."""
    found = staged(spans(docs), "secret-spans")
    # At most one row for each class: the side has a fixed bound.
    judged = found.join(F.broadcast(thresholds(found, fdr)), "class", "left")
    chosen = F.when(F.col("kind") < 3, F.col("counts")).otherwise(F.col("free") & (F.col("bin") >= F.col("least_bin")))
    span = F.when(F.coalesce(chosen, F.lit(False)), F.struct("start", "kind", "end"))
    per_row = judged.withColumn("span", span).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("all"))

    def text(which: str) -> Column:
        names = ", ".join(f"'{k}'" for k in KINDS)
        return F.expr(f"array_join(transform(filter(`all`, s -> {which}), s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')")

    count = lambda k: F.expr(f"cast(size(filter(`all`, s -> s.kind = {k})) AS bigint)")
    return per_row.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text("s.kind < 3").cast("binary"), 256).alias("base_sha256"), text("true").alias("spans"), count(3).alias("n_random"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
