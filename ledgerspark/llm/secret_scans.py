"""Secret scans: fixed kinds by pattern, and further random-looking strings by a randomness test battery.

Each kind's matches are marked in the text, and the marked text is cut at the marks, so positions are running
sums of the pieces' lengths. Only lengths and matches leave the scan.

The battery judges maximal strings of token characters of LEAST or more that overlap no fixed match. The
string's encoding is inferred from the characters it uses. Three statistics tell it from text written in that alphabet:
* a chi-squared statistic of its symbol counts against a uniform alphabet, compared with what text would give, a
  distribution whose mean grows with the length;
* a runs test over the kinds of characters (small, capital, digit, sign): text and identifiers change kind seldom,
  random strings of narrow alphabets do so often, which parts them where symbol counts hardly differ;
* a runs test over vowels and consonants, which text alternates and random letters don't.
Their tails, as far as the alphabet has them, are joined by Fisher's method into the p-value of "this is text",
which short strings can't make small. A runs test (symbols in the upper or lower half of the alphabet) and a
lag-one serial correlation must agree with randomness, jointly at level UNIFORM by Fisher's method; else the
p-value is 1. Digits alone have only the first statistic, which has no power there: numbers are never added.
P-values of one encoding and length class are controlled together: the Benjamini-Hochberg rule at rate RATE,
over a histogram of p-values that has a fixed number of cells.

Defined results: a null text counts as empty; positions are code points, ends exclusive; repeated rows are judged each;
a text without matches has counts 0, the digest of the empty string and empty spans; other columns don't take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
#: (kind, pattern, group whose length counts, least length), in the order of ties.
KINDS = (
    ("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),  # a maximal run, so its least length can stand in the pattern
)
LEAST = 20
#: All such strings enter the battery, those of letters alone too.
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
VOWELS = "aeiouy"
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (encoding, what a string of it looks like, its alphabet), the narrowest first.
ENCODINGS = (
    ("digits", "^[0-9]+$", DIGIT),
    ("hex", "^[0-9a-f]+$", DIGIT + "abcdef"),
    ("hexupper", "^[0-9A-F]+$", DIGIT + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGIT + LOWER),
    ("base36upper", "^[0-9A-Z]+$", DIGIT + UPPER),
    ("base64", "", UPPER + LOWER + DIGIT + "+/"),
)
#: Sum of squared letter probabilities of running text.
COINCIDENCE = 0.066
#: Share of neighbouring characters of text and identifiers that differ in kind, by encoding; the others hold one kind.
KIND_CHANGES = {"hex": 0.12, "hexupper": 0.12, "base32": 0.15, "base36": 0.2, "base36upper": 0.2, "base64": 0.42}
#: Share of neighbouring letters of text of which one is a vowel and the other isn't; encodings without all letters.
VOWEL_CHANGES, NARROW = 0.6, ("digits", "hex", "hexupper")
RATE, UNIFORM = 0.001, 0.001
#: Histogram cells: tenths of -log10(p), up to a last one.
CELLS = 300


def _tail(z: Column) -> Column:
    """The normal distribution function at z, by its logistic approximation; null at null."""
    return F.when(z.isNotNull(), 1 / (1 + F.exp(F.greatest(F.lit(-600.0), F.least(F.lit(600.0), -1.5976 * z - 0.07056 * z * z * z)))))


def _fisher(tails: list[Column]) -> Column:
    """The joint tail of the tails that are not null (three at most, one at least), by the chi-squared tail of twice as many degrees."""
    x = -reduce(lambda a, b: a + b, [F.when(t.isNull(), F.lit(0.0)).otherwise(F.log(F.greatest(F.lit(1e-30), t))) for t in tails])
    n = reduce(lambda a, b: a + b, [t.isNotNull().cast("int") for t in tails])
    return F.exp(-x) * (1 + F.when(n > 1, x).otherwise(F.lit(0.0)) + F.when(n > 2, x * x / 2).otherwise(F.lit(0.0)))


def _changes(classes: Column, rate: Column) -> tuple[Column, Column]:
    """How far the changes inside runs of a string of classes, dots apart, are above what the rate gives, in deviations; their number of pairs."""
    apart = F.length(F.replace(F.regexp_replace(classes, "[^.]+", "x"), F.lit("."), F.lit("")))
    pairs = F.length(F.replace(classes, F.lit("."), F.lit(""))) - apart
    changed = F.length(F.replace(F.regexp_replace(classes, "(.)\\1+", "$1"), F.lit("."), F.lit(""))) - apart
    return changed - pairs * rate, F.when(pairs > 0, F.sqrt(pairs * rate * (1 - rate)))


def _pieces(text: Column, pattern: str) -> Column:
    """(length, match) of the parts of a text, from plain to matched in turns; null without a match."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
    shown = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("length"), F.when(i % 2 == 1, p).alias("match")))
    return F.when(F.regexp_like(text, F.lit(pattern)), shown)


def _turns(kind: str) -> Column:
    return F.transform(kind, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("turn"), p["length"].alias("length"), p["match"].alias("match")))


def _matches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, kind, start, end, match); one row with a null kind for a text without any."""
    clean = F.translate(F.coalesce(docs[f"`{text}`"], F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    named = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), clean.alias("t"))
    scans = [(kind, pattern) for kind, pattern, _, _ in KINDS] + [("random", TOKEN)]
    found = named.select("doc_id", F.monotonically_increasing_id().alias("row"), *(_pieces(F.col("t"), pattern).alias(kind) for kind, pattern in scans))
    turns = F.concat(*(F.coalesce(_turns(kind), F.array()) for kind, _ in scans))
    rows = found.select("doc_id", "row", F.explode_outer(turns).alias("p")).select("doc_id", "row", "p.*")
    before = Window.partitionBy("row", "kind").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("length").over(before)).withColumn("start", F.col("end") - F.col("length"))
    counts = [F.length(F.regexp_extract("match", pattern, group)) >= least for _, pattern, group, least in KINDS]
    counted = reduce(lambda rest, k: F.when(F.col("kind") == k[0][0], k[1]).otherwise(rest), zip(KINDS, counts), F.col("match").isNotNull())
    return placed.where(F.col("kind").isNull() | ((F.col("turn") % 2 == 1) & counted) | (F.col("turn") == 0)).withColumn("match", F.when(F.col("turn") % 2 == 1, F.col("match")))


def _of(values: dict) -> Column:
    return reduce(lambda rest, kv: F.when(F.col("encoding") == kv[0], F.lit(kv[1])).otherwise(rest), values.items(), F.lit(None))


def battery(strings: DataFrame) -> DataFrame:
    """strings (with a column match) with encoding, length_class and p, the p-value of "this is text"."""
    encoding = reduce(lambda rest, e: F.when(F.regexp_like("match", F.lit(e[1])), F.lit(e[0])).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][0]))
    alphabet = _of({e: a for e, _, a in ENCODINGS})
    named = strings.withColumn("encoding", encoding).withColumn("alphabet", alphabet)
    symbols = F.regexp_replace(F.translate("match", "-_", "+/"), "=+", "")
    named = named.withColumn("s", symbols).withColumn("n", F.length("s").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(F.pow((F.length("s") - F.length(F.replace(F.col("s"), c, F.lit("")))).cast("double"), F.lit(2.0))))
    named = named.withColumn("chi", F.try_divide(squares * F.col("k"), F.col("n")) - F.col("n"))
    bits = reduce(lambda rest, e: F.when(F.col("encoding") == e[0], F.translate("s", e[2], "".join("01"[2 * i >= len(e[2])] for i in range(len(e[2]))))).otherwise(rest), ENCODINGS, F.lit(""))
    named = named.withColumn("bits", bits)
    share = F.col("k") * COINCIDENCE - 1
    apart = F.col("n") * F.greatest(share, F.lit(0.3))
    even = _tail((F.col("chi") - (F.col("k") - 1 + apart)) / F.sqrt(2 * (F.col("k") - 1) + 4 * apart))
    kinds = F.translate("s", LOWER + UPPER + DIGIT + "+/", "a" * 26 + "A" * 26 + "0" * 10 + "++")
    off, spread = _changes(kinds, _of(KIND_CHANGES))
    mixed = _tail(-(off - 0.5) / spread)
    sounds = F.translate(F.lower("s"), "".join(c for c in LOWER if c not in VOWELS) + VOWELS + DIGIT + "+/", "c" * 20 + "v" * 6 + "." * 12)
    off, spread = _changes(sounds, F.lit(VOWEL_CHANGES))
    spoken = F.when(~F.col("encoding").isin(*NARROW), _tail((off + 0.5) / spread))
    text_like = _fisher([even, mixed, spoken])
    ones = F.length(F.replace(F.col("bits"), F.lit("0"), F.lit(""))).cast("double")
    zeros = F.col("n") - ones
    turns = 1 + (2 * F.col("n") - F.length(F.replace(F.col("bits"), F.lit("01"), F.lit(""))) - F.length(F.replace(F.col("bits"), F.lit("10"), F.lit("")))) / 2
    expected = 2 * ones * zeros / F.col("n") + 1
    spread = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    runs = F.when(spread > 0, (turns - expected) / F.sqrt(spread)).otherwise(F.lit(99.0))
    values = F.transform(F.filter(F.split("s", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    named = named.withColumn("v", F.transform(values, lambda x: x - (F.col("k") + 1) / 2))
    lagged = F.aggregate(F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v")), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    power = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    serial = F.coalesce(F.try_divide(lagged, power), F.lit(1.0)) * F.sqrt("n")
    named = named.where("n >= 2").withColumn("runs", runs).withColumn("serial", serial).withColumn("text_like", text_like)
    # the chi-squared tail with four degrees of freedom has a closed form
    half = -(F.log(F.greatest(F.lit(1e-12), 2 * _tail(-F.abs("runs")))) + F.log(F.greatest(F.lit(1e-12), 2 * _tail(-F.abs("serial")))))
    joint = F.exp(-half) * (1 + half)
    p = F.when(joint >= UNIFORM, F.greatest(F.col("text_like"), F.lit(10.0 ** (-CELLS / 10)))).otherwise(F.lit(1.0))
    return named.withColumn("p", p).withColumn("length_class", F.floor(F.log2("n")).cast("int")).drop("alphabet", "s", "k", "chi", "bits", "v", "runs", "serial", "text_like", "n")


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, length_class, least_cell): histogram cells from which on a string is a discovery."""
    cell = F.floor(-F.log10("p") * 10).cast("int")
    counted = tested.groupBy("encoding", "length_class", cell.alias("cell")).agg(F.count("*").alias("n"))
    strata = Window.partitionBy("encoding", "length_class")
    down = strata.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(strata))
    # the largest p of a cell is its upper edge, 10 ** (-cell / 10)
    passing = F.pow(F.lit(10.0), -F.col("cell") / 10) <= F.lit(rate) * F.col("rank") / F.col("m")
    return ranked.where(passing).groupBy("encoding", "length_class").agg(F.min("cell").alias("least_cell"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id and found, its sorted spans as structs (start, place, kind, end, match)."""
    place = reduce(lambda rest, k: F.when(F.col("kind") == k[1], F.lit(k[0])).otherwise(rest), enumerate([k[0] for k in KINDS]), F.lit(len(KINDS)))
    rows = materialize(_matches(docs, doc_id, text).withColumn("place", place), "matches")
    fixed = F.col("kind").isNotNull() & (F.col("kind") != "random") & F.col("match").isNotNull()
    by_start = Window.partitionBy("row").orderBy("start", "place")
    up_to, onwards = by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ended, opens = F.max(F.when(fixed, F.col("end"))).over(up_to), F.min(F.when(fixed, F.col("start"))).over(onwards)
    beside = rows.withColumn("ended", ended).withColumn("opens", opens)
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("opens").isNull() | (F.col("opens") >= F.col("end")))
    tested = materialize(battery(beside.where((F.col("kind") == "random") & F.col("match").isNotNull() & free).select("row", "doc_id", "kind", "place", "start", "end", "match")), "tested")
    limits = materialize(discoveries(tested), "limits")
    cell = F.floor(-F.log10("p") * 10).cast("int")
    random = tested.join(limits, ["encoding", "length_class"]).where(cell >= F.col("least_cell")).select("row", "doc_id", "kind", "place", "start", "end", "match")
    kept = rows.where("kind IS NULL OR kind <> 'random' OR turn = 0").select("row", "doc_id", "kind", "place", "start", "end", "match")
    spans = kept.unionByName(random).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("match").isNotNull(), F.struct("start", "place", "kind", "end", "match")))).alias("found"))
    return spans.select("doc_id", "found")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    fixed = F.filter("found", lambda s: s["kind"] != "random")
    counts = [_count(kind).alias(f"n_{kind}") for kind, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(fixed), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
