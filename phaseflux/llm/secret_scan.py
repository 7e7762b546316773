"""Secrets in whole texts: fixed patterns, and strings that a battery of randomness tests can't tell from random ones.

Only DataFrame functions. Positions come from the lengths of what lies between matches (code points). A candidate is a
run of token characters; the narrowest encoding that fits it gives its alphabet, and three tests are made against uniform
random symbols of it: chi-squared of the symbols' counts, runs above and below the alphabet's middle, serial correlation. What any
of them rejects is not random. For the rest, the false-discovery control asks how likely ordinary text of that length were to
look so: by the collisions among its symbols and by its changes between kinds of characters, both against the rates of shorter
tokens of the same corpus. Benjamini-Hochberg thresholds are set within each encoding and class of lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, held

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The kinds of spans in order, with the patterns of the fixed ones. Runs are greedy, so a least length within the pattern finds what one after the match would leave.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = (ASSIGN, "AKIA[A-Z0-9]{16,}", "(?<![0-9a-f])[0-9a-f]{24,}")
VALUE = 6
#: Tokens of the least length on are read; those below the length of a candidate tell what is ordinary.
ORDINARY, CANDIDATE = 12, 20
TOKEN = f"[A-Za-z0-9+/_-]{{{ORDINARY},}}={{0,2}}"
#: A test rejects randomness beyond so many standard deviations (0.1 % of random strings, on both sides).
REJECTS = 3.29
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: (pattern, alphabet): the first that fits is a token's encoding. Decimal numbers are no candidates.
ENCODINGS = (
    ("[0-9a-f]+", _DIGITS + "abcdef"), ("[0-9A-F]+", _DIGITS + "ABCDEF"), ("[a-z]+", _LOWER), ("[A-Z]+", _UPPER), ("[A-Z2-7]+", _UPPER + "234567"), ("[a-z0-9]+", _LOWER + _DIGITS),
    ("[A-Z0-9]+", _UPPER + _DIGITS), ("[A-Za-z]+", _UPPER + _LOWER), ("[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS), ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"), (".+", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: A place between two characters of different kinds.
CHANGE = "(?<=[a-z])(?=[A-Z0-9+/_-])|(?<=[A-Z])(?=[a-z0-9+/_-])|(?<=[0-9])(?=[A-Za-z+/_-])|(?<=[+/_-])(?=[A-Za-z0-9])"
#: Negative logarithms of probabilities are whole bits up to this.
BITS = 200
_STEP = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(steps: Column) -> Column:
    """Running sums of a non-empty array, in blocks, so that an array of n takes about n * _STEP / 2 additions."""
    block = lambda i: F.floor(i / _STEP)
    numbers = F.sequence(F.lit(0), block(F.size(steps) - 1))
    blocks = F.transform(numbers, lambda b: _total(F.slice(steps, b * _STEP + 1, _STEP)))
    bases = _let(blocks, lambda x: F.transform(numbers, lambda b: _total(F.slice(x, 1, b))))
    return _let(bases, lambda x: F.transform(steps, lambda _, i: F.get(x, block(i).cast("int")) + _total(F.slice(steps, block(i) * _STEP + 1, i % _STEP + 1))))


def _matches(text: Column, pattern: str) -> Column:
    """Every match in order: struct(start, end, match), in code points."""
    none = F.expr("cast(array() AS array<struct<start: bigint, end: bigint, match: string>>)")

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, match: (F.length(gap) + F.length(match)).cast("long"))
        ends = _let(steps, _running)
        return F.zip_with(ends, found, lambda end, match: F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _battery(s: Column, encoding: Column) -> Column:
    """struct(encoding, size, squares, changes, random) of a token's characters: squares is the sum of the squared counts of symbols, random whether no test rejects that they are."""
    alphabet = F.get(F.array(*(F.lit(a) for _, a in ENCODINGS)), encoding)
    halves = F.get(F.array(*(F.lit("0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for _, a in ENCODINGS)), encoding)
    n, k = F.length(s).cast("double"), F.length(alphabet).cast("double")

    def judged(squares: Column, ones: Column, runs: Column, v: Column) -> Column:
        df = k - 1
        chi = (F.cbrt(F.greatest(k * squares / n - n, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
        mean = 1 + 2 * ones * (n - ones) / n
        spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        beside = _total(F.zip_with(v, F.slice(v, 2, F.size(v) - 1), lambda a, b: F.coalesce(a * b, F.lit(0)))) + F.get(v, F.lit(0)) * F.get(v, F.size(v) - 1)
        total, square = _total(v), _total(F.transform(v, lambda x: x * x))
        bottom = n * square - total * total
        serial = (F.when(bottom != 0, (n * beside - total * total) / bottom).otherwise(1) + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
        kept = [F.abs(z) <= REJECTS for z in (chi, F.when(spread > 0, (runs - mean) / spread).otherwise(2 * REJECTS), serial)]
        changes = F.regexp_count(s, F.lit(CHANGE)).cast("double")
        return F.struct(encoding.alias("encoding"), n.alias("size"), squares.alias("squares"), changes.alias("changes"), (kept[0] & kept[1] & kept[2]).alias("random"))

    counts = F.transform(F.split(alphabet, ""), lambda c: (n - F.length(F.replace(s, c, F.lit("")))).cast("long"))
    bits = F.call_function("translate", s, alphabet, halves)
    values = F.transform(F.split(s, ""), lambda c: F.instr(alphabet, c).cast("long"))
    squares = _total(F.transform(counts, lambda x: x * x)).cast("double")
    return _let(bits, lambda b: _let(values, lambda v: _let(squares, lambda q: judged(q, n - F.length(F.replace(b, F.lit("1"), F.lit(""))), 1.0 + F.regexp_count(b, F.lit("01")) + F.regexp_count(b, F.lit("10")), v))))


def _candidates(tokens: Column) -> Column:
    """struct(start, end, test) of the tokens of CANDIDATE characters or more (without padding) that have an encoding."""
    plain = F.filter(tokens, lambda t: (F.length(F.rtrim(t["match"], F.lit("="))) >= CANDIDATE) & ~t["match"].rlike("^[0-9]+=*$"))

    def one(t: Column) -> Column:
        encoding = F.when(F.lit(False), F.lit(0))
        for at, (pattern, _) in enumerate(ENCODINGS):
            encoding = encoding.when(t["match"].rlike(f"^{pattern}=*$"), F.lit(at))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), _let(F.rtrim(t["match"], F.lit("=")), lambda s: _let(encoding, lambda e: _battery(s, e))).alias("test"))

    return F.transform(plain, one)


def _found(documents: DataFrame) -> DataFrame:
    """doc_id, base (kind, start, end), candidates, ordinary (shorter tokens, each followed by a space). Of the whole text, nothing else is kept."""
    text = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = text.select("doc_id", _matches(F.col("text"), TOKEN).alias("tokens"), *(_matches(F.col("text"), p).alias(k) for k, p in zip(KINDS, PATTERNS, strict=False)))
    long = F.filter("assign", lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= VALUE)
    span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    base = [F.transform(x, span(kind)) for kind, x in enumerate((long, F.col("access"), F.col("hex")))]
    short = F.filter(F.transform("tokens", lambda t: F.rtrim(t["match"], F.lit("="))), lambda s: F.length(s) < CANDIDATE)
    return read.select("doc_id", F.concat(*base).alias("base"), _candidates(F.col("tokens")).alias("candidates"), F.array_join(short, " ").alias("ordinary"))


def _rates(found: DataFrame) -> DataFrame:
    """One row: moments, for each encoding sum(p^2) and sum(p^3) of its symbols among ordinary tokens, and change, the share of places between kinds of characters. One is added to each count."""
    symbols = found.select(F.explode(F.split("ordinary", "")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    symbols = symbols.where("symbol NOT IN ('', ' ')").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("counts"))  # one row for each token character

    def moments(alphabet: str) -> Column:
        n = F.transform(F.array(*map(F.lit, alphabet)), lambda c: 1.0 + F.coalesce(F.element_at("counts", c), F.lit(0)))
        power = lambda x, k: F.aggregate(x, F.lit(0.0), lambda a, y: a + F.pow(y, F.lit(k)))
        return F.struct((power(n, 2) / F.pow(power(n, 1), F.lit(2))).alias("two"), (power(n, 3) / F.pow(power(n, 1), F.lit(3))).alias("three"))

    gaps = found.select(F.regexp_count("ordinary", F.lit(CHANGE)).alias("changes"), F.greatest(F.length(F.replace("ordinary", F.lit(" "), F.lit(""))) - F.size(F.split("ordinary", " ")), F.lit(0)).alias("places"))
    gaps = gaps.agg(((1.0 + F.coalesce(F.sum("changes"), F.lit(0))) / (2.0 + F.coalesce(F.sum("places"), F.lit(0)))).alias("change"))
    return symbols.select(F.array(*(moments(a) for _, a in ENCODINGS)).alias("moments")).crossJoin(gaps)


def _bits(test: Column) -> Column:
    """How unlikely ordinary text were to look as random as the token does: minus the binary logarithm, in whole bits, of a bound of the probability; 0 for what the battery rejects."""
    n, moment = test["size"], F.get(F.col("moments"), test["encoding"])
    pairs, two, three = n * (n - 1) / 2, moment["two"], moment["three"]
    fewer = (pairs * two - (test["squares"] - n) / 2) / F.sqrt(pairs * (two - two * two) + 2 * pairs * (n - 2) * (three - two * two))
    collisions = F.when(fewer > 0, 1 + fewer * fewer / 2 / math.log(2))  # the normal tail is at most exp(-z^2 / 2) / 2
    share, rate = test["changes"] / (n - 1), F.col("change")
    chernoff = share * F.ln(share / rate) + F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - rate))).otherwise(0)
    changes = F.when(share > rate, (n - 1) * chernoff / math.log(2))
    either = F.greatest(collisions, changes, F.lit(0.0)) - 1  # the better of two
    return F.when(test["random"], F.least(F.greatest(F.floor(either), F.lit(0)), F.lit(BITS))).otherwise(0).cast("int")


def _stratum(test: Column) -> Column:
    """Encoding and class of lengths (two for each doubling), as one number."""
    return (test["encoding"] * 128 + F.floor(2 * F.log2(test["size"]))).cast("int")


def _thresholds(judged: DataFrame, share: float) -> DataFrame:
    """One row: least, the bits from which a candidate of a stratum is found, by Benjamini and Hochberg; strata without any are absent."""
    tests = judged.select(F.explode("candidates").alias("c")).select(F.col("c.stratum").alias("stratum"), F.col("c.bits").alias("bits"))
    counts = tests.groupBy("stratum", "bits").agg(F.count("*").alias("n"))  # at most BITS + 1 rows a stratum
    above = counts.select("*", F.sum("n").over(Window.partitionBy("stratum").orderBy(F.desc("bits"))).alias("found"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    least = above.where(F.col("all") * F.pow(F.lit(0.5), F.col("bits")) <= share * F.col("found")).groupBy("stratum").agg(F.min("bits").alias("bits"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bits"))).alias("least"))


def scan(documents: DataFrame, scratch: Scratch, share: float = 0.01) -> DataFrame:
    """doc_id and spans array<struct<start long, kind int, end long>> of every document: kinds by their number in KINDS, by start, kind and end.

    The fixed kinds are the matches of PATTERNS (an assigned value needs VALUE characters); `random` has the candidates that
    the tests let pass, of which `share` at most are expected to be ordinary text, in each encoding and class of lengths. Kinds may
    overlap. Positions are code points, ends exclusive.

    Null and empty texts have no spans; a null id stays null and repeated rows stay, each with its spans. Text of any length
    is read to its end. Without tokens to tell what is ordinary nothing random is found. Other columns are not read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    with held(spark, {"spark.sql.parquet.columnarReaderBatchSize": 512}):
        found = scratch.keep(_found(documents))
    rates = scratch.keep(_rates(found))
    test = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _stratum(c["test"]).alias("stratum"), _bits(c["test"]).alias("bits"))
    judged = found.crossJoin(F.broadcast(rates)).select("doc_id", "base", F.transform("candidates", test).alias("candidates"))  # one row
    least = scratch.keep(_thresholds(judged, share))
    passed = F.filter("candidates", lambda c: c["bits"] >= F.coalesce(F.element_at("least", c["stratum"]), F.lit(BITS + 1)))
    added = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return judged.crossJoin(F.broadcast(least)).select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))  # one row
