"""Text, JSON and date expressions. White space and word boundaries follow Unicode, hence (?U)."""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab


def strip(c: Column) -> Column:
    """Without outer white space. A text that starts and ends with a printable ASCII character is left as it is: two characters
    tell, where the replacement searches all of them."""
    edge = lambda x: F.ascii(x).between(0x21, 0x7E)
    return F.when(edge(c) & edge(F.substring(c, -1, 1)), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def match_key(c: Column) -> Column:
    """Lower case, no outer white space, each inner run one space."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def cluster_key(c: Column) -> Column:
    """match_key without salt names; what they leave inside is not collapsed again.

    A printable ASCII text without salt names, outer spaces and runs of them is its lower case: searches for plain bytes and one for
    a class tell, where the five replacements (Unicode's classes at each character) take most of a scan's time, and an expression
    with all of these names as branches tries each at each character.
    """
    low = F.lower(c)
    more = [F.startswith(low, F.lit(" ")), F.endswith(low, F.lit(" ")), *(F.contains(low, F.lit(x)) for x in ("  ", *vocab.SALTS)), low.rlike("[^ -~]")]
    return F.when(~functools.reduce(lambda a, b: a | b, more), low).otherwise(_cluster_key(c))


def _cluster_key(c: Column) -> Column:
    return strip(F.regexp_replace(match_key(c), rf"(?U)\b({'|'.join(vocab.SALTS)})\b", ""))


def phase(c: Column) -> Column:
    return vocab.lookup(F.upper(strip(c)), vocab.PHASES, "Unknown")


def status(c: Column) -> Column:
    return vocab.lookup(F.upper(strip(c)), vocab.STATUSES, "Unknown")


def disease_area(c: Column) -> Column:
    plain = F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))
    known = F.coalesce(vocab.lookup(plain, vocab.AREA_ALIASES), plain)
    return F.when(known.isin(*vocab.AREAS), known).otherwise("unknown")


def display_area(c: Column) -> Column:
    return vocab.lookup(c, vocab.AREAS, "Others")


def modality(c: Column) -> Column:
    return F.when(c.isin(*vocab.MODALITIES), c).otherwise("unknown")


def confidence(c: Column) -> Column:
    return vocab.lookup(c, vocab.CONFIDENCE, 0.0)


def iso_date(c: Column) -> Column:
    """A calendar date, or the day of an ISO week (Monday without a day), each with hyphens or without; others are null."""
    packed = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = F.when(packed.rlike(r"^\d{4}-\d{2}-\d{2}$"), packed.try_cast("date"))
    week = r"^(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)$"
    part = lambda *groups: F.coalesce(*(F.nullif(F.regexp_extract(c, week, g), F.lit("")).cast("int") for g in groups))
    year, number = part(1), part(2, 4)
    start = F.date_add(F.trunc(F.make_date(F.when(year > 0, year), F.lit(1), F.lit(4)), "week"), (number - 1) * 7)
    # the week belongs to the year of its Thursday
    good = number.between(1, 53) & (F.year(F.date_add(start, 3)) == year)
    return F.coalesce(day, F.when(good, F.date_add(start, F.coalesce(part(3, 5), F.lit(1)) - 1)))


def cache_key(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.lower(c) for c in columns)), 256)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def area_vote(trees: Column) -> Column:
    """Plurality of the areas of tree numbers: null without any or on a tie for the first place, other if none maps."""
    mapped = F.filter(F.transform(trees, lambda t: vocab.case(F.substring(t, 1, 3), vocab.TREES)), lambda x: x.isNotNull())
    count = lambda m, a: F.size(m) - F.size(F.array_remove(m, a))
    ranked = lambda m: F.sort_array(F.transform(F.array_distinct(m), lambda a: F.struct(count(m, a).alias("n"), a.alias("area"))), asc=False)
    first = lambda top: F.when(F.size(top) == 0, "other").when((F.size(top) == 1) | (top[0]["n"] > F.get(top, F.lit(1))["n"]), top[0]["area"])
    return F.when(F.size(trees) > 0, bound(bound(mapped, ranked), first))


@functools.cache
def _decomposition() -> tuple[str, str, dict[str, str]]:
    """What NFKD makes of each code point without combining characters, by the rule of this Python's Unicode tables: code points with
    one in their place, those places (the code points after them go), and texts for the others.

    A string's decomposition is that of its code points one by one: reordering moves combining characters only.
    """
    one, gone, more = {}, [], {}
    for x in map(chr, itertools.chain(range(0x80, 0xD800), range(0xE000, 0x110000))):
        to = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        if to == x:
            continue
        if not to:
            gone.append(x)
        elif len(to) == 1:
            one[x] = to
        else:
            more[x] = to
    return "".join([*one, *gone]), "".join(one.values()), more


def _ranges(points: list[int]) -> str:
    """A character class of code points."""
    out, start = [], None
    for at, x in enumerate(points):
        start = x if start is None else start
        if at + 1 == len(points) or points[at + 1] != x + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{x:x}}}")
            start = None
    return f"[{''.join(out)}]"


def decomposed(c: Column) -> Column:
    """NFKD without combining characters, by code point and without Python: most by one translation; a text with code points
    that become several takes a table of these. ASCII texts are left as they are."""
    old, new, more = _decomposition()
    table = F.from_json(F.lit(json.dumps(more)), "map<string,string>")  # a constant: it is parsed once for a query
    plain = F.translate(c, old, new)
    whole = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.when(c.rlike(_ranges(sorted(map(ord, more)))), whole).otherwise(plain)).otherwise(c)


def canonical_drug(c: Column, ascii_only: bool = False) -> Column:
    """A drug name without descriptors: brackets, separators, punctuation, noise words; roman numerals as digits.

    `ascii_only` leaves out the decomposition where the column is known to be ASCII.
    """
    s = F.coalesce(c, F.lit(""))
    s = F.lower(s if ascii_only else decomposed(s))
    for pattern, to in (  # fixed values: the patterns and their order decide the name
        (r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " "), (r"[/,_;:\-–—]", " "), (r"[\"'“”‘’`]", ""), (r"(?U)[^\w\s]", " "), (r"(?U)\b(\d{1,3})\s*(lu|ga|y|i|tc|in)\b", "$1$2"),
    ):
        s = F.regexp_replace(s, pattern, to)
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*vocab.DRUG_NOISE))
    return F.array_join(F.transform(words, lambda w: F.coalesce(vocab.lookup(w, vocab.ROMAN), w)), " ")


REPLY = "array<struct<candidate_index:int,drug_modality:string,disease_area:string,modality_confidence:string,disease_confidence:string,reasoning:string>>"
OUTCOME_REPLY = "array<struct<candidate_index:int,outcome:string,confidence:string,reasoning:string,evidence_sources:array<string>,approval_date:string,commercialization_date:string>>"


@F.pandas_udf(T.StringType())
def first_array(s: pd.Series) -> pd.Series:
    """The first decodable JSON array in a text, as JSON; for replies that are not plain JSON."""

    def find(text: str | None) -> str | None:
        decode, at = json.JSONDecoder().raw_decode, (text or "").find("[")
        while at >= 0:
            try:
                if isinstance(value := decode(text, at)[0], list):
                    return json.dumps(value)
            except ValueError:
                pass
            at = text.find("[", at + 1)
        return None

    return s.map(find)


def reply(c: Column, salvage: bool = True, schema: str = REPLY) -> Column:
    """A reply's items that have an integer index: fences removed, else the first array in the text."""
    plain = strip(c)
    bare = F.when(F.contains(plain, F.lit("```")), F.regexp_replace(plain, r"^```[a-zA-Z]*\s*|\s*```$", "")).otherwise(plain)
    parsed = F.when(F.startswith(bare, F.lit("[")), F.from_json(bare, schema))
    # Spark runs Python before any CASE, so the texts that need none go in as null
    whole = F.coalesce(parsed, F.from_json(first_array(F.when(parsed.isNull(), c)), schema)) if salvage else parsed
    return F.filter(F.coalesce(whole, F.from_json(F.lit("[]"), schema)), lambda x: x["candidate_index"].isNotNull())


def slug(c: Column) -> Column:
    """Lower case, spaces and slashes as underscores."""
    return F.translate(F.lower(c), " /", "__")


def application_number(*candidates: Column) -> Column:
    """The first of some application numbers that is not empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))


def application_url(number: Column) -> Column:
    """Address of an application's overview, by the number from its first digit on; empty without a number."""
    return F.when(number.isNull(), "").otherwise(F.concat(F.lit(vocab.APPLICATION_URL), F.regexp_replace(number, r"^\D+", "")))


def pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def fold(a: Column, b: Column) -> Column:
    """The ratio of two numbers in words."""
    ratio = F.try_divide(a, b)
    out = F.when(b == 0, vocab.INFINITE).when(ratio >= 2.5, F.format_string("%d-fold higher than", F.bround(ratio).cast("int"))).when(ratio >= 1.8, F.format_string("nearly %d-fold higher than", F.bround(ratio).cast("int")))
    for least, words in vocab.FOLDS:
        out = out.when(ratio >= least, words)
    return out.otherwise(vocab.FEWEST)
