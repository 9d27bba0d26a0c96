"""Names, sentences and redaction as Column expressions, so that they stay inside Spark's code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions.scoring import as_col

# The road-name rewrites, in the order they apply, and the word abbreviations.
PREFIXES = (
    (r"\bFARM[\s-]*TO[\s-]*MARKET( ROAD)?\b", "FM"),
    (r"\bF M\b", "FM"),
    (r"\bFM RD\b", "FM"),
    (r"\bRANCH[\s-]*TO[\s-]*MARKET( ROAD)?\b", "RM"),
    (r"\bRANCH ROAD\b", "RR"),
    (r"\bR M\b", "RM"),
    (r"\bSTATE HIGHWAY\b", "SH"),
    (r"\bSTATE HWY\b", "SH"),
    (r"\bTEXAS STATE HIGHWAY\b", "SH"),
    (r"\bTX\b", "SH"),
    (r"\bSTATE ROUTE\b", "SH"),
    (r"\bCOUNTY ROAD\b", "CR"),
    (r"\bCOUNTY RD\b", "CR"),
    (r"\bC R\b", "CR"),
    (r"\bUS HIGHWAY\b", "US"),
    (r"\bUS HWY\b", "US"),
    (r"\bU S\b", "US"),
    (r"\bINTERSTATE( HIGHWAY)?\b", "IH"),
    (r"\bI\s(?=\d)", "IH "),
    (r"\bPARK ROAD\b", "PR"),
    (r"\bPRIVATE ROAD\b", "PVT"),
)
SUFFIXES = {
    "ROAD": "RD", "STREET": "ST", "LANE": "LN", "DRIVE": "DR", "AVENUE": "AVE", "TRAIL": "TRL", "COURT": "CT",
    "CIRCLE": "CIR", "BOULEVARD": "BLVD", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "NORTH": "N", "SOUTH": "S", "EAST": "E",
    "WEST": "W", "CROSSING": "XING", "PLACE": "PL", "TERRACE": "TER", "LOOP": "LOOP", "SPUR": "SPUR", "PASS": "PASS",
    "CREEK": "CRK", "MOUNT": "MT", "SAINT": "ST", "FORT": "FT", "BEND": "BND", "HOLLOW": "HOLW", "VALLEY": "VLY",
}
ROUTE_CLASSES = ("FM", "RM", "RR", "SH", "CR", "US", "IH", "PR", "LOOP", "SPUR", "BUS")
FARM_ROADS = ("FM", "RM", "RR")
UNNAMED = r"^(UNNAMED|UNKNOWN|NONE|PRIVATE|DRIVEWAY|N/?A)\b"
#: Words that don't tell two roads apart.
COMMON = ("RD", "ST", "LN", "DR", "AVE", "N", "S", "E", "W", "TRL", "HWY")
ABBREVIATIONS = r"\b(Rd|St|Dr|Ln|Ave|Blvd|Co|Hwy|Mt|Ft|Jr|Sr|Mr|Mrs|Ms|No|Pkwy|Trl|Cir|Ct|Ste|vs|approx|Mi|mi|U\.S|a\.m|p\.m)\."


def norm(c: Column | str) -> Column:
    """A road name in capitals, without punctuation, with routes and words abbreviated; empty for null."""
    s = F.replace(F.upper(F.coalesce(as_col(c), F.lit(""))), F.lit("&"), F.lit(" AND "))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[^A-Z0-9 ]", " "), r"\s+", " "))
    for pattern, short in PREFIXES:
        s = F.regexp_replace(s, pattern, short)
    short_of = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    words = F.filter(F.split(s, " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short_of, w), w)), " ")


def route_key(normed: Column) -> Column:
    """``struct(cls, number)`` of the first numbered road in a normalised name, else null."""
    pattern = rf"\b({'|'.join(ROUTE_CLASSES)})\s*(\d+[A-Z]?)\b"
    cls = F.regexp_extract(normed, pattern, 1)
    return F.when(cls != "", F.struct(cls.alias("cls"), F.regexp_extract(normed, pattern, 2).alias("number")))


def unnamed(c: Column | str) -> Column:
    """Whether a road has no name of its own; a null has none."""
    n = norm(c)
    return (n == "") | n.rlike(UNNAMED)


def words_of(normed: Column) -> Column:
    return F.filter(F.split(normed, " "), lambda w: (w != "") & ~w.isin(*COMMON))


def same_road(a: Column | str, name: Column | str, refs: Column | str) -> Column:
    """Whether an inventory road is one of a segment's names: true, false, or null where the inventory's has no name.

    Names agree by route class and number (farm and ranch roads are one class), by a bare route number, or where the words of
    one, without the common ones, are among those of the other. ``refs`` are parted by ``|``.
    """
    a, name, refs = as_col(a), as_col(name), as_col(refs)
    na = norm(a)
    ka, wa = route_key(na), words_of(na)
    names = F.filter(F.concat(F.array(F.coalesce(name, F.lit(""))), F.split(F.coalesce(refs, F.lit("")), r"\|")), lambda b: b != "")

    def agrees(b: Column) -> Column:
        nb = norm(b)
        kb, wb = route_key(nb), words_of(nb)
        one_class = (ka["cls"] == kb["cls"]) | (ka["cls"].isin(*FARM_ROADS) & kb["cls"].isin(*FARM_ROADS))
        by_route = ka.isNotNull() & kb.isNotNull() & (ka["number"] == kb["number"]) & one_class
        by_number = ka.isNotNull() & kb.isNull() & b.rlike(r"^\d+$") & (b == ka["number"])
        within = lambda x, y: F.size(F.array_except(x, y)) == 0
        by_words = (F.size(wa) > 0) & (F.size(wb) > 0) & (within(wa, wb) | within(wb, wa))
        return F.coalesce(by_route, F.lit(False)) | F.coalesce(by_number, F.lit(False)) | by_words

    return F.when(~unnamed(a), F.exists(names, agrees))


# The forms of a free description that name a road, in the order they are tried, and what names none.
DESCRIPTIONS = (
    r"(?i)^LWC\s*-\s*(.+)$",
    r"(?i)^LWC\s+(?:PRIMARY|SECONDARY)\s+ROAD\s*,\s*[^,]*,\s*(.+)$",
    r"(?i)^LWC\s+BRIDGE CLASS\s*,.*?\bAT\s+(.+?)(?:\s+\d+(?:\.\d+)?\s*MI\b.*)?$",
)
NO_ROAD = r"(?i)^LWC|^(?:BRIDGE|CULVERT)$"
BEFORE_STREAM = r"(?i)\s+(?:at|@)\s+|@|\s-\s|-\s"


def inventory_road(description: Column | str) -> Column:
    """The road in a free description: by the first of ``DESCRIPTIONS`` that fits, whole; null where it is marked as a crossing or structure in
    another way; else what stands before an "at", an @ or a dash, without house number, brackets and dots at the ends."""
    s = F.trim(F.regexp_replace(as_col(description), r"\s+", " "))
    named = [F.nullif(F.trim(F.regexp_extract(s, p, 1)), F.lit("")) for p in DESCRIPTIONS]
    head = F.element_at(F.split(s, BEFORE_STREAM), 1)
    bare = F.regexp_replace(F.regexp_replace(head, r"^\d+\s+", ""), r"\(.*?\)", "")
    free = F.nullif(F.regexp_replace(bare, r"^[ .]+|[ .]+$", ""), F.lit(""))
    return F.coalesce(*named, F.when(~s.rlike(NO_ROAD), free))


# The search terms. (?i:...) keeps the parts that ignore case apart from those that don't.
KEYWORDS = {
    "low_water_crossing": r"(?i:\blow[\s-]*water[\s-]*(?:crossing|xing)s?\b)",
    "water_over_road": r"(?i:\bwater\s+(?:\w+\s+){0,3}?(?:over|across)\s+(?:the\s+|a\s+)?(?:road|roadway|street|highway|bridge|crossing)s?\b)",
    "swept_away": r"(?i:\b(?:swept|washed|carried)\s+(?:\w+\s+){0,2}?(?:away|off|downstream|into)\b)",
    "vehicle": r"(?i:\b(?:vehicles?|cars?|trucks?|pick-?ups?|suvs?|motorists?|automobiles?|sedans?|jeeps?)\b)|\bvans?\b",
    "drove_into": r"(?i:\b(?:drove|driven|driving)\s+(?:\w+\s+){0,3}?(?:into|through|across|onto)\b)",
    "crossing": r"(?i:\bcrossings?\b)",
}
EXTRA_KEYWORDS = {
    "rescue_stranded_trapped": r"(?i:\brescu\w*|\bstranded\b|\btrapped\b)",
    "cut_off_stranded_trapped": (
        r"(?i:\bcut\s+off\b|\bmarooned\b|"
        r"\b(?:residents|homes|houses|families|people|persons|community|communities|subdivisions?|neighbou?rhoods?|campers|ranch(?:es)?|households?)\b[^.;]{0,60}\b(?:isolated|stranded|trapped)\b|"
        r"\b(?:isolated|stranded|trapped)\b[^.;]{0,40}\b(?:residents|homes|houses|families|community|communities|subdivisions?|neighbou?rhoods?|households?)\b|"
        r"\bunable\s+to\s+(?:leave|get\s+out|get\s+home|reach\s+(?:their|his|her)\s+homes?)\b|\b(?:no|only)\s+(?:way|access|road|route)\s+(?:in|out|into)\b)"
    ),
}
DEATH = (
    r"(?i:\bdrown\w*|\bdied\b|\bdeaths?\b|\bdead\b|\bdeceased\b|\bkill\w*|\bfatal\w*|\bbod(?:y|ies)\b|\bperish\w*|"
    r"\bsuccumb\w*|\blost\s+(?:their|his|her)\s+li(?:fe|ves)\b|\b(?:not|neither|never)\b[^.;]{0,40}\bsurviv\w*)"
)
PEOPLE = (
    KEYWORDS["vehicle"] + r"|(?i:\bdriv(?:er|ers)\b|\bmotorists?\b|\brescu\w*|\bstranded\b|\btrapped\b|\bcut\s+off\b|"
    r"\b(?:man|men|woman|women|boys?|girls?|child|children|mother|father|husband|wife|famil(?:y|ies)|occupants?|"
    r"passengers?|persons?|people|residents|teen\w*|victims?)\b)|" + DEATH
)
SITE = "|".join([*(KEYWORDS[k] for k in ("low_water_crossing", "water_over_road", "swept_away", "crossing")), r"(?i:\bbridges?\b|\bswept\b|\bwashed\b)"])
INCIDENT = "|".join(
    [
        *(KEYWORDS[k] for k in ("low_water_crossing", "water_over_road", "drove_into", "crossing", "vehicle")),
        r"\bdrive\b|(?i:\bdriv(?:er|ers|ing|en)\b|\bdrove\b|\bmotorists?\b|\bstall\w*|\bbarricade\w*|\bbarriers?\b|"
        r"\b(?:swept|washed)\s+(?:\w+\s+){0,2}?off\s+(?:of\s+)?(?:the\s+|a\s+)?(?:road|roadway|street|highway|bridge|crossing)s?\b)",
    ]
)


def java(pattern: str) -> str:
    """The pattern with Unicode word characters and borders, as the terms were written for."""
    return "(?U)" + pattern


def flag(c: Column | str, pattern: str) -> Column:
    return F.coalesce(as_col(c).rlike(java(pattern)), F.lit(False))


def keyword_flags(sources: dict[str, Column | str]) -> list[Column]:
    """One boolean per source (by its prefix) and term."""
    return [flag(c, p).alias(f"{prefix}_{k}") for prefix, c in sources.items() for k, p in (KEYWORDS | EXTRA_KEYWORDS).items()]


def sentences(c: Column | str) -> Column:
    """Sentences of a text: abbreviations and decimals don't end one, a bar does."""
    s = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), ABBREVIATIONS, "$1\u0001")
    s = F.regexp_replace(s, r"(?<=\d)\.(?=\d)", "\u0002")
    parts = F.split(s, SENTENCE_END)
    back = lambda x: F.trim(F.replace(F.replace(x, F.lit("\u0001"), F.lit(".")), F.lit("\u0002"), F.lit(".")))
    return F.filter(F.transform(parts, back), lambda x: x != "")


SENTENCE_END = r"(?<=[.!?])\s+|\s*\|\s*|(?<=[a-z]{2}\.)(?=[A-Z])"


def sentence_spans(c: Column | str) -> Column:
    """Sentences with their places, ``array<struct<start, stop, sentence>>``: code points from 0, the end exclusive, around the text as it stands there."""
    text = F.coalesce(as_col(c), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(text, ABBREVIATIONS, "$1\u0001"), r"(?<=\d)\.(?=\d)", "\u0002")
    parts, ends = F.split(s, SENTENCE_END), F.regexp_extract_all(s, F.lit(SENTENCE_END), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    sizes = F.zip_with(parts, ends, lambda p, e: F.length(p) + F.coalesce(F.length(e), F.lit(0)))
    starts = F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
    back = lambda x: F.trim(F.replace(F.replace(x, F.lit("\u0001"), F.lit(".")), F.lit("\u0002"), F.lit(".")))
    spans = F.zip_with(parts, starts, lambda p, a: F.struct(a.alias("start"), (a + F.length(p)).alias("stop"), back(p).alias("sentence")))
    return F.filter(spans, lambda x: x["sentence"] != "")


def excerpt(sentence: Column | str, offset: Column | int = 0, most: int = 25) -> Column:
    """At most ``most`` words of a sentence, centred on the word at a character offset, with dots where it was cut."""
    s = F.trim(as_col(sentence))
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    n = F.size(words)
    at = F.size(F.filter(F.split(F.substring(s, F.lit(1), F.lit(offset) + 1 if isinstance(offset, int) else offset + 1), r"\s+"), lambda w: w != "")) - 1
    first = F.greatest(F.lit(0), F.least(at - most // 2, n - most))
    last = F.least(n, first + most)
    body = F.array_join(F.slice(words, first + 1, F.greatest(F.lit(0), last - first)), " ")
    body = F.regexp_replace(body, "[\u2013\u2014]", "-")
    dots = lambda test: F.when(test, "...").otherwise("")
    return F.when(n > 0, F.concat(dots(first > 0), body, dots(last < n))).otherwise("")


# How a report names a person.
_WORD = r"[A-Z][a-z'\-]+"
_ONE = _WORD + r"(?:\s+[A-Z]\.?)?(?:\s+(?:Mc|O'|De\s|de\s)?" + _WORD + r"){0,2}"
_TWO = _WORD + r"(?:\s+[A-Z]\.?)?(?:\s+(?:Mc|O'|De\s|de\s)?" + _WORD + r"){1,2}"
PERSONS = (
    r"\b(" + _ONE + r"),?\s+(?:age|aged)\s+\d{1,3}\b",
    r"\b(" + _TWO + r"),\s+\d{1,3}\s*,",
    r"\b(" + _TWO + r")\s*\(\s*\d{1,3}\s*\)",
    r"\b(" + _TWO + r"),\s+(?:a|an)\s+\d{1,3}[- ]years?[- ]old",
    r"\b(?:Mr|Mrs|Ms|Miss)\.?\s+(" + _WORD + r"(?:\s+" + _WORD + r")?)",
    r"\b(?:identified as|named)\s+(" + _TWO + r")",
)
REMOVED = "[name removed]"


def person_names(c: Column | str) -> Column:
    """Names that a text gives a person by its context, longest first."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(as_col(c), F.lit("")), F.lit(p), F.lit(1)) for p in PERSONS))))
    return F.transform(F.array_sort(F.transform(found, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])


def redact(c: Column | str, names: Column) -> Column:
    """``c`` with each of the names replaced; several in a row become one."""
    done = F.aggregate(names, as_col(c), lambda text, n: F.replace(text, n, F.lit(REMOVED)))
    mark = r"\Q" + REMOVED + r"\E"
    return F.regexp_replace(done, f"{mark}(?:[\\s,]*(?:and\\s+)?{mark})+", r"\[name removed\]")


def number_norm(c: Column | str) -> Column:
    """A route number without leading zeros, its letter a capital."""
    c = as_col(c)
    fits = c.rlike(r"^\d+[A-Za-z]?$")
    return F.when(fits, F.upper(F.regexp_replace(c, r"^0+(?=\d)", ""))).otherwise(F.upper(c))


def aliases(road: Column | str, seg_name: Column | str, seg_refs: Column | str, tier: Column | str) -> Column:
    """Names under which a crossing's road may be written, ``array<struct<name, source>>``: the string, its
    brackets, its parts at ``/`` and ``&``, and the segment's names where a tier confirms it."""
    road, seg_name, seg_refs, tier = map(as_col, (road, seg_name, seg_refs, tier))
    whole = F.coalesce(road, F.lit(""))
    base = F.regexp_replace(whole, r"\([^)]*\)", " ")
    own = F.concat(F.array(whole), F.regexp_extract_all(whole, F.lit(r"\(([^)]*)\)"), F.lit(1)), F.split(base, r"(?<!\d)/(?!\d)|&"))
    own = F.when(~unnamed(road), own).otherwise(F.array().cast("array<string>"))
    more = F.concat(F.array(F.coalesce(seg_name, F.lit(""))), F.split(F.coalesce(seg_refs, F.lit("")), r"\|"))
    more = F.when(tier.isin("A_name_verified", "B_unnamed_within_15m"), more).otherwise(F.array().cast("array<string>"))
    named = lambda xs, src: F.transform(F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(x.alias("name"), F.lit(src).alias("source")))
    return F.concat(named(own, "inventory"), named(more, "segment"))


def pad_id(c: Column | str, width: int = 11) -> Column:
    """Zeros in front up to ``width``; longer ids stay whole."""
    s = as_col(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def contains_run(whole: Column, part: Column) -> Column:
    """Whether an array holds another as a contiguous run. ``whole`` is bound once: a lambda works out again what it names, here the whole array at each place."""

    def held(w: Column) -> Column:
        last = F.size(w) - F.size(part)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), last))
        return F.when((last < 0) | (F.size(part) == 0), F.size(part) == 0).otherwise(F.exists(starts, lambda i: F.slice(w, i + 1, F.size(part)) == part))

    return F.get(F.transform(F.array(whole), held), F.lit(0))


def one_decimal(x: Column) -> Column:
    """``%.1f`` of a double as C writes it: its exact binary value rounded, a tie to even. Java rounds the shortest decimal form up (12.25 to 12.3).

    Ten times ``x`` is kept exactly as a sum ``s + e`` of two doubles; from 2 ** 49 on doubles have too few binary places for a tie and Java's form is taken.
    """
    a = F.abs(x)
    eight, two = a * 8, a * 2
    s = eight + two
    e = two - (s - eight)  # exact, as the first term is the larger
    low = F.floor(s).cast("long")
    rest = s - low
    up = (rest > 0.5) | ((rest == 0.5) & ((e > 0) | ((e == 0) & (low % 2 == 1))))
    n = low + up.cast("long")
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    exact = F.concat(sign, F.floor(n / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.when(F.isnan(x), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a < 2.0**49, exact).when(x.isNotNull(), F.format_string("%.1f", x))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
