"""Names, keyword flags, sentences, redaction, and reports matched to points."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import text as tx
from terrafold.operators import matcher
from terrafold.operators.tables import table as t
from terrafold.registry import register

#: Road names of both inventories for each part, with the odd cases of the matcher.
ROADS = [
    ("SH 163", "State Highway 163", ""), ("FM 2200", "Farm-to-Market Road 2200", ""), ("CR 410", "County Road 410", ""),
    ("RM 12", "Ranch to Market Road 12", ""), ("2ND ST", "2nd Street", ""), ("HACKBERRY RD", "Hackberry Road", ""),
    ("OLD SAN ANTONIO RD", "Old San Antonio Road", ""), ("FM 1431", "Lakeline Boulevard", "FM 1431"), ("CR 123", "County Road 124", ""),
    ("UNNAMED RD", "Main Street", ""), ("LOW WATER XING RD", "Low Water Crossing Road", ""),
]


def _values(rows, cols):
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({cols})"


NORM_SQL = "upper(s)"


def _norm_sql(s: str) -> str:
    """The rewrites as nested RE2 calls; its look-ahead rule is written without one."""
    x = f"trim(regexp_replace(regexp_replace(replace(upper({s}), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for pattern, short in tx.PREFIXES:
        pattern = r"\bI\s(\d)" if "(?=" in pattern else pattern
        x = f"regexp_replace({x}, '{pattern}', '{short}{chr(92) + '1' if pattern.endswith('(\\d)') else ''}', 'g')"
    words = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.SUFFIXES.items()) + " ELSE w END"
    return f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: {words}), ' ')"


_PART_ROAD = "p_name || ' ' || (CASE p_size % 6 WHEN 0 THEN 'Farm to Market Road ' || p_size WHEN 1 THEN 'County Road ' || p_size WHEN 2 THEN 'North Street' WHEN 3 THEN 'U S ' || p_size WHEN 4 THEN 'interstate highway ' || p_size ELSE 'Creek & Valley Lane' END)"


def _part_road():
    n = F.col("p_size").cast("string")
    tail = (
        F.when(F.col("p_size") % 6 == 0, F.concat(F.lit("Farm to Market Road "), n)).when(F.col("p_size") % 6 == 1, F.concat(F.lit("County Road "), n))
        .when(F.col("p_size") % 6 == 2, "North Street").when(F.col("p_size") % 6 == 3, F.concat(F.lit("U S "), n)).when(F.col("p_size") % 6 == 4, F.concat(F.lit("interstate highway "), n)).otherwise("Creek & Valley Lane")
    )
    return F.concat("p_name", F.lit(" "), tail)


@register("name_norm", f"SELECT p_partkey, {_norm_sql(_PART_ROAD)} AS name FROM part")
def name_norm(spark, d):
    return t(spark, d, "part").select("p_partkey", tx.norm(_part_road()).alias("name"))


_KEY = "\\b(FM|RM|RR|SH|CR|US|IH|PR|LOOP|SPUR|BUS)\\s*(\\d+[A-Z]?)\\b"


@register("route_key", f"SELECT p_partkey, NULLIF(regexp_extract(n, '{_KEY}', 1), '') AS cls, NULLIF(regexp_extract(n, '{_KEY}', 2), '') AS number FROM (SELECT p_partkey, {_norm_sql(_PART_ROAD)} AS n FROM part)")
def route_key(spark, d):
    k = tx.route_key(tx.norm(_part_road()))
    return t(spark, d, "part").select("p_partkey", k["cls"].alias("cls"), k["number"].alias("number"))


_SAME = [True] * 8 + [False, None, True]


@register("same_road", f"SELECT a, name, refs, same FROM {_values([(*r, s) for r, s in zip(ROADS, _SAME)], 'a, name, refs, same')}")
def same_road(spark, d):
    """Three-valued: true, false, or no answer for a road without a name."""
    df = spark.createDataFrame(ROADS, "a string, name string, refs string")
    return df.select("*", tx.same_road("a", "name", "refs").alias("same"))


_DESC = [("LWC - HACKBERRY RD", "HACKBERRY RD"), ("4300 Marsalis Street @ Dry Branch", "Marsalis Street"), ("14200 Old Denton Rd. at Alliance Creek", "Old Denton Rd"), ("", None), (None, None)]


@register("inventory_road", f"SELECT description, road FROM {_values(_DESC, 'description, road')}")
def inventory_road(spark, d):
    return spark.createDataFrame([(a,) for a, _ in _DESC], "description string").select("description", tx.inventory_road("description").alias("road"))


#: Sentences that orders "report", by key, so that every flag has cases.
PHRASES = [
    "Water over the road at the low water crossing.", "A car was swept away near CR 12.", "Two people drove into deep water.", "Heavy rain fell all night.",
    "Several homes were cut off and residents stranded.", "A man drowned at the crossing.", "The van stalled on FM 7.", "No damage was reported.",
]


def _phrase_sql(k: str) -> str:
    return f"({_values_list()})[1 + ({k}) % {len(PHRASES)}]"


def _values_list() -> str:
    return "[" + ", ".join("'" + p + "'" for p in PHRASES) + "]"


def _phrase(k):
    return F.get(F.array(*map(F.lit, PHRASES)), (k % len(PHRASES)).cast("int"))


_K = {
    "low_water_crossing": r"(?i)\blow[\s-]*water[\s-]*(?:crossing|xing)s?\b",
    "water_over_road": r"(?i)\bwater\s+(?:\w+\s+){0,3}?(?:over|across)\s+(?:the\s+|a\s+)?(?:road|roadway|street|highway|bridge|crossing)s?\b",
    "swept_away": r"(?i)\b(?:swept|washed|carried)\s+(?:\w+\s+){0,2}?(?:away|off|downstream|into)\b",
    "crossing": r"(?i)\bcrossings?\b",
    "drove_into": r"(?i)\b(?:drove|driven|driving)\s+(?:\w+\s+){0,3}?(?:into|through|across|onto)\b",
}


@register("keyword_flags", f"SELECT o_orderkey, {', '.join(f'regexp_matches(x, $q${p}$q$) AS ev_{k}' for k, p in _K.items())}, regexp_matches(x, $q$(?i)\\brescu\\w*|\\bstranded\\b|\\btrapped\\b$q$) AS ev_rescue_stranded_trapped FROM (SELECT o_orderkey, {_phrase_sql('o_orderkey')} || ' ' || {_phrase_sql('o_custkey')} AS x FROM orders)")
def keyword_flags(spark, d):
    x = F.concat_ws(" ", _phrase(F.col("o_orderkey")), _phrase(F.col("o_custkey")))
    o = t(spark, d, "orders").select("o_orderkey", x.alias("x"))
    keep = [f"ev_{k}" for k in (*_K, "rescue_stranded_trapped")]
    return o.select("o_orderkey", *tx.keyword_flags({"ev": "x"})).select("o_orderkey", *keep)


@register("death_people_site", f"SELECT p AS phrase, d AS death, q AS people, s AS site, i AS incident FROM {_values(list(zip(PHRASES, [False, False, False, False, False, True, False, False], [False, True, True, False, True, True, True, False], [True, True, False, False, False, True, False, False], [True, True, True, False, False, True, True, False])), 'p, d, q, s, i')}")
def death_people_site(spark, d):
    df = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    return df.select("phrase", tx.flag("phrase", tx.DEATH).alias("death"), tx.flag("phrase", tx.PEOPLE).alias("people"), tx.flag("phrase", tx.SITE).alias("site"), tx.flag("phrase", tx.INCIDENT).alias("incident"))


@register("sentence_split", f"SELECT o_orderkey, {_phrase_sql('o_orderkey')} AS first_sentence, 4::BIGINT AS n FROM orders")
def sentence_split(spark, d):
    """Abbreviations and decimals end no sentence; a bar does."""
    x = F.concat(_phrase(F.col("o_orderkey")), F.lit(" Near Old Rd. it rained 3.5 in. on St. Mary St.|"), _phrase(F.col("o_custkey")))
    s = tx.sentences(x)
    return t(spark, d, "orders").select("o_orderkey", F.get(s, F.lit(0)).alias("first_sentence"), F.size(s).cast("bigint").alias("n"))


@register("excerpt", "SELECT doc_id, array_to_string(w[1:25], ' ') || CASE WHEN len(w) > 25 THEN '...' ELSE '' END AS excerpt FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)")
def excerpt(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.excerpt("text").alias("excerpt"))


_PEOPLE = [
    ("John Smith, age 47, drove in. Smith was not found.", "[name removed], age 47, drove in. Smith was not found."),
    ("The driver, Maria Lopez, 33, and Mr. Brown died.", "The driver, [name removed], 33, and Mr. [name removed] died."),
    ("identified as Anna B. Jones", "identified as [name removed]"),
    ("No names here.", "No names here."),
]


@register("redact_names", f"SELECT s, r AS redacted FROM {_values(_PEOPLE, 's, r')}")
def redact_names(spark, d):
    df = spark.createDataFrame([(s,) for s, _ in _PEOPLE], "s string")
    return df.select("s", tx.redact("s", tx.person_names("s")).alias("redacted"))


@register("id_extract", "SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(source, '^src(\\d+)$', 1), '') AS BIGINT) AS n, contains(text, 'license') AS has_license, sha256(text) AS digest FROM documents")
def id_extract(spark, d):
    n = F.nullif(F.regexp_extract("source", r"^src(\d+)$", 1), F.lit("")).cast("bigint")
    return t(spark, d, "documents").select("doc_id", n.alias("n"), F.contains("text", F.lit("license")).alias("has_license"), F.sha2("text", 256).alias("digest"))


@register("format_numbers", "SELECT s_suppkey, printf('%.1f%%', s_acctbal / 100) AS pct, format('{:,}', CAST(abs(s_acctbal) * 1000 AS BIGINT)) AS grouped FROM supplier")
def format_numbers(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", F.concat(tx.one_decimal(F.col("s_acctbal") / 100), F.lit("%")).alias("pct"), F.format_number((F.rint(F.abs("s_acctbal") * 1000)).cast("bigint"), 0).alias("grouped"))


@register("placeholders", "SELECT k, regexp_extract_all(s, '\\{\\{([A-Z_]+)\\}\\}', 1) AS open FROM (VALUES (1, 'a {{N_AREAS}} and {{PEOPLE}}'), (2, 'done')) v(k, s)")
def placeholders(spark, d):
    df = spark.createDataFrame([(1, "a {{N_AREAS}} and {{PEOPLE}}"), (2, "done")], "k int, s string")
    return df.select("k", F.regexp_extract_all("s", F.lit(r"\{\{([A-Z_]+)\}\}"), F.lit(1)).alias("open"))


#: (rule, hard, pattern): what must not be in files that are published.
RULES = [("email", True, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("secret", True, r"(?i)(password|secret|token|api_?key)\s*[:=]"), ("address", False, r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"), ("license", False, r"(?i)licen[sc]e")]


@register("hygiene_scan", f"SELECT rule, hard, doc_id FROM documents, {_values(RULES, 'rule, hard, pattern')} WHERE regexp_matches(text, pattern)")
def hygiene_scan(spark, d):
    """A rule table over texts: the rules that hit are collected within the row, no join with the rules."""
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(h).alias("hard"))) for r, h, p in RULES)), lambda x: x.isNotNull())
    return t(spark, d, "documents").select("doc_id", F.explode(hits).alias("h")).select("h.rule", "h.hard", "doc_id")


@register("explode_flags", "SELECT trim(w) AS flag, COUNT(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def explode_flags(spark, d):
    return t(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("w")).groupBy(F.trim("w").alias("flag")).agg(F.count("*").alias("n"))


# --- reports matched to points -------------------------------------------------------------------------------------


def reports(spark, d):
    """Orders as events, with a text that names a county road; suppliers as crossings on such roads."""
    o = t(spark, d, "orders")
    road = F.concat(F.lit("CR "), (F.col("o_custkey") % 40).cast("string"))
    text = F.concat(F.lit("A car was swept off "), road, F.lit(" at the crossing. "), _phrase(F.col("o_orderkey")))
    xy = lambda m: (F.col("o_orderkey") % m * 970.0)
    return o.select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 5).cast("string").alias("county"), text.alias("event_text"), F.lit("").alias("episode_text"), xy(101).alias("begin_x"), xy(103).alias("begin_y"), xy(101).alias("end_x"), (xy(103) + 50).alias("end_y"), (F.col("o_orderkey") % 4 != 0).alias("coords_ok"), F.lit(0).alias("vehicle_deaths"))


def crossings(spark, d):
    s = t(spark, d, "supplier")
    road = F.concat(F.lit("County Road "), (F.col("s_suppkey") % 40).cast("string"))
    none = F.lit(None).cast("string")
    return s.select(F.col("s_suppkey").cast("string").alias("crossing_id"), (F.col("s_suppkey") % 5).cast("string").alias("county"), road.alias("road"), none.alias("seg_name"), none.alias("seg_refs"), F.lit("C").alias("tier"), none.alias("stream"), (F.col("s_suppkey") % 101 * 970.0).alias("x"), (F.col("s_suppkey") % 103 * 970.0).alias("y"))


@register("report_matches")
def report_matches(spark, d):
    return matcher.match(reports(spark, d), crossings(spark, d))


@register("report_hits", "SELECT o_orderkey AS event_id, CAST(s_suppkey AS VARCHAR) AS crossing_id FROM orders JOIN supplier ON o_custkey % 5 = s_suppkey % 5 AND o_custkey % 40 = s_suppkey % 40 UNION SELECT o_orderkey, CAST(s_suppkey AS VARCHAR) FROM orders JOIN supplier ON o_custkey % 5 = s_suppkey % 5 AND o_orderkey % 8 = 1 AND s_suppkey % 40 = 12")
def report_hits(spark, d):
    """Text to crossing by equi-join on (county, road key)."""
    sent = matcher.sentence_table(reports(spark, d))
    return matcher.hit_pairs(sent, matcher.alias_index(crossings(spark, d)))


@register("report_counties", "SELECT n_nationkey AS county, COUNT(o_orderkey) AS events, COUNT(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS deaths, round(COUNT(o_orderkey) FILTER (o_orderpriority = '1-URGENT')::DOUBLE / NULLIF(COUNT(o_orderkey), 0), 6) AS share FROM nation LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey % 25 = n_nationkey GROUP BY 1")
def report_counties(spark, d):
    """Every county of the list, those without events too."""
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    e = t(spark, d, "orders").where("o_orderstatus = 'P'").groupBy((F.col("o_custkey") % 25).alias("county")).agg(F.count("*").alias("events"), urgent.alias("deaths"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("county")).join(e, "county", "left").fillna(0)
    return n.select("county", "events", "deaths", F.round(F.try_divide("deaths", "events"), 6).alias("share"))


@register("event_scope", "SELECT o_orderkey, COALESCE(n_name, 'unresolved') AS county FROM orders LEFT JOIN nation ON n_nationkey = CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_custkey % 25 WHEN o_orderpriority = '3-MEDIUM' THEN o_custkey % 40 END WHERE date_part('year', o_orderdate) BETWEEN 1993 AND 1996")
def event_scope(spark, d):
    """Events of a period with their county by code, else by zone; those with neither are marked."""
    code = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_custkey") % 25).when(F.col("o_orderpriority") == "3-MEDIUM", F.col("o_custkey") % 40)
    o = t(spark, d, "orders").where(F.year("o_orderdate").between(1993, 1996)).withColumn("code", code)
    return o.join(t(spark, d, "nation"), F.col("code") == F.col("n_nationkey"), "left").select("o_orderkey", F.coalesce("n_name", F.lit("unresolved")).alias("county"))


@register("fatality_counts", "SELECT o_orderkey AS event_id, COUNT(l_orderkey) AS rows_all, COUNT(*) FILTER (l_returnflag = 'R') AS rows_vehicle, COUNT(*) FILTER (l_returnflag = 'A') AS rows_water FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30 GROUP BY 1")
def fatality_counts(spark, d):
    f = t(spark, d, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count("*").alias("rows_all"), F.count_if(F.col("l_returnflag") == "R").alias("rows_vehicle"), F.count_if(F.col("l_returnflag") == "A").alias("rows_water"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")).join(f, "event_id", "left").fillna(0)
