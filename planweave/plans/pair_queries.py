"""Registered queries over project pairs, and the SQL that checks them without a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corridor, dates, geo, owners
from ..operators import pairs
from .fixtures import AS_OF, NAMES, PROJECTS_SQL, projects, registry


def coordination(spark: SparkSession, sf_dir: str, *facts: str, values: tuple[str, ...] | None = None) -> DataFrame:
    """All qualifying pairs, with these facts of each side, and these values or all."""
    return pairs.overlaps(projects(spark, sf_dir), AS_OF, registry=registry(spark, sf_dir), facts=facts, values=values)


def coordination_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ("pair_id", "a_id", "b_id", "miles", "band", "tier", "overlap_days", "ratio", "gap_days", "window_start", "window_end", "composite", "indeterminate")
    found = pairs.ranked(coordination(spark, sf_dir, values=values))
    return found.select("pair_id", "a_id", "b_id", "miles", "band", "tier", "overlap_days", F.round("ratio", 4).alias("ratio"), "gap_days", "window_start", "window_end", F.round("composite", 6).alias("composite"), "indeterminate")


def distance_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.candidate_pairs(projects(spark, sf_dir).select("id", "utility", *pairs.SHAPE), wanted=("id",)).select("a_id", "b_id", F.round("metres", 3).alias("metres"))


def shared_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres that two routes at most 1,600 m apart share in a strip of that width."""
    found = pairs.candidate_pairs(projects(spark, sf_dir).where("routed"), corridor.STRIP_M, wanted=("id", *pairs.SHAPE))
    for stage in corridor.shared_km("a", "b"):
        found = found.withColumns({k: F.expr(v) for k, v in stage.items()})
    return found.select("a_id", "b_id", F.round("shared_km", 2).alias("shared_km"))


def pair_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination(spark, sf_dir, values=("pair_id", "total_low", "total_high", "if_aligned_low", "if_aligned_high"))


def pair_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.briefs import brief

    values = ("pair_id", "miles", "tier", "ratio", "window_start", "window_end", "total_low", "total_high")
    return coordination(spark, sf_dir, "company", "type", "voltage_kv", values=values).select("pair_id", brief().alias("brief"))


def best_pair_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.best_pairs(projects(spark, sf_dir), AS_OF, registry=registry(spark, sf_dir))


def pairs_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides among the named companies: filtered before the join."""
    wanted = [x.lower() for x in ("Georgia Power", "FPL", "TVA", "JEA")]
    own = projects(spark, sf_dir).where(F.lower(F.trim("utility")).isin(wanted))
    return pairs.candidate_pairs(own, wanted=("id", "utility")).select("a_id", "b_id", "a_utility", "b_utility", F.round(F.col("metres") / geo.METERS_PER_MILE, 3).alias("miles"))


def pair_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterparts of one company by number of pairs: its projects joined with all."""
    is_it = lambda company: F.array_contains(F.split(company, " / "), "Georgia Power")
    every = projects(spark, sf_dir)
    names = owners.once(every.select("utility").distinct(), "company", owners.canonical_utility(F.col("utility"))).where(is_it("company")).select("utility")
    found = pairs.overlaps(every, AS_OF, changed=every.join(names, "utility", "left_semi").select("id"), registry=registry(spark, sf_dir), facts=("company",), values=())
    own = found.select(F.explode(F.array(F.struct(F.col("a_company").alias("me"), F.col("b_company").alias("other")), F.struct(F.col("b_company").alias("me"), F.col("a_company").alias("other")))).alias("x"))
    return own.where(is_it("x.me")).groupBy(F.col("x.other").alias("partner")).agg(F.count("*").alias("n_pairs"))


def pairs_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a side that begins in a box: the projects there joined with all."""
    from ..operators import views

    inside = F.col("lat1").between(30, 36) & F.col("lng1").between(-95, -85)
    return views.pairs_touching(projects(spark, sf_dir), AS_OF, inside, registry(spark, sf_dir), facts=(), values=("pair_id", "miles")).select("pair_id", "miles")


def pair_counts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = coordination(spark, sf_dir, "state", values=("tier",)).select("tier", F.explode(F.array_distinct(F.array("a_state", "b_state"))).alias("state"))
    return sides.groupBy("state", "tier").agg(F.count("*").alias("n_pairs"))


def build_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.with_windows(projects(spark, sf_dir)).select("id", "build_start", "build_end", (F.col("build_end") < F.lit(AS_OF).cast("date")).alias("past"))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = projects(spark, sf_dir).withColumn("company", owners.canonical_utility(F.col("utility")))
    return named.groupBy("utility", "company").agg(F.count("*").alias("n"))


def company_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which companies with projects in one state may be matched: over distinct names of each state only."""
    own = projects(spark, sf_dir).where("state IS NOT NULL").select("state", "utility").distinct()
    full = pairs.with_owners(own, registry(spark, sf_dir), AS_OF)
    a, b = pairs.prefixed(full, "a"), pairs.prefixed(full, "b")
    both = a.join(b, (F.col("a_state") == F.col("b_state")) & (F.col("a_utility") < F.col("b_utility")))
    return both.select(F.col("a_state").alias("state"), "a_utility", "b_utility", owners.different_companies("a", "b").alias("eligible"))


def company_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups keep company names from being matched, over all names of the projects, whatever their states."""
    names = projects(spark, sf_dir).select("utility").distinct()
    return pairs.company_groups(pairs.with_owners(names, registry(spark, sf_dir), AS_OF))


def ownership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each company name of the projects says of its owners, today and while former audits held, and whom it plans with."""
    names = projects(spark, sf_dir).groupBy("utility").agg(F.count("*").alias("n"))
    now, then = (pairs.with_owners(names, registry(spark, sf_dir), day) for day in (AS_OF, "2005-06-01"))
    flags = lambda d, p: d.select("utility", F.array_join("entities", ",").alias(f"{p}_entities"), F.col("needs_review").alias(f"{p}_review"), F.col("withheld").alias(f"{p}_withheld"))
    own = flags(now, "now").join(flags(then, "then"), "utility").join(names, "utility")
    return own.withColumn("plans_with", owners.planning_entity(owners.canonical_utility(F.col("utility"))))


def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in eleven spellings, and read back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    y, q = F.year("d").cast("string"), F.quarter("d").cast("string")
    forms = [
        F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "M/d/yyyy"), F.date_format("d", "yyyy-MM"), F.date_format("d", "M/yyyy"), F.concat(F.lit("Q"), q, F.lit(" "), y), F.concat(y, F.lit(" Q"), q),
        F.concat(q, F.lit("Q "), y), F.concat(F.lit("FY "), y), F.date_format("d", "MMMM yyyy"), F.date_format("d", "MMM d, yyyy"), F.date_format("d", "d MMMM yyyy"), F.lit("2027-02-30"), F.lit("to be set"),
    ]
    text = F.element_at(F.array(*forms), (F.col("k") % len(forms) + 1).cast("int"))
    date, precision = dates.parse_partial_date(text)
    return o.select("k", date.alias("first_day"), precision.alias("precision"))


#: Canonical name, entities and family stem of each name of the fixture, written by hand.
COMPANIES = [
    ("FPL", "Florida Power & Light", "nextera energy", False, "florida,light"), ("Florida Power and Light Co.", "Florida Power & Light", "nextera energy", False, "florida,light"), ("Gulf Power", "Florida Power & Light", "nextera energy", False, "florida,light"),
    ("Georgia Power", "Georgia Power", "southern company", False, "georgia"), ("georgia power co.", "Georgia Power", "southern company", False, "georgia"), ("Southern Company", "Southern Company", "southern company", False, "southern"), ("Alabama Power", "Alabama Power", "southern company", False, "alabama"),
    ("DESC", "Dominion Energy South Carolina", "dominion energy", False, "dominion"), ("Dominion Energy South Carolina", "Dominion Energy South Carolina", "dominion energy", False, "dominion"), ("SCANA Corporation", "SCANA", "dominion energy", False, "scana"),
    ("DEF/SEC", "Duke Energy Florida / Seminole Electric Cooperative", "duke energy,seminole electric cooperative", False, "duke"), ("DEF-SEC", "Duke Energy Florida / Seminole Electric Cooperative", "duke energy,seminole electric cooperative", False, "duke"),
    ("Duke Energy Florida, LLC", "Duke Energy Florida", "duke energy", False, "duke"), ("Duke Energy Progress - (SC)", "Duke Energy Progress", "duke energy", False, "duke"), ("JEA", "JEA", "jea", False, "jea"), ("TVA", "TVA", "tva", False, "tva"), ("Tennessee Valley Authority", "TVA", "tva", False, "tva"),
    ("FRP Miller Solar", "FRP Miller Solar", "nextera energy", False, "frp"), ("Atlas Solar IV", "Atlas Solar IV", "atlas solar iv", True, "atlas"), ("Atlas BESS IV", "Atlas BESS IV", "atlas bess iv", True, "atlas"), ("Big Creek Solar", "Big Creek Solar", "big creek solar", True, "big creek"), ("Big Sky Wind", "Big Sky Wind", "big sky wind", True, "big sky"),
    ("UNKNOWN", None, None, True, None), ("Seminole Electric Cooperative, Inc.", "Seminole Electric Cooperative", "seminole electric cooperative", False, "seminole"),
]
assert [c[0] for c in COMPANIES] == NAMES
_quoted = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
COMPANIES_SQL = "companies(utility, company, entities, needs_review, family) AS (VALUES " + ", ".join("(" + ", ".join(map(_quoted, c)) + ")" for c in COMPANIES) + ")"

_point = lambda s, i: (f"(({s}.lng{i}-a.lng1)*kx)", f"(({s}.lat{i}-a.lat1)*ky)")


def _to_segment(p: tuple, a: tuple, b: tuple) -> str:
    dx, dy = f"({b[0]}-{a[0]})", f"({b[1]}-{a[1]})"
    size = f"({dx}*{dx}+{dy}*{dy})"
    t = f"(CASE WHEN {size}>0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({p[0]}-{a[0]})*{dx}+({p[1]}-{a[1]})*{dy})/{size})) ELSE 0 END)"
    return f"sqrt(pow({p[0]}-{a[0]}-{t}*{dx},2)+pow({p[1]}-{a[1]}-{t}*{dy},2))"


def _cross(a: tuple, b: tuple, c: tuple) -> str:
    return f"(({b[0]}-{a[0]})*({c[1]}-{a[1]})-({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


_a1, _a2, _b1, _b2 = _point("a", 1), _point("a", 2), _point("b", 1), _point("b", 2)
_METRES = f"""CASE WHEN {_cross(_a1, _a2, _b1)}*{_cross(_a1, _a2, _b2)}<0 AND {_cross(_b1, _b2, _a1)}*{_cross(_b1, _b2, _a2)}<0 THEN 0.0
  ELSE least({_to_segment(_a1, _b1, _b2)}, {_to_segment(_a2, _b1, _b2)}, {_to_segment(_b1, _a1, _a2)}, {_to_segment(_b2, _a1, _a2)}) END"""
_END = "CASE {p} WHEN 'year' THEN date_trunc('year',{d})+INTERVAL 12 MONTH-INTERVAL 1 DAY WHEN 'quarter' THEN date_trunc('quarter',{d})+INTERVAL 3 MONTH-INTERVAL 1 DAY WHEN 'month' THEN date_trunc('month',{d})+INTERVAL 1 MONTH-INTERVAL 1 DAY ELSE {d} END::DATE"
_START = "(CASE {p} WHEN 'year' THEN date_trunc('year',{d}) WHEN 'quarter' THEN date_trunc('quarter',{d}) WHEN 'month' THEN date_trunc('month',{d}) ELSE {d} END)::DATE"

WINDOWS_SQL = f"""
windowed AS (SELECT *, CASE WHEN start_date < end_date THEN {_START.format(d='start_date', p='start_precision')} ELSE ({_START.format(d='end_date', p='end_precision')} - INTERVAL 12 MONTH)::DATE END AS build_start,
  ({_END.format(d='end_date', p='end_precision')}) AS build_end FROM projects)
"""
#: Pairs of rows of ``{rows}`` by boxes and distance alone.
_JOIN = f"""
boxed AS (SELECT *, least(lat1,lat2)-0.37 AS s, greatest(lat1,lat2)+0.37 AS n, least(lng1,lng2)-0.6 AS w, greatest(lng1,lng2)+0.6 AS e FROM {{rows}} WHERE lat1 IS NOT NULL),
near AS (SELECT a.id AS a_id, b.id AS b_id, radians((a.lat1+a.lat2+b.lat1+b.lat2)/4) AS phi FROM boxed a JOIN boxed b
  ON a.id<b.id AND a.s<=greatest(b.lat1,b.lat2) AND a.n>=least(b.lat1,b.lat2) AND a.w<=greatest(b.lng1,b.lng2) AND a.e>=least(b.lng1,b.lng2) AND lower(trim(a.utility))<>lower(trim(b.utility))),
scaled AS (SELECT *, 111132.954-559.822*cos(2*phi)+1.175*cos(4*phi) AS ky, 111412.84*cos(phi)-93.5*cos(3*phi)+0.118*cos(5*phi) AS kx FROM near),
pairs AS (SELECT * FROM (SELECT a_id, b_id, {_METRES} AS metres FROM scaled JOIN boxed a ON a.id=a_id JOIN boxed b ON b.id=b_id) WHERE metres<=25*1609.344)
"""
_SHARED, _names = "", []
for _i, _stage in enumerate(corridor.shared_km("a", "b")):
    _SHARED += f", c{_i + 1} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _stage.items()) + f" FROM c{_i})"
    _names.append(f"c{_i + 1}")

_LAND = "c0 AS (SELECT pair_id, a_kv, b_kv, " + ", ".join(f"{x}.{c} AS {x}_{c}" for x in "ab" for c in ("lat1", "lng1", "lat2", "lng2")) + " FROM coord JOIN ahead a ON a.id=a_id JOIN ahead b ON b.id=b_id WHERE a.routed AND b.routed AND tier<=1)" + _SHARED
#: Widths of a right of way by kilovolts, as the survey lists them.
_WIDTH = "(CASE WHEN {kv} IS NULL OR {kv}=0 THEN 30.0 WHEN {kv}<=69 THEN 23.0 WHEN {kv}<=138 THEN 30.0 WHEN {kv}<=230 THEN 38.0 WHEN {kv}<=345 THEN 46.0 ELSE 61.0 END)"
_FACTS = f"""
ahead AS (SELECT windowed.*, company, entities, needs_review, family FROM windowed JOIN companies USING (utility) WHERE build_end >= DATE '{AS_OF}'),
{_JOIN.format(rows="ahead")},
joined AS (SELECT pairs.*, a.utility AS a_utility, b.utility AS b_utility, a.company AS a_company, b.company AS b_company, a.state AS a_state, b.state AS b_state, a.type AS a_type, b.type AS b_type, a.voltage_kv AS a_kv, b.voltage_kv AS b_kv, a.cost_usd AS a_cost, b.cost_usd AS b_cost, a.end_date AS a_end, b.end_date AS b_end,
  a.lat1 AS a_lat1, a.lng1 AS a_lng1, b.lat1 AS b_lat1, b.lng1 AS b_lng1, greatest(a.build_start,b.build_start) AS window_start, least(a.build_end,b.build_end) AS window_end, abs(a.build_end-b.build_end) AS gap_days, (a.build_end-a.build_start+1)+(b.build_end-b.build_start+1) AS both_days
  FROM pairs JOIN ahead a ON a.id=a_id JOIN ahead b ON b.id=b_id
  WHERE a.company IS NOT NULL AND b.company IS NOT NULL AND NOT list_has_any(string_split(a.entities,','),string_split(b.entities,',')) AND (NOT (a.needs_review OR b.needs_review) OR a.family<>b.family)),
timed AS (SELECT *, window_end-window_start+1 AS overlap_days, (window_end-window_start+1)/CAST(both_days-(window_end-window_start+1) AS DOUBLE) AS ratio, metres/1609.344 AS exact_miles FROM joined WHERE window_start<=window_end AND window_end-greatest(window_start, DATE '{AS_OF}')+1>=30),
coord AS (SELECT *, a_id||'-'||b_id AS pair_id, round(exact_miles,3) AS miles, CASE WHEN metres<=1 THEN 'touching' WHEN metres<1600 THEN 'under_1_6' WHEN metres<8000 THEN 'under_8' WHEN metres<25000 THEN 'under_25' WHEN metres<40000 THEN 'under_40' END AS band,
  CASE WHEN metres<=1 THEN 0 WHEN metres<1600 THEN 1 WHEN metres<8000 THEN 2 WHEN metres<40000 THEN 3 ELSE 4 END AS tier,
  0.55*greatest(0,least(1,1-exact_miles/25))+0.3*ratio+0.075*coalesce((a_type=b_type)::INT,0)+0.075*(CASE WHEN a_kv>0 AND b_kv>0 THEN greatest(0,least(1,1-abs(a_kv-b_kv)/CAST(500 AS DOUBLE))) ELSE 0 END) AS composite,
  concat_ws(',', CASE WHEN a_type IS NULL OR b_type IS NULL THEN 'type_similarity' END, CASE WHEN a_kv IS NULL OR b_kv IS NULL THEN 'voltage_similarity' END) AS indeterminate, least(a_cost, b_cost) AS cost FROM timed),
{_LAND},
land AS (SELECT pair_id, round(shared_km,2)*1000*least({_WIDTH.format(kv='a_kv')},{_WIDTH.format(kv='b_kv')})*0.5/4046.86 AS acres FROM {_names[-1]} WHERE shared_km > 0),
coordinated AS (SELECT coord.*, (coalesce(round_even(cost*0.01,0),150000)+CASE WHEN tier<=2 THEN 100000 ELSE 0 END+CASE WHEN tier=0 THEN 50000 ELSE 0 END+CASE WHEN tier<=1 THEN 50000 ELSE 0 END+coalesce(round_even(acres*5000,0),0))::BIGINT AS low,
  (coalesce(round_even(cost*0.03,0),400000)+CASE WHEN tier<=2 THEN 300000 ELSE 0 END+CASE WHEN tier=0 THEN 250000 ELSE 0 END+CASE WHEN tier<=1 THEN 200000 ELSE 0 END+coalesce(round_even(acres*20000,0),0))::BIGINT AS high FROM coord LEFT JOIN land USING (pair_id))
"""
COORD = f"WITH {PROJECTS_SQL}, {COMPANIES_SQL}, {WINDOWS_SQL}, {_FACTS} "
_USD = lambda c: f"(CASE WHEN {c}>=1000000 THEN printf('$%.1fM', floor({c}/100000.0+0.5)/10) ELSE '$'||CAST(round_even({c}/1000.0,0) AS BIGINT)||'k' END)"


def _describe(s: str) -> str:
    return f"(CASE WHEN {s}_kv IS NULL THEN '' ELSE {s}_kv||' kV ' END||coalesce({s}_type,'project (type unknown)'))"


_DAY = lambda c: f"(strftime({c},'%b ')||day({c})||', '||year({c}))"
BRIEF_SQL = f"""a_company||'''s '||{_describe('a')}||' and '||b_company||'''s '||{_describe('b')}||' are '||printf('%.1f', floor(miles*10+0.5)/10)||' miles apart ('||CAST(round_even(round(ratio,4)*100,0) AS BIGINT)||'% overlapping build windows, shared '||{_DAY('window_start')}||' – '||{_DAY('window_end')}||'). '||
  CASE tier WHEN 0 THEN 'They touch: one outage window and one crossing design would serve both.' WHEN 1 THEN 'Right-of-way, access roads and one permit package could be shared.' WHEN 2 THEN 'A laydown yard and deliveries could be shared.' ELSE 'Line crews, cranes and contractors could be shared.' END||
  CASE WHEN tier<=3 THEN ' A rough value is '||{_USD('low')}||'–'||{_USD('high')}||'.' ELSE '' END"""

SQL = {
    "shared_corridors": f"WITH {PROJECTS_SQL}, routes AS (SELECT * FROM projects WHERE routed), {_JOIN.format(rows='routes')}, c0 AS (SELECT a_id, b_id, " + ", ".join(f"{x}.{c} AS {x}_{c}" for x in "ab" for c in ("lat1", "lng1", "lat2", "lng2")) + f" FROM pairs JOIN routes a ON a.id=a_id JOIN routes b ON b.id=b_id WHERE metres<=1600){_SHARED} SELECT a_id, b_id, round(shared_km,2) AS shared_km FROM {_names[-1]}",
    "coordination_pairs": COORD + "SELECT pair_id, a_id, b_id, miles, band, tier, overlap_days, round(ratio,4) AS ratio, gap_days, window_start, window_end, round(composite,6) AS composite, indeterminate FROM coordinated",
    "distance_self_join": f"WITH {PROJECTS_SQL}, {_JOIN.format(rows='projects')} SELECT a_id, b_id, round(metres,3) AS metres FROM pairs",
    "pair_impacts": COORD + "SELECT pair_id, CASE WHEN tier<=3 THEN low END AS total_low, CASE WHEN tier<=3 THEN high END AS total_high, CASE WHEN tier<=3 THEN low END AS if_aligned_low, CASE WHEN tier<=3 THEN high END AS if_aligned_high FROM coordinated",
    "pair_briefs": COORD + f"SELECT pair_id, {BRIEF_SQL} AS brief FROM coordinated",
    "best_pair_per_project": COORD + "SELECT id, pair_id, tier FROM (SELECT id, pair_id, tier, row_number() OVER (PARTITION BY id ORDER BY tier, composite DESC, miles, a_id, b_id) AS r FROM (SELECT a_id AS id, * FROM coordinated UNION ALL SELECT b_id AS id, * FROM coordinated)) WHERE r=1",
    "pairs_between": f"WITH {PROJECTS_SQL}, {_JOIN.format(rows='projects')} SELECT a_id, b_id, a.utility AS a_utility, b.utility AS b_utility, round(metres/1609.344,3) AS miles FROM pairs JOIN projects a ON a.id=a_id JOIN projects b ON b.id=b_id WHERE lower(trim(a.utility)) IN ('georgia power','fpl','tva','jea') AND lower(trim(b.utility)) IN ('georgia power','fpl','tva','jea')",
    "pair_partners": COORD + "SELECT other AS partner, count(*) AS n_pairs FROM (SELECT a_company AS me, b_company AS other FROM coordinated UNION ALL SELECT b_company, a_company FROM coordinated) WHERE list_contains(string_split(me,' / '),'Georgia Power') GROUP BY other",
    "pairs_in_view": COORD + "SELECT pair_id, miles FROM coordinated WHERE (a_lat1 BETWEEN 30 AND 36 AND a_lng1 BETWEEN -95 AND -85) OR (b_lat1 BETWEEN 30 AND 36 AND b_lng1 BETWEEN -95 AND -85)",
    "pair_counts_by_state": COORD + "SELECT state, tier, count(*) AS n_pairs FROM (SELECT a_state AS state, tier FROM coordinated UNION ALL SELECT b_state, tier FROM coordinated WHERE b_state IS DISTINCT FROM a_state) GROUP BY state, tier",
    "build_windows": f"WITH {PROJECTS_SQL}, {WINDOWS_SQL} SELECT id, build_start, build_end, build_end < DATE '{AS_OF}' AS past FROM windowed",
    "company_names": f"WITH {PROJECTS_SQL}, {COMPANIES_SQL} SELECT utility, company, count(*) AS n FROM projects JOIN companies USING (utility) GROUP BY ALL",
    "company_eligibility": f"""WITH {PROJECTS_SQL}, {COMPANIES_SQL}, u AS (SELECT DISTINCT state, companies.* FROM companies JOIN projects USING (utility) WHERE state IS NOT NULL)
      SELECT a.state, a.utility AS a_utility, b.utility AS b_utility, a.company IS NOT NULL AND b.company IS NOT NULL AND NOT list_has_any(string_split(coalesce(a.entities,'-a'),','),string_split(coalesce(b.entities,'-b'),',')) AND (NOT (a.needs_review OR b.needs_review) OR coalesce(a.family<>b.family,false)) AS eligible FROM u a JOIN u b ON a.state=b.state AND a.utility<b.utility""",
    "company_groups": f"""WITH {PROJECTS_SQL}, {COMPANIES_SQL}, u AS (SELECT DISTINCT companies.* FROM companies JOIN projects USING (utility)),
      g AS (SELECT utility, 'none' AS kind, '' AS key, needs_review FROM u WHERE company IS NULL
        UNION ALL SELECT utility, 'entity', unnest(string_split(entities,',')), needs_review FROM u WHERE company IS NOT NULL
        UNION ALL SELECT utility, CASE WHEN family LIKE 'big %' THEN 'stem' ELSE 'family' END, split_part(family,',',1), needs_review FROM u WHERE company IS NOT NULL)
      SELECT utility, kind, key, needs_review, count(*) OVER (PARTITION BY kind, key) AS n_names FROM g""",
    "ownership_flags": f"""WITH {PROJECTS_SQL}, {COMPANIES_SQL}, n AS (SELECT utility, count(*) AS n FROM projects GROUP BY 1),
      r AS (SELECT list_extract({NAMES!r}, CAST(n_nationkey+1 AS INT)) AS utility, n_nationkey%2=0 AS verified FROM nation WHERE n_nationkey<24),
      f AS (SELECT owner, max(CASE WHEN verified THEN 'former holdings' END) AS g FROM (SELECT unnest(string_split(company,' / ')) AS owner, company, verified FROM r JOIN companies USING (utility) WHERE company IS NOT NULL AND company NOT LIKE '% / %') GROUP BY 1),
      t AS (SELECT utility, company, unnest(string_split(company,' / ')) AS owner FROM companies),
      o AS (SELECT t.utility, t.owner, f.owner IS NOT NULL AS audited, f.g, CASE t.owner WHEN 'Duke Energy Florida' THEN 'duke energy' WHEN 'Seminole Electric Cooperative' THEN NULL END AS family FROM t LEFT JOIN f USING (owner)),
      p AS (SELECT utility, array_to_string(list_sort(list_distinct(list(lower(coalesce(CASE WHEN audited THEN g ELSE family END, owner))))),',') AS e, bool_or(CASE WHEN audited THEN g IS NULL ELSE family IS NULL END) AS review, bool_or(audited AND g IS NULL) AS held FROM o GROUP BY 1)
      SELECT utility, n, coalesce(entities,'') AS now_entities, needs_review AS now_review, false AS now_withheld, coalesce(p.e,'') AS then_entities, coalesce(p.review,true) AS then_review, coalesce(p.held,false) AS then_withheld,
        CASE WHEN company IN ('Southern Company','Georgia Power','Alabama Power') THEN 'southern company' ELSE lower(company) END AS plans_with FROM n JOIN companies USING (utility) LEFT JOIN p USING (utility)""",
    "partial_dates": """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey%13 AS f FROM orders)
      SELECT k, (CASE WHEN f IN (0,1,9,10) THEN d WHEN f IN (2,3,8) THEN date_trunc('month',d) WHEN f IN (4,5,6) THEN date_trunc('quarter',d) WHEN f=7 THEN date_trunc('year',d) END)::DATE AS first_day,
        CASE WHEN f IN (0,1,9,10) THEN 'day' WHEN f IN (2,3,8) THEN 'month' WHEN f IN (4,5,6) THEN 'quarter' WHEN f=7 THEN 'year' END AS precision FROM o""",
}

QUERIES = {
    f.__name__: f
    for f in (coordination_pairs, distance_self_join, shared_corridors, pair_impacts, pair_briefs, best_pair_per_project, pairs_between, pair_partners, pairs_in_view, pair_counts_by_state, build_windows, company_names, company_eligibility, company_groups, ownership_flags, partial_dates)
}
