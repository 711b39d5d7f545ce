"""Registered queries over single tables: search, facets, lines, generators, pages, edits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import maintenance, pairs, search, similar
from ..sources import pages
from .fixtures import AS_OF, NAMES, PLACES, PROJECTS_SQL, pick, projects, registry, table
from .pair_queries import COMPANIES_SQL, WINDOWS_SQL

WITH = f"WITH {PROJECTS_SQL} "


def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = search.filter_projects(projects(spark, sf_dir), states=["GA", "FL"], types=["substation", "generation"], terms=["jasper"])
    return own.select("id", "utility", "state", "name")


def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = search.near(projects(spark, sf_dir), 33.5, -84.4, 100)
    return own.select("id", F.round("miles", 3).alias("miles"))


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like a misspelt place: similarity is worked out once per distinct name."""
    names = projects(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    hits = similar.word_similarity_join(spark.createDataFrame([(1, "valdost thomasvile")], "id int, q string"), names)
    return hits.join(names, "name").select("name", "n", F.round("similarity", 6).alias("similarity"))


def misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query a customer: two places, one with a letter lost, some with a word that nothing bears."""
    c = F.col("c_custkey")
    short = lambda p, i: F.concat(F.substring(p, F.lit(1), i), F.substr(p, i + 2))
    first = short(F.lower(pick(PLACES, c % 16)), (2 + c % 3).cast("int"))
    rest = F.when(c % 7 == 0, F.lit("Solar")).when(c % 5 == 0, F.lit("")).otherwise(pick(PLACES, (c * 3 + c / 16).cast("long") % 16))
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.trim(F.concat(first, F.lit(" "), rest)).alias("q"))


def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every misspelt query with the names of projects and parts that are similar to it."""
    names = projects(spark, sf_dir).select("name").union(projects(spark, sf_dir).select("location_ref")).union(table(spark, sf_dir, "part").select("p_name"))
    return similar.word_similarity_join(misspelt(spark, sf_dir), names).select("id", "name", F.round("similarity", 6).alias("similarity"))


def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(projects(spark, sf_dir).where(F.col("voltage_kv") >= 115))


def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = search.summary(projects(spark, sf_dir).where(search.in_states(["GA"])))
    return own.select("total", "first_date", "last_date", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lng", "max_lng")])


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty results in search order: a top-k report."""
    own = projects(spark, sf_dir).where(F.col("type") == "substation")
    return own.orderBy("utility", F.col("name").asc_nulls_last(), "id").limit(50).select("id", "utility", "name")


def utility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir).groupBy("utility").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("source_key"))).alias("n_sources"))


def current_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated projects and those whose last day is not past."""
    own = pairs.with_windows(projects(spark, sf_dir))
    return own.where(F.coalesce(F.col("build_end") >= F.lit(AS_OF).cast("date"), F.lit(True))).select("id", "utility", "build_end")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.review_queue(projects(spark, sf_dir)).select("id", "confidence", "requires_review")


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the suppliers' sites, laid over the map by arithmetic, to each placed project."""
    s = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), s.cast("string")).alias("name"), (25 + (s * 7919 % 1009) / F.lit(1009.0) * 20).alias("p_lat"), (-120 + (s * 104729 % 2003) / F.lit(2003.0) * 45).alias("p_lng"))
    points = projects(spark, sf_dir).where(F.col("lat").isNotNull()).select("id", "lat", "lng")
    return search.nearest(points, places).select("id", "place", F.round("metres", 3).alias("metres"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    at = lambda m, i: ((p * m + i * 37) % 1013) / F.lit(1013.0)
    vertices = F.array(*[F.struct((-100 + at(7919, 0) * 20 + i * at(31, i)).alias("lng"), (28 + at(104729, 0) * 12 + i * at(53, i) / 2).alias("lat")) for i in range(3)])
    kv = F.when(F.col("p_size") % 7 == 0, -999999).otherwise(pick([69, 115, 138, 230, 345, 500, 765], p % 7))
    raw = table(spark, sf_dir, "part").select(p.alias("id"), pick(NAMES, F.col("p_size") % 24).alias("owner"), kv.alias("kv"), vertices.alias("geom"))
    return raw.withColumns({"kv": F.when(F.col("kv") > 0, F.col("kv")), "owner_norm": F.nullif(F.upper(F.trim("owner")), F.lit("UNKNOWN"))})


def length_km() -> Column:
    steps = F.transform(F.sequence(F.lit(1), F.size("geom") - 1), lambda i: geo.point_distance(F.element_at("geom", i)["lat"], F.element_at("geom", i)["lng"], F.element_at("geom", i + 1)["lat"], F.element_at("geom", i + 1)["lng"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / 1000


def line_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).withColumn("km", length_km()).groupBy("owner_norm")
    return own.agg(F.count("*").alias("n_lines"), F.round(F.sum("km"), 1).alias("km"), F.min("kv").alias("min_kv"), F.max("kv").alias("max_kv"), F.array_join(F.array_sort(F.collect_set("owner")), "|").alias("names"))


def lines_by_voltage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.lit(None).cast("int")
    for least in (10, 25, 52, 132, 220, 310, 550):
        step = F.when(F.col("kv") >= least, least).otherwise(step)
    own = lines(spark, sf_dir).withColumns({"voltage_class": step, "km": length_km()})
    return own.groupBy("voltage_class").agg(F.count("*").alias("n_lines"), F.round(F.sum("km"), 1).alias("km"))


def line_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).where(F.col("kv") >= 230)
    of = lambda f, c: f(F.transform("geom", lambda v: v[c]))
    return own.agg(*[F.round(g(of(f, c)), 6).alias(f"{n}_{c}") for n, g, f in (("min", F.min, F.array_min), ("max", F.max, F.array_max)) for c in ("lat", "lng")])


def generator_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator rows to one project per plant and month: capacity, technologies, name."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plant"), F.col("l_quantity").alias("mw"), F.col("l_returnflag").alias("technology"), F.trunc("l_shipdate", "MONTH").alias("month"))
    own = g.groupBy("plant", "month").agg(F.round(F.sum("mw"), 1).alias("mw"), F.array_join(F.array_sort(F.collect_set("technology")), ", ").alias("technologies"), F.count("*").alias("n_units"))
    return own.withColumn("name", F.concat(F.lit("Plant "), F.col("plant").cast("string"), F.lit(" ("), "technologies", F.lit(", "), F.format_string("%.1f", "mw"), F.lit(" MW)")))


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order texts broken over two lines, the way tables wrap on a page."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc"), (F.col("o_orderkey") / 40).cast("long").alias("page"), F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderstatus")
    first = o.select("doc", "page", (F.col("k") * 2).alias("line"), F.concat(F.lit("#"), F.col("k").cast("string"), F.lit(" "), "o_orderstatus").alias("text"))
    rest = o.where(F.col("k") % 3 == 0).select("doc", "page", (F.col("k") * 2 + 1).alias("line"), F.concat(F.lit("  "), "o_orderpriority").alias("text"))
    return first.unionByName(rest)


def stitch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.stitch_wrapped_rows(wrapped(spark, sf_dir), r"^#\d+").select("doc", "text")


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_runs(projects(spark, sf_dir).select(F.col("utility").alias("doc"), F.col("source_page").alias("page")).where(F.col("page") % 7 < 4))


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc"), (F.col("o_orderkey") % 20).alias("page"), F.col("o_orderpriority").alias("text"))
    specs = own.select("doc").distinct().select("doc", F.concat((F.col("doc") % 9).cast("string"), F.lit("-"), (F.col("doc") % 9 + 4).cast("string"), F.lit(", 17")).alias("spec"))
    return pages.select_pages(own, specs).groupBy("doc", "page").agg(F.count("*").alias("n"), F.sum((F.col("text") != "").cast("int")).alias("n_kept"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer group as the pages of a document; each 37th holds fifty lines and is split."""
    k = F.col("o_orderkey")
    line = F.repeat(F.lit("x"), (100 + k % 50).cast("int"))
    text = F.when(k % 37 == 0, F.array_join(F.array_repeat(line, 50), "\n")).otherwise(F.repeat(F.lit("x"), (100 + k * 37 % 900).cast("int")))
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("doc"), k.alias("page"), text.alias("text"))
    return pages.chunk_pages(own, 4000).select("doc", "chunk", "first_page", "last_page", "n_chars", F.md5("body").alias("body_md5"))


def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of pages, one a customer, read and put in order; some are wrong."""
    c = F.col("c_custkey")
    forms = ["5-9, 2, 3", "1 - 4,4-6 , 9", "7", "", "x", "3-1", "8-{}", "2,2"]
    spec = F.replace(pick(forms, c % len(forms)), F.lit("{}"), (c % 20 + 5).cast("string"))
    own = table(spark, sf_dir, "customer")
    return pages.page_specs(own.select(c.alias("doc"), spec.alias("spec")), own.select(c.alias("doc"), F.lit(12).alias("n"))).select("doc", "normal", "error")


def split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of projects set as words with one wide gap, and split there."""
    words = projects(spark, sf_dir).select(F.col("id").alias("row"), F.posexplode(F.split("name", " ")).alias("i", "word"))
    x0 = F.col("i") * 40 + F.when(F.col("i") > F.col("row") % 3, 100).otherwise(0)
    return pages.split_columns(words.select("row", "word", x0.alias("x0"), (x0 + 30).alias("x1")))


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = projects(spark, sf_dir).select("id", "source_key", "utility")
    new = own.where(F.col("source_key") == "src1").select((F.col("id") + 1_000_000).alias("id"), "source_key", F.upper("utility").alias("utility"))
    return maintenance.replace_source(own, new, "src1", ["src2"])


def sync_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each source's rows against a ledger in which two are stale and one is missing."""
    own = projects(spark, sf_dir).groupBy("source_key").agg(F.sha2(F.concat_ws(",", F.count("*"), F.sum("id")), 256).alias("sha"))
    ledger = own.where(F.col("source_key") != "src5").select("source_key", F.when(F.col("source_key").isin("src0", "src3"), "old").otherwise(F.col("sha")).alias("sha"))
    return maintenance.stale_sources(own, ledger)


def patches(df: DataFrame) -> DataFrame:
    own = df.where((F.col("id") - 1) % 97 == 0)
    moved, bad = (F.col("id") - 1) % 2 == 0, (F.col("id") - 1) % 10 == 0
    return own.select("id", F.when(moved, F.lit(33.25)).alias("lat"), F.when(moved, F.lit(-84.5)).alias("lng"), F.lit(None).cast("date").alias("start_date"), F.when(bad, F.lit("2000-01-01").cast("date")).otherwise(F.date_add("end_date", 30)).alias("end_date"), F.lit(12345).cast("long").alias("cost_usd"))


def apply_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = projects(spark, sf_dir)
    after, _ = maintenance.apply_patches(own, patches(own))
    return after.select("id", F.round("lat", 6).alias("lat"), "end_date", "end_precision", "cost_usd", "routed", "requires_review")


def patch_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of names, states, types and voltages; a type that there is not rejects all of its patch."""
    own = projects(spark, sf_dir)
    k = F.col("id")
    kinds = F.when(k % 3 == 0, F.lit("Switching Station ")).when(k % 3 == 1, F.lit("no such type"))
    edits = own.where(k % 7 == 0).select("id", F.upper("name").alias("name"), F.lit("ZZ").alias("state"), kinds.alias("type"), F.when(k % 2 == 0, F.lit(34.5)).alias("voltage_kv"), (k % 2 == 0).alias("reviewed"))
    after, wrong = maintenance.apply_patches(own, edits)
    return after.join(wrong.withColumn("rejected", F.lit(True)), "id", "left").select("id", "name", "state", "type", "voltage_kv", "reviewed", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def patch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = projects(spark, sf_dir)
    after, _ = maintenance.apply_patches(own, patches(own))
    return maintenance.changed_fields(own, after, "id", ["lat", "lng", "end_date", "cost_usd", "end_precision"])


def upsert_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = projects(spark, sf_dir).select(F.col("id").alias("pair_id"), F.col("name").alias("text"))
    return maintenance.upsert(own.where(F.col("pair_id") % 3 != 0), own.where(F.col("pair_id") % 5 == 0).select("pair_id", F.upper("text").alias("text")), "pair_id")


def admit_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.concat(F.lit("U"), (F.col("o_custkey") % 80).cast("string")).alias("utility"), F.col("o_orderkey").alias("arrival"))
    return maintenance.admit_plans(plans, 50)


def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_quantity") < 48).alias("ok"), F.col("l_linenumber").cast("long").alias("n"))
    return maintenance.load_status(parts)


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company: projects, current ones, and whether its ownership awaits review."""
    own = pairs.with_owners(pairs.with_windows(projects(spark, sf_dir)), registry(spark, sf_dir), AS_OF)
    ahead = F.coalesce(F.col("build_end") >= F.lit(AS_OF).cast("date"), F.lit(True))
    return own.groupBy("company").agg(F.count("*").alias("total"), F.sum(ahead.cast("long")).alias("current"), F.bool_or("needs_review").alias("needs_review"))


def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("requires_review"), "review").when(F.col("approximate"), "approximate").otherwise("exact")
    confidence = F.when(F.col("requires_review"), 0.6).when(F.col("approximate"), 0.8).otherwise(0.95)
    return projects(spark, sf_dir).withColumns({"outcome": outcome, "c": confidence}).groupBy("source_key", "outcome").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("confidence"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one of two versions has and the other lacks, counted per source."""
    own = projects(spark, sf_dir).select("id", "source_key", "cost_usd")
    new = own.where(F.col("id") % 11 != 0).withColumn("cost_usd", F.when(F.col("id") % 13 == 0, F.lit(1)).otherwise(F.col("cost_usd")))
    side = lambda d, n: d.groupBy("source_key").agg(F.count("*").alias("n")).withColumn("change", F.lit(n))
    return side(own.exceptAll(new), "removed").unionByName(side(new.exceptAll(own), "added"))


def ordered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that each company names but has no project in: set difference per company."""
    own = projects(spark, sf_dir).withColumn("named", F.regexp_extract_all("location_ref", F.lit(r"\b([A-Z]{2})\b"), F.lit(1)))
    sets = own.groupBy("utility").agg(F.collect_set("state").alias("has"), F.array_distinct(F.flatten(F.collect_set("named"))).alias("named"))
    return sets.select("utility", F.array_join(F.array_sort(F.array_except("named", "has")), ",").alias("only_named"), F.array_join(F.array_sort(F.array_intersect("named", "has")), ",").alias("both"))


_LEN = "(sqrt(pow(({b}.lat-{a}.lat)*(111132.954-559.822*cos(2*radians(({a}.lat+{b}.lat)/2))+1.175*cos(4*radians(({a}.lat+{b}.lat)/2))),2)+pow(({b}.lng-{a}.lng)*(111412.84*cos(radians(({a}.lat+{b}.lat)/2))-93.5*cos(3*radians(({a}.lat+{b}.lat)/2))+0.118*cos(5*radians(({a}.lat+{b}.lat)/2))),2)))"
_AT = lambda m, i: f"(((p_partkey*{m}+{i}*37)%1013)/CAST(1013 AS DOUBLE))"
_V = ", ".join(f"{{'lng': -100+{_AT(7919, 0)}*20+{i}*{_AT(31, i)}, 'lat': 28+{_AT(104729, 0)}*12+{i}*{_AT(53, i)}/2}} AS v{i}" for i in range(3))
LINES_SQL = f"""lines AS (SELECT *, CASE WHEN kv0>0 THEN kv0 END AS kv, nullif(upper(trim(owner)),'UNKNOWN') AS owner_norm, ({_LEN.format(a='v0', b='v1')}+{_LEN.format(a='v1', b='v2')})/1000 AS km FROM (
  SELECT p_partkey AS id, list_extract({NAMES!r}, CAST(p_size%24+1 AS INT)) AS owner, CASE WHEN p_size%7=0 THEN -999999 ELSE list_extract([69,115,138,230,345,500,765], CAST(p_partkey%7+1 AS INT)) END AS kv0, {_V} FROM part))"""
_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({t}),'[^a-z0-9]+',' ','g'),' '), lambda w: w<>''), lambda w: list_transform(range(1,length(w)+2), lambda i: substr('  '||w||' ',i,3)))))"
_PICK = lambda values, k: f"list_extract({values!r}, CAST({k}+1 AS INT))"
_PATCHED = f"""{WITH}, p AS (SELECT id, CASE WHEN (id-1)%2=0 THEN 33.25::DOUBLE END AS nlat, CASE WHEN (id-1)%10=0 THEN DATE '2000-01-01' ELSE end_date+30 END AS nend FROM projects WHERE (id-1)%97=0),
  j AS (SELECT projects.*, p.id IS NOT NULL AS hit, nlat, nend, p.id IS NOT NULL AND coalesce(start_date <= coalesce(nend,end_date), true) AS ok FROM projects LEFT JOIN p USING (id)) """

SQL = {
    "project_search": WITH + r"SELECT id, utility, state, name FROM projects WHERE (state IN ('GA','FL') OR (state IS NULL AND regexp_matches(location_ref, '(^|[,(/]\s*)(GA|FL)(\s*[)/,]|\s*$)'))) AND type IN ('substation','generation') AND (contains(lower(utility),'jasper') OR contains(lower(name),'jasper') OR contains(lower(location_ref),'jasper'))",
    "near_search": WITH + "SELECT id, round(m,3) AS miles FROM (SELECT id, " + _LEN.format(a="q", b="projects") + "/1609.344 AS m FROM projects, (SELECT 33.5::DOUBLE AS lat, -84.4::DOUBLE AS lng) q) WHERE m<=100",
    "fuzzy_search": WITH + f""", n AS (SELECT name, count(*) AS n FROM projects GROUP BY name), q AS (SELECT {_TRI.format(t="'valdost thomasvile'")} AS q),
      t AS (SELECT name, n, q, flatten(list_transform(list_filter(string_split(regexp_replace(lower(name),'[^a-z0-9]+',' ','g'),' '), lambda w: w<>''), lambda w: list_transform(range(1,length(w)+2), lambda i: substr('  '||w||' ',i,3)))) AS t FROM n, q),
      e AS (SELECT name, n, q, list_distinct(t[a:b]) AS e FROM t, unnest(range(1,len(t)+1)) x(a), unnest(range(1,len(t)+1)) y(b) WHERE a<=b),
      s AS (SELECT name, n, max(len(list_intersect(e,q))/CAST(len(e)+len(q)-len(list_intersect(e,q)) AS DOUBLE)) AS s FROM e GROUP BY ALL)
      SELECT name, n, round(s,6) AS similarity FROM s WHERE s>=0.5""",
    "fuzzy_matches": WITH + f""", q AS (SELECT *, {_TRI.format(t="q")} AS t FROM (SELECT id, trim(substr(p,1,i)||substr(p,i+2)||' '||r) AS q FROM (SELECT c_custkey AS id, 2+c_custkey%3 AS i,
        lower({_PICK(PLACES, 'c_custkey%16')}) AS p, CASE WHEN c_custkey%7=0 THEN 'Solar' WHEN c_custkey%5=0 THEN '' ELSE {_PICK(PLACES, 'floor(c_custkey*3+c_custkey/16.0)::BIGINT%16')} END AS r FROM customer))),
      n AS (SELECT DISTINCT name FROM (SELECT name FROM projects UNION ALL SELECT location_ref FROM projects UNION ALL SELECT p_name FROM part)),
      o AS (SELECT name, flatten(list_transform(list_filter(string_split(regexp_replace(lower(name),'[^a-z0-9]+',' ','g'),' '), lambda w: w<>''), lambda w: list_transform(range(1,length(w)+2), lambda i: substr('  '||w||' ',i,3)))) AS t FROM n),
      g AS (SELECT DISTINCT name, unnest(t) AS g FROM o), h AS (SELECT DISTINCT t, unnest(t) AS g FROM q),
      m AS (SELECT h.t AS q, name, count(*) AS c FROM h JOIN g USING (g) GROUP BY ALL HAVING count(*)*2 >= len(h.t)),
      e AS (SELECT q, name, list_distinct(o.t[a:b]) AS e FROM m JOIN o USING (name), unnest(range(1,len(o.t)+1)) x(a), unnest(range(1,len(o.t)+1)) y(b) WHERE a<=b AND list_contains(q, o.t[a]) AND list_contains(q, o.t[b])),
      s AS (SELECT q, name, max(len(list_intersect(e,q))/CAST(len(e)+len(q)-len(list_intersect(e,q)) AS DOUBLE)) AS s FROM e GROUP BY ALL)
      SELECT id, name, round(s,6) AS similarity FROM s JOIN q ON q.t=s.q WHERE s>=0.5""",
    "search_facets": WITH + "SELECT 'utility' AS facet, utility AS value, count(*) AS n FROM projects WHERE voltage_kv>=115 GROUP BY utility UNION ALL SELECT 'state', upper(state), count(*) FROM projects WHERE voltage_kv>=115 GROUP BY upper(state) UNION ALL SELECT 'type', type, count(*) FROM projects WHERE voltage_kv>=115 GROUP BY type",
    "search_summary": WITH + r"SELECT count(*) AS total, min(coalesce(start_date,end_date)) AS first_date, max(coalesce(end_date,start_date)) AS last_date, round(min(lat),6) AS min_lat, round(max(lat),6) AS max_lat, round(min(lng),6) AS min_lng, round(max(lng),6) AS max_lng FROM projects WHERE state='GA' OR (state IS NULL AND regexp_matches(location_ref, '(^|[,(/]\s*)(GA)(\s*[)/,]|\s*$)'))",
    "search_page": WITH + "SELECT id, utility, name FROM projects WHERE type='substation' ORDER BY utility, name NULLS LAST, id LIMIT 50",
    "utility_counts": WITH + "SELECT utility, count(*) AS n, count(DISTINCT lower(trim(source_key))) AS n_sources FROM projects GROUP BY utility",
    "current_projects": WITH + f", {WINDOWS_SQL} SELECT id, utility, build_end FROM windowed WHERE build_end IS NULL OR build_end >= DATE '{AS_OF}'",
    "review_queue": WITH + "SELECT id, confidence, requires_review FROM projects WHERE NOT reviewed AND (confidence<=0.7 OR requires_review)",
    "nearest_place": WITH + ", s AS (SELECT 'p'||s_suppkey AS name, 25+(s_suppkey*7919%1009)/CAST(1009 AS DOUBLE)*20 AS lat, -120+(s_suppkey*104729%2003)/CAST(2003 AS DOUBLE)*45 AS lng FROM supplier), d AS (SELECT projects.id, place, " + _LEN.format(a="s", b="projects") + " AS m FROM projects, (SELECT name AS place, lat, lng FROM s) s WHERE projects.lat IS NOT NULL) SELECT id, arg_min(place, struct_pack(m, place)) AS place, round(min(m),3) AS metres FROM d GROUP BY id",
    "line_roster": f"WITH {LINES_SQL} SELECT owner_norm, count(*) AS n_lines, round(sum(km),1) AS km, min(kv) AS min_kv, max(kv) AS max_kv, array_to_string(list_sort(list(DISTINCT owner)),'|') AS names FROM lines GROUP BY owner_norm",
    "lines_by_voltage_class": f"WITH {LINES_SQL} SELECT CASE WHEN kv>=550 THEN 550 WHEN kv>=310 THEN 310 WHEN kv>=220 THEN 220 WHEN kv>=132 THEN 132 WHEN kv>=52 THEN 52 WHEN kv>=25 THEN 25 WHEN kv>=10 THEN 10 END AS voltage_class, count(*) AS n_lines, round(sum(km),1) AS km FROM lines GROUP BY 1",
    "line_bounds": f"WITH {LINES_SQL} SELECT round(min(least(v0.lat,v1.lat,v2.lat)),6) AS min_lat, round(min(least(v0.lng,v1.lng,v2.lng)),6) AS min_lng, round(max(greatest(v0.lat,v1.lat,v2.lat)),6) AS max_lat, round(max(greatest(v0.lng,v1.lng,v2.lng)),6) AS max_lng FROM lines WHERE kv>=230",
    "generator_plants": "SELECT *, 'Plant '||plant||' ('||technologies||', '||printf('%.1f', mw)||' MW)' AS name FROM (SELECT l_orderkey AS plant, date_trunc('month', l_shipdate)::DATE AS month, round(sum(l_quantity),1) AS mw, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS technologies, count(*) AS n_units FROM lineitem GROUP BY 1,2)",
    "stitch_rows": "SELECT o_custkey%50 AS doc, '#'||o_orderkey||' '||o_orderstatus||CASE WHEN o_orderkey%3=0 THEN ' '||trim(o_orderpriority) ELSE '' END AS text FROM orders",
    "page_runs": WITH + ", d AS (SELECT DISTINCT utility AS doc, source_page AS page FROM projects WHERE source_page%7<4), g AS (SELECT doc, page, page-row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM d), r AS (SELECT doc, min(page) AS a, max(page) AS b FROM g GROUP BY doc, g) SELECT doc, string_agg(CASE WHEN a=b THEN a::VARCHAR ELSE a||'-'||b END, ',' ORDER BY a) AS pages FROM r GROUP BY doc",
    "page_selection": "SELECT o_custkey%50 AS doc, o_orderkey%20 AS page, count(*) AS n, sum(((o_orderkey%20 BETWEEN o_custkey%50%9 AND o_custkey%50%9+4) OR o_orderkey%20=17)::INT)::BIGINT AS n_kept FROM orders GROUP BY 1,2",
    "chunk_pages": """WITH RECURSIVE o AS (SELECT o_custkey%100 AS doc, o_orderkey AS page, o_orderkey%37=0 AS big, CASE WHEN o_orderkey%37=0 THEN 100+o_orderkey%50 ELSE 100+o_orderkey*37%900 END AS w FROM orders),
      m AS (SELECT *, CASE WHEN big THEN (4000-w)//(w+1)+1 ELSE 1 END AS m, CASE WHEN big THEN 50 ELSE 1 END AS lines FROM o),
      g AS (SELECT doc, page, s, w, least(m, lines-s*m) AS k FROM m, unnest(range(0, CASE WHEN big THEN 50 ELSE 1 END)) u(s) WHERE s*m<lines),
      p AS (SELECT doc, page, k*(w+1)-1 AS n, array_to_string(list_transform(range(0, k), lambda x: repeat('x', w::INT)), chr(10)) AS t, row_number() OVER (PARTITION BY doc ORDER BY page, s) AS i FROM g),
      r AS (SELECT doc, i, page, n AS total, 0 AS chunk FROM p WHERE i=1 UNION ALL SELECT p.doc, p.i, p.page, CASE WHEN total+n<=4000 THEN total+n ELSE n END, CASE WHEN total+n<=4000 THEN chunk ELSE chunk+1 END FROM r JOIN p ON p.doc=r.doc AND p.i=r.i+1)
      SELECT r.doc, chunk, min(r.page) AS first_page, max(r.page) AS last_page, max(total)::BIGINT AS n_chars, md5(string_agg('=== PAGE '||r.page||' ==='||chr(10)||t, chr(10)||chr(10) ORDER BY r.i)) AS body_md5 FROM r JOIN p ON p.doc=r.doc AND p.i=r.i GROUP BY r.doc, chunk""",
    "page_specs": """SELECT c_custkey AS doc, CASE c_custkey%8 WHEN 0 THEN '2-3,5-9' WHEN 1 THEN '1-6,9' WHEN 2 THEN '7' WHEN 3 THEN '1-12' WHEN 6 THEN CASE WHEN c_custkey%20+5 BETWEEN 9 AND 12 THEN '8-'||(c_custkey%20+5) WHEN c_custkey%20+5=8 THEN '8' END WHEN 7 THEN '2' END AS normal,
      CASE c_custkey%8 WHEN 4 THEN 'no page selection' WHEN 5 THEN 'outside of the document' WHEN 6 THEN CASE WHEN c_custkey%20+5 NOT BETWEEN 8 AND 12 THEN 'outside of the document' END END AS error FROM customer""",
    "split_columns": WITH + ", w AS (SELECT id AS row, string_split(name,' ') AS w, id%3 AS c FROM projects) SELECT row, array_to_string(w[1:c+1],' ') AS left_text, array_to_string(w[c+2:],' ') AS right_text FROM w",
    "replace_source": WITH + "SELECT id, source_key, utility FROM projects WHERE source_key NOT IN ('src1','src2') UNION ALL SELECT id+1000000, source_key, upper(utility) FROM projects WHERE source_key='src1'",
    "sync_sources": WITH + "SELECT source_key, sha256(count(*)||','||sum(id)) AS sha FROM projects GROUP BY source_key HAVING source_key IN ('src0','src3','src5')",
    "apply_patches": _PATCHED + "SELECT id, round(CASE WHEN ok AND nlat IS NOT NULL THEN nlat ELSE lat END,6) AS lat, CASE WHEN ok THEN coalesce(nend,end_date) ELSE end_date END AS end_date, CASE WHEN ok AND nend IS NOT NULL THEN 'day' ELSE end_precision END AS end_precision, CASE WHEN ok THEN 12345 ELSE cost_usd END AS cost_usd, routed AND NOT (ok AND nlat IS NOT NULL) AS routed, requires_review AND NOT (ok AND nlat IS NOT NULL) AS requires_review FROM j",
    "patch_fields": WITH + """, p AS (SELECT *, id%7=0 AS hit, id%7=0 AND id%3<>1 AS ok FROM projects) SELECT id, CASE WHEN ok THEN upper(name) ELSE name END AS name, CASE WHEN ok THEN 'ZZ' ELSE state END AS state,
      CASE WHEN ok AND id%3=0 THEN 'substation' ELSE type END AS type, CASE WHEN ok AND id%2=0 THEN 34 ELSE voltage_kv END AS voltage_kv, CASE WHEN ok THEN id%2=0 ELSE reviewed END AS reviewed, hit AND NOT ok AS rejected FROM p""",
    "patch_changes": _PATCHED + "SELECT * FROM (SELECT id, concat_ws(',', CASE WHEN nlat IS NOT NULL AND lat IS DISTINCT FROM nlat THEN 'lat' END, CASE WHEN nlat IS NOT NULL AND lng IS DISTINCT FROM -84.5 THEN 'lng' END, CASE WHEN end_date IS DISTINCT FROM coalesce(nend,end_date) THEN 'end_date' END, CASE WHEN cost_usd IS DISTINCT FROM 12345 THEN 'cost_usd' END, CASE WHEN nend IS NOT NULL AND end_precision IS DISTINCT FROM 'day' THEN 'end_precision' END) AS fields FROM j WHERE ok) WHERE fields<>''",
    "upsert_briefs": WITH + "SELECT id AS pair_id, CASE WHEN id%5=0 THEN upper(name) ELSE name END AS text FROM projects WHERE id%3<>0 OR id%5=0",
    "admit_plans": "WITH f AS (SELECT o_custkey%80 AS u, min(o_orderkey) AS a FROM orders GROUP BY 1), r AS (SELECT u, row_number() OVER (ORDER BY a, u) AS r FROM f) SELECT o_orderkey AS plan_id, r<=50 AS admitted FROM orders JOIN r ON u=o_custkey%80",
    "plan_status": "SELECT l_orderkey AS plan_id, CASE WHEN bool_and(l_quantity<48) THEN 'loaded' ELSE 'failed' END AS status, (CASE WHEN bool_and(l_quantity<48) THEN sum(l_linenumber) ELSE 0 END)::BIGINT AS n_projects FROM lineitem GROUP BY 1",
    "audit_report": f"{WITH}, {COMPANIES_SQL}, {WINDOWS_SQL} SELECT company, count(*) AS total, sum((build_end IS NULL OR build_end >= DATE '{AS_OF}')::INT)::BIGINT AS current, bool_or(needs_review) AS needs_review FROM windowed JOIN companies USING (utility) GROUP BY company",
    "load_stats": WITH + "SELECT source_key, outcome, count(*) AS n, round(avg(c),6) AS confidence FROM (SELECT source_key, CASE WHEN requires_review THEN 'review' WHEN approximate THEN 'approximate' ELSE 'exact' END AS outcome, (CASE WHEN requires_review THEN 0.6 WHEN approximate THEN 0.8 ELSE 0.95 END)::DOUBLE AS c FROM projects) GROUP BY 1,2",
    "snapshot_diff": WITH + ", n AS (SELECT id, source_key, CASE WHEN id%13=0 THEN 1 ELSE cost_usd END AS cost_usd FROM projects WHERE id%11<>0), o AS (SELECT id, source_key, cost_usd FROM projects) SELECT source_key, count(*) AS n, 'removed' AS change FROM (FROM o EXCEPT ALL FROM n) GROUP BY 1 UNION ALL SELECT source_key, count(*), 'added' FROM (FROM n EXCEPT ALL FROM o) GROUP BY 1",
    "ordered_states": WITH + r", h AS (SELECT utility, list(DISTINCT state) FILTER (state IS NOT NULL) AS has FROM projects GROUP BY 1), m AS (SELECT utility, list_distinct(flatten(list(regexp_extract_all(location_ref,'\b([A-Z]{2})\b',1)))) AS named FROM projects GROUP BY 1) SELECT utility, array_to_string(list_sort(list_filter(named, lambda x: NOT list_contains(has,x))),',') AS only_named, array_to_string(list_sort(list_filter(named, lambda x: list_contains(has,x))),',') AS both FROM h JOIN m USING (utility)",
}

QUERIES = {
    f.__name__: f
    for f in (project_search, near_search, fuzzy_search, fuzzy_matches, search_facets, search_summary, search_page, utility_counts, current_projects, review_queue, nearest_place, line_roster, lines_by_voltage_class, line_bounds, generator_plants, stitch_rows, page_runs, page_selection, page_specs, chunk_pages, split_columns, replace_source, sync_sources, apply_patches, patch_fields, patch_changes, upsert_briefs, admit_plans, plan_status, audit_report, load_stats, snapshot_diff, ordered_states)
}
