"""Registered queries over delimited plans, kinds of files, rows as text and the ledger of plans, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import owners
from ..sources import tables
from .fixtures import NAMES, PROJECTS_SQL, pick, projects, table
from .pair_queries import COMPANIES_SQL

WITH = f"WITH {PROJECTS_SQL} "


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects as delimited plans, one a project: a header and a row, with a quoted cell that holds separators."""
    sep = pick(list(tables.SEPARATORS), F.col("id") % 4)
    head = F.array_join(F.array(F.lit("Project"), F.lit(" Category "), F.lit(""), F.lit("Note")), "~")
    note = F.concat(F.lit('"a, b; c| '), F.col("id").cast("string"), F.lit(' ""x""\n end"'))
    row = F.array_join(F.array("name", F.coalesce("type", F.lit("")), F.coalesce(F.col("voltage_kv").cast("string"), F.lit("")), note), "~")
    return projects(spark, sf_dir).select(F.col("id").alias("doc"), F.replace(F.concat(head, F.lit("\n"), row, F.lit("\n\n")), F.lit("~"), sep).alias("text"))


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.split_plan(plan_texts(spark, sf_dir)).where("row = 1")
    return own.select("doc", F.size("cells").alias("n"), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)])


def long_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects of a company as one plan with quoted cells, and its rows."""
    own = projects(spark, sf_dir)
    row = F.concat("name", F.lit(';"'), F.col("id").cast("string"), F.lit(';\n""'), F.coalesce("type", F.lit("")), F.lit('""";'), F.coalesce(F.col("voltage_kv").cast("string"), F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("r")))), lambda x: x["r"])
    plans = own.groupBy(F.col("utility").alias("doc")).agg(F.concat(F.lit("Project;Note;kV\r\n"), F.array_join(rows, "\r\n")).alias("text"))
    return tables.split_plan(plans).select("doc", "row", F.size("cells").alias("n"), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)])


def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.render_rows(tables.split_plan(plan_texts(spark, sf_dir)))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of made-up beginnings around the names of projects, by kind."""
    starts = ["%PDF-1.7 ", "PK\x03\x04 xl/workbook.xml ", "PK\x03\x04 other ", "<!DOCTYPE html><p>", "<?xml version='1.0'?>", "name,", "plain ", "\x01\x02"]
    own = projects(spark, sf_dir)
    text = F.when(F.col("id") % 9 == 8, F.concat(F.lit('{"name": "'), "name", F.lit('"}'))).otherwise(F.concat(pick(starts, F.col("id") % 9 % 8), F.col("name")))
    path = F.concat(F.lit("/plans/"), F.col("id").cast("string"), F.when(F.col("id") % 9 == 5, ".CSV").otherwise(".txt"))
    return tables.triage_files(own.select(path.alias("path"), text.cast("binary").alias("content"))).select("path", "format", "length", "sha")


def plan_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan a customer, statuses changed, some put in anew."""
    k = F.col("c_custkey")
    plans = table(spark, sf_dir, "customer").select(k.cast("string").alias("plan_id"), F.lit("new").alias("status"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(k * 86400).alias("created_at"), k.alias("k"))
    changes = plans.where("k % 3 = 0").select("plan_id", F.when(F.col("k") % 2 == 0, "failed").otherwise("done").alias("status"), F.when(F.col("k") % 2 == 0, "no text").alias("error"))
    changed = tables.set_status(plans, changes.union(spark.range(1).select(F.lit("none"), F.lit("done"), F.lit(None).cast("string"))))
    again = plans.where("k % 5 = 0").withColumn("status", F.lit("again"))
    return tables.list_plans(tables.insert_plans(changed, again)).select("plan_id", "status", "error", F.to_date("created_at").alias("day"))


def generators_by_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants of each canonical owner, in order."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plant"), pick(NAMES, F.col("l_orderkey") % 24).alias("utility")).distinct()
    names = g.select("utility").distinct().withColumn("owner", owners.canonical_utility(F.col("utility")))
    own = g.join(names, "utility").groupBy("owner").agg(F.array_sort(F.collect_list("plant")).alias("plants"))
    return own.select("owner", F.size("plants").alias("n"), F.sha2(F.array_join(F.transform("plants", lambda p: p.cast("string")), ","), 256).alias("plants"))


_ROW = "SELECT id, name, coalesce(type,'') AS type, coalesce(voltage_kv::VARCHAR,'') AS kv, 'a, b; c| '||id||' \"x\"  end' AS note FROM projects"
SQL = {
    "plan_rows": WITH + f"SELECT id AS doc, 4 AS n, name AS c0, type AS c1, kv AS c2, note AS c3 FROM ({_ROW})",
    "long_plan_rows": WITH + """SELECT utility AS doc, row_number() OVER (PARTITION BY utility ORDER BY id)::INT AS row, 3 AS n, name AS c0, id||'; "'||coalesce(type,'')||'"' AS c1, coalesce(voltage_kv::VARCHAR,'') AS c2 FROM projects
      UNION ALL SELECT DISTINCT utility, 0, 3, 'Project', 'Note', 'kV' FROM projects""",
    "rendered_rows": WITH + f"SELECT id AS doc, 0 AS row, 'Columns: Project, Category, col3, Note' AS line FROM projects UNION ALL SELECT id, 1, 'Row 1: Project='||name||CASE WHEN type<>'' THEN '; Category='||type ELSE '' END||CASE WHEN kv<>'' THEN '; col3='||kv ELSE '' END||'; Note='||note FROM ({_ROW})",
    "file_kinds": WITH + """, f AS (SELECT id, CASE id%9 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'PK'||chr(3)||chr(4)||' xl/workbook.xml ' WHEN 2 THEN 'PK'||chr(3)||chr(4)||' other ' WHEN 3 THEN '<!DOCTYPE html><p>' WHEN 4 THEN '<?xml version=''1.0''?>' WHEN 5 THEN 'name,' WHEN 6 THEN 'plain ' WHEN 7 THEN chr(1)||chr(2) ELSE '{"name": "' END||name||CASE WHEN id%9=8 THEN '"}' ELSE '' END AS t FROM projects)
      SELECT '/plans/'||id||CASE WHEN id%9=5 THEN '.CSV' ELSE '.txt' END AS path, list_extract(['pdf','xlsx','zip','html','xml','csv','text','binary','json'], CAST(id%9+1 AS INT)) AS format, octet_length(encode(t)) AS length, sha256(t) AS sha FROM f""",
    "plan_ledger": "SELECT c_custkey::VARCHAR AS plan_id, CASE WHEN c_custkey%5=0 THEN 'again' WHEN c_custkey%6=0 THEN 'failed' WHEN c_custkey%3=0 THEN 'done' ELSE 'new' END AS status, CASE WHEN c_custkey%5<>0 AND c_custkey%6=0 THEN 'no text' END AS error, DATE '1970-01-01'+CAST(c_custkey AS INT) AS day FROM customer",
    "generators_by_utility": f"WITH {COMPANIES_SQL}, g AS (SELECT DISTINCT l_orderkey AS plant, list_extract({NAMES!r}, CAST(l_orderkey%24+1 AS INT)) AS utility FROM lineitem) SELECT company AS owner, count(*)::INT AS n, sha256(string_agg(plant::VARCHAR, ',' ORDER BY plant)) AS plants FROM g JOIN companies USING (utility) GROUP BY company",
}

QUERIES = {f.__name__: f for f in (plan_rows, long_plan_rows, rendered_rows, file_kinds, plan_ledger, generators_by_utility)}
