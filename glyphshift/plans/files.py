"""Queries of sources and sinks: tables are written in a source's format to the
shared folder and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import readers, writers
from .registry import query, shared_path, table


def _files(df: DataFrame, name: str, key: str = "file", **options) -> str:
    """A file for each row of df(key, value)."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(key).options(**options).text(path)
    return path


@query("""SELECT 'nation' AS kind, '/records/' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS pointer, n_nationkey AS key, n_name AS name FROM nation
UNION ALL SELECT 'supplier', '/records/' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1), s_suppkey, s_name FROM supplier""")
def s1_workspace_scan(spark, sf_dir):
    """JSON files below a folder, by kind, with each record's pointer."""
    parts = []
    for kind, by, key, name in (("nation", "n_regionkey", "n_nationkey", "n_name"), ("supplier", "s_nationkey", "s_suppkey", "s_name")):
        rows = table(spark, sf_dir, kind).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), F.col(name).alias("name")))).alias("records"))
        parts.append(rows.select(F.concat(F.lit(kind), F.col(by).cast("string")).alias("file"), F.to_json(F.struct(F.lit(kind).alias("kind"), "records"), {"pretty": "true"}).alias("value")))
    path = _files(parts[0].unionByName(parts[1]), "workspace")
    found = readers.scan_workspace(spark, path, {"nation": "key long, name string", "supplier": "key long, name string"})
    return found["nation"].select(F.lit("nation").alias("kind"), "pointer", "key", "name").unionByName(found["supplier"].select(F.lit("supplier").alias("kind"), "pointer", "key", "name"))


@query("""SELECT 'element' AS kind, 'entry' AS name, count(*) AS n FROM part UNION ALL SELECT 'element', 'keb', count(*) FILTER (p_size % 2 = 0) FROM part UNION ALL SELECT 'element', 'reb', count(*) FROM part UNION ALL SELECT 'element', 'pos', count(*) FROM part UNION ALL SELECT 'element', 'dictionary', 5
UNION ALL SELECT 'attribute', 'lang', count(*) FROM part UNION ALL SELECT 'entity', name, CAST(n AS BIGINT) FROM (VALUES ('n', 4), ('v1', 12)) t(name, n) UNION ALL SELECT 'pos', CASE WHEN p_size % 3 = 0 THEN 'n' ELSE 'v1' END, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'reading', p_brand || '&' || p_size, count(*) FROM part GROUP BY 2""")
def s3_dictionary_xml(spark, sf_dir):
    """S3: entries with declared and known references; elements and attributes
    counted, none left out."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    keb = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<keb>"), "p_brand", F.lit("</keb>"))).otherwise("")
    entry = F.concat(F.lit("<entry>"), keb, F.lit('<reb lang="ja">'), "p_brand", F.lit("&amp;"), size, F.lit("</reb><pos>&"), F.when(F.col("p_size") % 3 == 0, "n").otherwise("v1"), F.lit(";</pos></entry>"))
    head = '<?xml version="1.0"?><!DOCTYPE dictionary [<!ENTITY n "noun"><!ENTITY v1 "ichidan verb">]><!-- <none/> -->'
    whole = p.groupBy((F.col("p_partkey") % 5).alias("file")).agg(F.concat(F.lit(head + "<dictionary>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</dictionary>")).alias("value"))
    texts = spark.read.text(_files(whole, "dictionary-xml"), wholetext=True, recursiveFileLookup=True).select("value")
    inner = lambda tag: texts.select(F.explode(F.regexp_extract_all("value", F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>"), F.lit(1))).alias("x")).select(F.lit({"pos": "pos", "reb": "reading"}[tag]).alias("kind"), readers.decoded(F.col("x")).alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    entities = readers.declared_entities(texts).select(F.lit("entity").alias("kind"), "name", F.length("value").cast("long").alias("n"))
    return readers.xml_accounting(texts).unionByName(entities).unionByName(inner("pos")).unionByName(inner("reb"))


@query("SELECT n_regionkey AS file, count(*) AS records, 0 AS broken FROM nation GROUP BY n_regionkey")
def s4_packed_json(spark, sf_dir):
    """Gzipped JSON, after its digest is checked."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("file")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    path = _files(rows, "packed", compression="gzip")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    told = files.select("path", F.sha2("content", 256).alias("sha256"))
    broken = readers.check_digest(files, told).count()
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), "file=([0-9]+)", 1).cast("int").alias("file"), F.from_json("value", "array<struct<n_nationkey:int,n_name:string>>", {"mode": "FAILFAST"}).alias("r"))
    return texts.select(F.col("file").cast(table(spark, sf_dir, "nation").schema["n_regionkey"].dataType).alias("file"), F.size("r").cast("long").alias("records"), F.lit(broken).cast("int").alias("broken"))


@query("SELECT CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS key, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS target, CASE WHEN p_size % 7 <> 0 AND p_size % 3 = 0 THEN p_name END AS comment, p_size % 7 <> 0 AND p_size % 5 = 0 AS disabled, CASE WHEN p_size % 7 = 0 THEN p_brand || ' ' || p_type END AS remainder, count(*) AS n FROM part GROUP BY ALL")
def s5_line_dictionary(spark, sf_dir):
    """Keys, targets and comments of lines; what doesn't parse is kept."""
    size = F.col("p_size")
    line = F.when(size % 7 == 0, F.concat_ws(" ", "p_brand", "p_type")).otherwise(F.concat(F.when(size % 5 == 0, ";").otherwise(""), F.col("p_brand"), F.lit(" /"), F.col("p_type"), F.lit("/"), F.when(size % 3 == 0, F.concat(F.lit(" ;"), "p_name")).otherwise("")))
    path = shared_path(spark, "lines")
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return readers.line_dictionary(spark.read.text(path)).groupBy("key", "target", "comment", "disabled", "remainder").agg(F.count("*").alias("n"))


@query("""SELECT s_nationkey AS doc, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS ordinal, s_name AS key, 'かう ' || s_suppkey || ' <x> & y' AS value, NULL AS reading FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_nationkey, CAST(2 * rn + k - 2 AS INTEGER), NULL, ['ゐる ' || s_suppkey, 'ゑる b'][k], ['ゐる', 'ゑる'][k] FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier), (SELECT unnest([1, 2]) AS k)""")
def s6_html_dictionaries(spark, sf_dir):
    """Lines `key：value` of a page, and the entries of a table's cells."""
    s = table(spark, sf_dir, "supplier")
    line = F.concat(F.lit("<b>"), "s_name", F.lit("</b>："), F.lit("かう  "), F.col("s_suppkey").cast("string"), F.lit(" &lt;x&gt; &amp; y"))
    line = F.when(F.col("s_suppkey") % 3 == 0, F.lit("no entry")).otherwise(line)
    pages = s.groupBy(F.col("s_nationkey").alias("doc")).agg(F.concat(F.lit("<p>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("x")))), lambda r: r["x"]), "<br/>"), F.lit("</p>")).alias("html"))
    row = F.concat(F.lit("<tr><td>ゐる "), F.col("s_suppkey").cast("string"), F.lit("<br>ゑる b</td></tr>"))
    tables = s.groupBy(F.col("s_nationkey").alias("doc")).agg(F.concat(F.lit("<table><tr><th>a</th></tr><tr><th>b</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("x")))), lambda r: r["x"]), ""), F.lit("</table>")).alias("html"))
    a = readers.colon_dictionary(pages).withColumn("reading", F.lit(None).cast("string"))
    b = readers.exception_verbs(tables).select("doc", "ordinal", F.lit(None).cast("string").alias("key"), F.col("entry").alias("value"), "reading")
    return a.unionByName(b)


@query("""WITH r AS (SELECT s_nationkey AS doc, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) % 3 = 1 AS full_ FROM supplier),
h AS (SELECT *, max(CASE WHEN full_ THEN k END) OVER (PARTITION BY doc ORDER BY k) AS head FROM r)
SELECT doc, 'h' || head AS heading, 'w' || head AS historical, chr(CAST(19968 + k % 1000 AS INTEGER)) AS character, CASE WHEN k % 2 = 0 THEN 'c' || k END AS context, CAST(NULL AS VARCHAR) AS remainder FROM h UNION ALL SELECT doc, 'h' || head, 'w' || head, NULL, NULL, '?' FROM h WHERE k % 5 = 0""")
def s7_html_table(spark, sf_dir):
    """Full rows set the heading that short rows inherit; a row for each
    character, what is none is a remainder."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("k"))
    text = F.col("k").cast("string")
    full = F.row_number().over(Window.partitionBy("doc").orderBy("k")) % 3 == 1
    last = F.concat(F.expr("decode(unhex(hex(19968 + k % 1000)), 'UTF-16BE')"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("（c"), text, F.lit("）"))).otherwise(""), F.when(F.col("k") % 5 == 0, "?").otherwise(""))
    row = F.when(full, F.concat(F.lit("<tr><td>h"), text, F.lit("<td>w"), text, F.lit("<td>x<td>"), last, F.lit("</tr>"))).otherwise(F.concat(F.lit("<tr><td>y</td><td>"), last, F.lit("</td></tr>")))
    pages = s.withColumn("x", row).groupBy("doc").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]), ""), F.lit("</table>")).alias("html"))
    return readers.carried_headings(readers.html_table(pages)).select("doc", "heading", "historical", "character", "context", "remainder")


@query("SELECT p_partkey AS id, p_name || ', \"' || p_brand || '\"' AS name, array_to_string(string_split(p_type, ' '), '+') AS tags FROM part")
def s9_quoted_csv(spark, sf_dir):
    """Quoted fields, a checked header, tags of a domain."""
    path = shared_path(spark, "csv")
    p = table(spark, sf_dir, "part")
    p.select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"), F.regexp_replace("p_type", " ", "／").alias("tags")).write.csv(path, header=True, quote='"', escape='"')
    got = readers.read_quoted_csv(spark, path, ["p_partkey", "name", "tags"])
    return got.select(F.col("p_partkey").cast("long").alias("id"), "name", F.array_join(F.split("tags", "／"), "+").alias("tags"))


@query("SELECT p_partkey AS id, p_brand AS a, '[' || p_name || ',' || p_brand || ']' AS b, p_type || ',' || p_size AS c, 'say \"' || p_brand || '\", ok' AS d FROM part")
def s10_delimited_rows(spark, sf_dir):
    """Rows whose delimiters may stand in brackets, quotes or escapes."""
    row = F.concat(F.col("p_brand"), F.lit(" ,["), "p_name", F.lit(","), "p_brand", F.lit("], "), "p_type", F.lit("\\,"), F.col("p_size").cast("string"), F.lit(',"say ""'), "p_brand", F.lit('"", ok"'))
    got = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), readers.split_delimited_udf(row, F.lit(",")).alias("x"))
    return got.select("id", *[F.col("x")[i].alias(n) for i, n in enumerate("abcd")])


@query("SELECT 'f' || n_regionkey AS stage, n_name AS \"from\", 'to ' || n_nationkey AS \"to\", n_nationkey % 2 = 0 AS enabled FROM nation")
def s12_json5_stages(spark, sf_dir):
    """Stage files with comments, bare keys, single quotes, trailing commas."""
    rule = F.concat(F.lit("{from: '"), "n_name", F.lit("', to: \"to "), F.col("n_nationkey").cast("string"), F.lit("\", enabled: "), F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"), F.lit(",}, // a rule\n"))
    files = table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(rule)), "").alias("r"))
    path = _files(files.select("file", F.concat(F.lit("/* a stage */ {stage: '"), "file", F.lit("', rules: [\n"), "r", F.lit("],}")).alias("value")), "stages")
    got = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select("value")
    told = readers.parsed_json5(got, "stage string, rules array<struct<`from`:string,`to`:string,enabled:boolean>>")
    return told.select("stage", F.explode("rules").alias("r")).select("stage", "r.from", "r.to", "r.enabled")


@query("SELECT n_name AS rule, 'root/' || r_name AS node, '/children/' || r_regionkey || '/rules/' || (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1) AS locator, r_regionkey % 2 = 0 AS enabled FROM nation JOIN region ON n_regionkey = r_regionkey")
def s13_rule_tree(spark, sf_dir):
    """Rules of a nested tree with their pointers and what they lie under."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    node = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.struct(x.alias("id"))).alias("rules")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    whole = node.agg(F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("enabled"), "rules"))).alias("c"))
    tree = whole.select(F.lit("tree").alias("file"), F.to_json(F.struct(F.lit("root").alias("name"), F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["enabled"].alias("enabled"), x["rules"].alias("rules"))).alias("children"))).alias("value"))
    got = readers.read_rule_tree(spark, _files(tree, "tree") + "/file=tree")
    return got.select(F.get_json_object("rule", "$.id").alias("rule"), F.array_join("node", "/").alias("node"), "locator", "enabled")


@query("SELECT 'plain' AS name, CAST(p_partkey AS VARCHAR) AS id, p_size % 2 = 0 AS enabled, CAST(p_size AS INTEGER) AS priority FROM part")
def s17_profiles(spark, sf_dir):
    """A profile written, and read again."""
    path = shared_path(spark, "profile")
    p = table(spark, sf_dir, "part")
    writers.write_profile(p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("enabled"), F.col("p_size").alias("priority")), path, "plain")
    return readers.read_profile(spark, path)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def k1_replaced_artifact(spark, sf_dir):
    """K1: the second state of an artifact that replaced its first."""
    path, s = shared_path(spark, "artifact"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    for state in (s, s.where("s_suppkey % 2 = 0")):
        writers.replace_atomically(state, path)
    return spark.read.parquet(path)
