"""Queries of accounting and analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .registry import query, table


@query("SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN 'exact' ELSE 'candidates' END AS status, string_agg(DISTINCT lang, '|' ORDER BY lang) AS targets, count(DISTINCT doc_id) AS n_refs FROM documents GROUP BY source")
def a1_claim_index(spark, sf_dir):
    """One target or several for each source."""
    return A.claims(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("SELECT s_nationkey AS nation, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS s_name, count(DISTINCT s_suppkey % 2) > 1 AS conflict FROM supplier GROUP BY s_nationkey")
def a2_fact_merge(spark, sf_dir):
    """A2: union of what rows of one identity hold; conflict where they disagree."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name", (F.col("s_suppkey") % 2).alias("basis"))
    return A.merged_facts(s, "nation", ["s_name"], "basis")


@query("SELECT source, count(*) AS discovered, count(*) FILTER (toxic = 0 AND quality = 1) AS admitted, count(*) FILTER (toxic = 1) AS excluded, count(*) FILTER (toxic = 0 AND quality = 0) AS ambiguous, count(*) FILTER (toxic IS NULL) AS unclassified FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a4_coverage(spark, sf_dir):
    """A4 A5: every record gets one disposition."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    t, q = F.col("toxic"), F.col("quality")
    return j.groupBy("source").agg(F.count("*").alias("discovered"), F.count_if((t == 0) & (q == 1)).alias("admitted"), F.count_if(t == 1).alias("excluded"), F.count_if((t == 0) & (q == 0)).alias("ambiguous"), F.count_if(t.isNull()).alias("unclassified"))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def e2_ledger_difference(spark, sf_dir):
    """In one ledger alone."""
    return A.both_ways(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT CAST(grouping(lang, source) AS INTEGER) AS level, lang, source, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def a6_summaries(spark, sf_dir):
    """Several summaries in one pass."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT CAST(grouping_id(lang, source) AS INT) AS level, lang, source, count(*) AS n, count(DISTINCT text) AS texts FROM _documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")


@query("SELECT p_brand AS loading, p_type AS kind, CAST(sum(p_size) AS BIGINT) AS bytes, count(*) AS sections FROM (SELECT DISTINCT p_partkey, p_brand, p_type, p_size FROM part JOIN lineitem ON l_partkey = p_partkey) GROUP BY ROLLUP (p_brand, p_type)")
def a17_payload(spark, sf_dir):
    """Each section once, then a rollup."""
    p = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return p.rollup(F.col("p_brand").alias("loading"), F.col("p_type").alias("kind")).agg(F.sum("p_size").cast("long").alias("bytes"), F.count("*").alias("sections"))


@query("SELECT atom, n, CAST(row_number() OVER (ORDER BY n DESC, atom) AS INTEGER) AS id FROM (SELECT atom, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS atom FROM documents) WHERE atom <> '' GROUP BY atom)")
def a8_atom_statistics(spark, sf_dir):
    """Frequency-ordered ids."""
    n = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("atom")).where("atom <> ''").groupBy("atom").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return n.withColumn("id", F.row_number().over(Window.orderBy(F.col("n").desc(), "atom")))


@query("SELECT lower(word) AS folded, count(*) AS n, count(DISTINCT word) AS spellings FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1 HAVING count(DISTINCT word) > 1")
def a9_equivalent_spellings(spark, sf_dir):
    """Groups that present alike."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return w.groupBy(F.lower("word").alias("folded")).agg(F.count("*").alias("n"), F.count_distinct("word").alias("spellings")).where("spellings > 1")


@query("SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def a18_percentiles(spark, sf_dir):
    """Nearest rank."""
    return table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type").agg(A.nearest_rank("value", 0.5).alias("median"), A.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def w11_deltas(spark, sf_dir):
    """Differences to the event before."""
    return A.deltas(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id")


@query("""WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars < 500), b AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars >= 500), k AS (SELECT source FROM a UNION SELECT source FROM b)
SELECT source, coalesce((SELECT string_agg(lang, '|' ORDER BY lang) FROM b WHERE b.source = k.source AND (b.source, b.lang) NOT IN (SELECT source, lang FROM a)), '') AS added, coalesce((SELECT string_agg(lang, '|' ORDER BY lang) FROM a WHERE a.source = k.source AND (a.source, a.lang) NOT IN (SELECT source, lang FROM b)), '') AS absent FROM k""")
def e1_period_difference(spark, sf_dir):
    """Members that came and went between two states."""
    d = table(spark, sf_dir, "documents")
    return A.set_difference(d.where("n_chars < 500"), d.where("n_chars >= 500"), "source", "lang")


@query("""WITH a AS (SELECT l_suppkey AS s, l_linestatus AS m, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), b AS (SELECT l_suppkey AS s, l_linestatus AS m, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL)
SELECT s, m, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN a.n IS NULL THEN 'right_only' WHEN b.n IS NULL THEN 'left_only' WHEN a.n = b.n THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b USING (s, m)""")
def j17_reconciliation(spark, sf_dir):
    """Counts on both sides, reconciled."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linestatus").alias("m"), "l_linenumber")  # noqa: E741
    return A.reconciled(l.where("l_linenumber = 1"), l.where("l_linenumber = 2"), ["s", "m"])


@query("SELECT r_name AS rule, count(DISTINCT n_nationkey) AS facts, count(DISTINCT s_suppkey) AS sources, count(l_orderkey) AS uses FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY r_name")
def j18_evidence_chain(spark, sf_dir):
    """A chain of joins from rules to uses, counted."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(t("supplier"), "s_suppkey").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("rule")).agg(F.count_distinct("n_nationkey").alias("facts"), F.count_distinct("s_suppkey").alias("sources"), F.count("l_orderkey").alias("uses"))


@query("SELECT certainty, count(*) AS n FROM (SELECT CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'unresolved' WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'conditional' WHEN count(*) > 0 THEN 'unique' ELSE 'literal' END AS certainty FROM lineitem GROUP BY l_orderkey) GROUP BY certainty")
def c31_certainty(spark, sf_dir):
    """Certainty by what became of candidates."""
    f = lambda x: F.count_if(F.col("l_returnflag") == x)
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(A.certainty(F.count("*"), f("R"), f("A")).alias("certainty"))
    return g.groupBy("certainty").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS digest FROM documents")
def k2_canonical_digest(spark, sf_dir):
    """Digest of canonical JSON, keys sorted."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")).cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, rn AS place, item FROM (SELECT l_orderkey AS doc_id, l_partkey AS item, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS rn FROM lineitem) WHERE rn BETWEEN 3 AND 4")
def w12_evidence_pages(spark, sf_dir):
    """The second page of two."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), at.alias("place"), F.col("l_partkey").alias("item")).where("place between 3 and 4")




@query("WITH g AS (SELECT p_brand AS brand, p_type AS type, count(DISTINCT p_size) AS n FROM part GROUP BY ALL) SELECT brand, count(*) FILTER (n = 1) AS one, count(*) FILTER (n > 1) AS many FROM g GROUP BY brand")
def a15_reading_inventory(spark, sf_dir):
    """Surfaces with one reading or several."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), "p_type").agg(F.count_distinct("p_size").alias("n"))
    return g.groupBy("brand").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("many"))


@query("""WITH old AS (SELECT atom, CAST(row_number() OVER (ORDER BY atom) AS BIGINT) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS atom FROM benchmark) WHERE atom <> ''),
now AS (SELECT DISTINCT atom FROM (SELECT unnest(string_split(text, '')) AS atom FROM documents) WHERE atom <> ''),
fresh AS (SELECT atom, (SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY atom) AS id, 'live' AS state FROM now WHERE atom NOT IN (SELECT atom FROM old))
SELECT atom, id, CASE WHEN atom IN (SELECT atom FROM now) THEN 'live' ELSE 'retired' END AS state FROM old UNION ALL SELECT atom, id, state FROM fresh""")
def c46_symbol_registry(spark, sf_dir):
    """Ids are never given anew; symbols out of use are retired.
    The registry held the characters of benchmark; documents brings those in use."""
    from pyspark.sql import Window

    atoms = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", "")).alias("atom")).where("atom <> ''").distinct()
    old = atoms("benchmark").withColumn("id", F.row_number().over(Window.orderBy("atom")).cast("long"))
    return A.updated_registry(old, atoms("documents"))


@query("SELECT disposition, reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'excluded' WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'fact' WHEN quality = 0 THEN 'candidate' ELSE 'unclassified' END AS disposition, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'labelled' WHEN quality = 0 THEN 'low_quality' ELSE '' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL")
def c39_dispositions(spark, sf_dir):
    """Each source record becomes something, or is excluded with a reason."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = F.col
    rules = [("excluded", "empty", c("text").isNull() | (F.trim("text") == "")), ("excluded", "toxic", c("toxic") == 1), ("fact", "labelled", c("quality") == 1), ("candidate", "low_quality", c("quality") == 0)]
    return A.dispositions(d, "doc_id", rules).groupBy("disposition", "reason").agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT list(DISTINCT a) AS l FROM (SELECT unnest(string_split(text, '')) AS a FROM benchmark)) SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n, CAST(len(list_filter(string_split(text, ''), lambda c: NOT list_contains(l, c))) AS BIGINT) AS own FROM documents, b WHERE length(text) > 0")
def f40_symbols(spark, sf_dir):
    """texts as symbols of a registry, characters outside it as they are, and
    back without loss."""
    atoms = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("atom")).where("atom <> ''").distinct()
    empty = spark.createDataFrame([], "atom string, id long")
    registry = A.updated_registry(empty, atoms)
    made = A.symbolized(table(spark, sf_dir, "documents"), registry)
    n = made.select("doc_id", F.size("symbols").cast("long").alias("n"), F.size(F.filter("symbols", lambda s: s["id"].isNull())).cast("long").alias("own"))
    return A.desymbolized(made, registry).join(n, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n", "own")


@query("SELECT 'missing' AS side, count(*) AS rows FROM (SELECT n_name, n_regionkey FROM nation EXCEPT ALL SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 4 <> 0) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT n_name FROM nation WHERE n_nationkey < 0)")
def e6_artifact_equality(spark, sf_dir):
    """Rows by which an artifact differs from the one that is expected."""
    n = table(spark, sf_dir, "nation").select("n_name", "n_regionkey", "n_nationkey")
    return A.table_differences(n.drop("n_nationkey"), n.where("n_nationkey % 4 <> 0").drop("n_nationkey"))
