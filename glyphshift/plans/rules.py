"""Queries of rule tables. `part` serves as a table of rules: p_partkey the id,
p_brand the input, p_type the output, p_size the priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from .registry import query, table, values


def _rules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("input"), F.col("p_type").alias("output"), F.col("p_size").cast("int").alias("priority"), (F.col("p_partkey") % 3).cast("int").alias("stage"), F.col("p_partkey").alias("place"))


_R = "rules AS (SELECT p_partkey AS id, p_brand AS input, p_type AS output, CAST(p_size AS INTEGER) AS priority, CAST(p_partkey % 3 AS INTEGER) AS stage, p_partkey AS place FROM part)"


@query(f"WITH {_R} SELECT input, string_agg(output, '|' ORDER BY output) AS outputs FROM (SELECT DISTINCT input, output FROM rules) GROUP BY input HAVING count(*) > 1")
def a10_branch_conflicts(spark, sf_dir):
    """Inputs with several outputs."""
    return R.branch_conflicts(_rules(spark, sf_dir)).select("input", F.array_join("outputs", "|").alias("outputs"))


@query(f"WITH {_R} SELECT input, count(DISTINCT stage) AS stages, arg_max(id, row(priority, stage, place)) AS winner FROM rules GROUP BY input HAVING count(DISTINCT stage) > 1")
def a12_cross_stage_winners(spark, sf_dir):
    """A12 O4 X8."""
    return R.cross_stage_winners(_rules(spark, sf_dir))


@query(f"WITH {_R} SELECT id FROM rules WHERE id % 4 = 0 OR (id % 4 = 1)")
def p13_profile_mask(spark, sf_dir):
    """Rules of no profile and of the chosen one."""
    r = _rules(spark, sf_dir).withColumn("enabled_by", F.when(F.col("id") % 4 == 0, F.lit(None).cast("array<string>")).when(F.col("id") % 4 == 1, F.array(F.lit("plain"), F.lit("style"))).otherwise(F.array(F.lit("style"))))
    return R.enabled(r, "plain").select("id")


_NODES = "('root', CAST(NULL AS STRING), true), ('a','root',true), ('b','root',false), ('a1','a',true), ('a2','a',false), ('b1','b',true)"


@query(f"""WITH RECURSIVE nodes(node, parent, enabled) AS (VALUES {_NODES.replace('STRING', 'VARCHAR')}),
up AS (SELECT node, enabled FROM nodes WHERE parent IS NULL UNION ALL SELECT n.node, n.enabled AND u.enabled FROM up u JOIN nodes n ON n.parent = u.node)
SELECT p_partkey AS id, node FROM (SELECT p_partkey, ['root','a1','a2','b1'][p_partkey % 4 + 1] AS node, p_size > 5 AS own FROM part) JOIN up USING (node) WHERE enabled AND own""")
def p21_toggle_tree(spark, sf_dir):
    """A rule is on if it and all nodes above it are."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, ("root", "a1", "a2", "b1"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("node"), (F.col("p_size") > 5).alias("enabled"))
    return R.toggled(rules, values(spark, _NODES, "node, parent, enabled")).select("id", "node")


@query("SELECT p_brand AS input, p_type AS output, bool_or(p_size < 10 AND coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END, true)) AS \"on\" FROM part GROUP BY ALL")
def p23_shared_output(spark, sf_dir):
    """A branch is on if one of the origins that share it is."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("input"), F.col("p_type").alias("output"), (F.col("p_size") < 10).alias("eligible"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3 == 1).alias("enabled"))
    return R.shared_output_enabled(b)


_LINKED = """linked AS (SELECT 'r' || (n_nationkey * 7 + 3) % 25 AS id, n_nationkey AS k, n_nationkey % 3 AS stage, n_nationkey % 4 AS class,
 list_filter([n_nationkey - 3, n_nationkey - 4, n_nationkey - 9], lambda x: x >= 0 AND (x % 3 <= n_nationkey % 3)) AS on_ FROM nation),
rules AS (SELECT id, stage, class, list_transform(on_, lambda x: 'r' || (x * 7 + 3) % 25) AS deps FROM linked)"""


def _kahn(rank: str) -> str:
    """DuckDB: ids in the order in which the least ready one is taken."""
    return f"""walk AS (SELECT 0 AS n, CAST([] AS VARCHAR[]) AS done UNION ALL
 SELECT n + 1, list_append(done, (SELECT min(({rank}, r.id)) FROM rules r WHERE NOT list_contains(done, r.id) AND list_has_all(done, r.deps))[2]) FROM walk WHERE n < (SELECT count(*) FROM rules)),
places AS (SELECT unnest(done) AS id, unnest(range(len(done))) AS k FROM walk WHERE n = (SELECT count(*) FROM rules))"""


def _linked(spark, sf_dir):
    k = F.col("n_nationkey").cast("int")
    name = lambda x: F.concat(F.lit("r"), ((x * 7 + 3) % 25).cast("string"))
    on = F.transform(F.filter(F.array(k - 3, k - 4, k - 9), lambda x: (x >= 0) & (x % 3 <= k % 3)), name)
    return table(spark, sf_dir, "nation").select(name(k).alias("id"), (k % 3).alias("stage"), F.element_at(F.array(*map(F.lit, R.CLASSES)), k % 4 + 1).alias("class"), on.alias("depends_on"), on.alias("dependencies"))


@query(f"WITH RECURSIVE {_LINKED}, {_kahn('r.stage')} SELECT id, stage, CAST(row_number() OVER (ORDER BY stage, k) - 1 AS INTEGER) AS position FROM places JOIN rules USING (id)")
def o2_rule_order(spark, sf_dir):
    """O2: by stage, then after what a rule depends on, the least ready id first."""
    return R.ordered(_linked(spark, sf_dir)).select("id", "stage", "position")


@query(f"WITH RECURSIVE {_LINKED}, {_kahn('r.class')} SELECT id, CAST(k AS INTEGER) AS position FROM places")
def o3_projection_order(spark, sf_dir):
    """O3: topological; of the ready rules the earliest class, then the least id."""
    return R.projection_order(_linked(spark, sf_dir)).select("id", "position")


_RELATION = """rel AS (SELECT p_partkey AS id, ['mapping', 'identity', 'preserve', 'mapping', 'mapping'][p_size % 5 + 1] AS kind, ['exact_only', 'preserve_block', 'substring_productive', 'character_productive'][p_partkey % 4 + 1] AS mode,
 CASE WHEN p_size % 6 = 0 THEN [left(p_brand, 1)] WHEN p_size % 6 = 1 THEN CAST([] AS VARCHAR[]) WHEN p_size % 6 = 2 THEN [p_type, p_brand, p_brand] ELSE [p_brand] END AS f,
 CASE WHEN p_partkey % 5 = 0 THEN [p_brand] WHEN p_partkey % 5 = 1 THEN [left(p_brand, 1)] WHEN p_partkey % 5 = 2 THEN [p_brand, p_type] ELSE ['x'] END AS t,
 ['rule', 'implicit_identity', 'attested_identity', 'preserve_exact'][p_size % 4 + 1] AS basis, [NULL, 'implicit', 'attested', 'preserve'][p_partkey % 7 % 4 + 1] AS semantics, [NULL, 'anywhere', 'nowhere'][p_size % 7 % 3 + 1] AS applicability FROM part),
same AS (SELECT *, list_sort(list_distinct(f)) = list_sort(list_distinct(t)) AS same, mode IN ('substring_productive', 'character_productive') AS productive, list_distinct(f) AS fd, list_distinct(t) AS td FROM rel)"""


@query(f"""WITH {_RELATION} SELECT id, concat_ws(',', CASE WHEN len(f) = 0 THEN 'forms_missing' END, CASE WHEN applicability = 'nowhere' THEN 'applicability_unknown' END, CASE WHEN applicability IS NOT NULL AND NOT productive THEN 'applicability_not_productive' END,
 CASE WHEN mode = 'preserve_block' AND kind <> 'preserve' THEN 'block_not_preserve' END, CASE WHEN kind = 'identity' AND semantics IS NULL THEN 'identity_without_semantics' END, CASE WHEN kind = 'identity' AND NOT same THEN 'identity_changes_forms' END,
 CASE WHEN kind = 'identity' AND semantics = 'implicit' AND basis <> 'implicit_identity' THEN 'implicit_basis' END, CASE WHEN kind = 'identity' AND semantics = 'attested' AND basis <> 'attested_identity' THEN 'attested_basis' END, CASE WHEN kind = 'identity' AND semantics = 'preserve' THEN 'identity_preserves' END,
 CASE WHEN kind = 'preserve' AND NOT same THEN 'preserve_changes_forms' END, CASE WHEN kind = 'preserve' AND mode <> 'preserve_block' THEN 'preserve_mode' END, CASE WHEN kind = 'preserve' AND semantics IS DISTINCT FROM 'preserve' THEN 'preserve_semantics' END, CASE WHEN kind = 'preserve' AND basis <> 'preserve_exact' THEN 'preserve_basis' END,
 CASE WHEN productive AND (kind <> 'mapping' OR len(td) <> 1) THEN 'productive_not_deterministic' END, CASE WHEN mode = 'character_productive' AND (len(list_filter(fd, lambda x: length(x) <> 1)) > 0 OR length(coalesce(list_sort(td)[1], '')) <> 1) THEN 'characters_expected' END,
 CASE WHEN kind = 'mapping' AND len(td) <> 1 THEN 'mapping_targets' END, CASE WHEN semantics IS NOT NULL AND kind NOT IN ('identity', 'preserve') THEN 'semantics_unexpected' END) AS faults,
 CASE WHEN len(f) = 0 THEN NULL WHEN len(fd) = 1 AND len(td) = 1 THEN 'one_to_one' WHEN len(fd) = 1 THEN 'one_to_many' WHEN len(td) = 1 THEN 'many_to_one' ELSE 'many_to_many' END AS cardinality FROM same""")
def c37_relation_faults(spark, sf_dir):
    """Which of a relation's invariants don't hold, and its cardinality."""
    at = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), (k + 1).cast("int"))
    size, key, one = F.col("p_size"), F.col("p_partkey"), F.left("p_brand", F.lit(1))
    none = F.array().cast("array<string>")
    f = F.when(size % 6 == 0, F.array(one)).when(size % 6 == 1, none).when(size % 6 == 2, F.array("p_type", "p_brand", "p_brand")).otherwise(F.array("p_brand"))
    t = F.when(key % 5 == 0, F.array("p_brand")).when(key % 5 == 1, F.array(one)).when(key % 5 == 2, F.array("p_brand", "p_type")).otherwise(F.array(F.lit("x")))
    rel = table(spark, sf_dir, "part").select(
        key.alias("id"), at(("mapping", "identity", "preserve", "mapping", "mapping"), size % 5).alias("kind"), at(("exact_only", "preserve_block", "substring_productive", "character_productive"), key % 4).alias("mode"), f.alias("from"), t.alias("to"),
        at(("rule", "implicit_identity", "attested_identity", "preserve_exact"), size % 4).alias("basis"), at((None, "implicit", "attested", "preserve"), key % 7 % 4).alias("semantics"), at((None, "anywhere", "nowhere"), size % 7 % 3).alias("applicability"),
    )
    return R.relation_faults(rel).select("id", F.array_join("faults", ",").alias("faults"), "cardinality")


@query("""SELECT 'dangling_customer' AS code, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'duplicate_name', n_name FROM nation GROUP BY n_name HAVING count(*) > 1
UNION ALL SELECT 'bad_size', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 3""")
def c38_validation(spark, sf_dir):
    """One query for each code."""
    t = lambda n: table(spark, sf_dir, n)
    known = t("customer").where("c_acctbal >= 0")
    return R.violations({
        "dangling_customer": R.dangling(t("orders"), "o_custkey", known, "c_custkey").withColumnRenamed("o_orderkey", "id"),
        "duplicate_name": t("nation").groupBy(F.col("n_name").alias("id")).count().where("count > 1"),
        "bad_size": t("part").where("p_size < 3").withColumnRenamed("p_partkey", "id"),
    })


@query("""WITH f AS (SELECT p_partkey AS id, list_filter([CASE WHEN p_size % 7 = 0 THEN 'sK' END, CASE WHEN p_size % 3 = 0 THEN 'oK' END, CASE WHEN p_size % 5 = 0 THEN 'rK' END], lambda x: x IS NOT NULL) AS tags FROM part)
SELECT id, len(list_filter(tags, lambda x: x <> 'oK')) = 0 AS usable, len(tags) = 0 AS plain FROM f""")
def p16_form_tags(spark, sf_dir):
    """Forms whose tags are all admitted; search-only ones never."""
    size = F.col("p_size")
    tags = F.array_compact(F.array(F.when(size % 7 == 0, "sK"), F.when(size % 3 == 0, "oK"), F.when(size % 5 == 0, "rK")))
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags"))
    return f.select("id", R.usable_form(F.col("tags"), ("oK", "sK")).alias("usable"), R.usable_form(F.col("tags")).alias("plain"))


@query("SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_partkey % 3, p_size DESC, p_retailprice, p_partkey) AS INTEGER) AS position FROM part WHERE p_size % 4 = 0 OR p_size % 4 = 1")
def o5_selection_order(spark, sf_dir):
    """The rules that a profile allows, in the order in which they are tried."""
    size = F.col("p_size")
    lists = F.when(size % 4 == 0, F.lit(None).cast("array<string>")).when(size % 4 == 1, F.array(F.lit("plain"))).otherwise(F.array(F.lit("style")))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("stage"), size.alias("priority"), F.col("p_retailprice").alias("place"), lists.alias("profiles"))
    return R.selection_order(r, "plain").select("id", "position")
