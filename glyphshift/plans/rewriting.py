"""Queries of matching and arbitration over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import rules as R
from .registry import query, table, values

#: key, output, precedence, candidate
RULES = "('the','dhe',0,false), ('th','Þ',0,false), ('an','on',0,false), ('tion','cion',0,false), ('tion','sion',0,true), ('hea','hæ',0,false), ('ing','ynge',1,false), ('ring','ryng',1,false), ('in','yn',1,false), ('her','hör',2,true), ('er','ar',0,true), ('er','ir',0,true)"
COLUMNS = "key, output, precedence, candidate"
_MATCHES = f"""
rules(key, output, precedence, candidate) AS (VALUES {RULES}),
places AS (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents),
cut AS (SELECT doc_id, i - 1 AS start, i - 1 + n AS "end", substring(text, i, n) AS key FROM places, (SELECT DISTINCT length(key) AS n FROM rules) l WHERE i + n - 1 <= length(text)),
m AS (SELECT c.doc_id, CAST(c.start AS INTEGER) AS start, CAST(c."end" AS INTEGER) AS "end", key, output, precedence, candidate FROM cut c JOIN rules USING (key))"""


def _matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs, M.substring_matches(docs, values(spark, RULES, COLUMNS))


@query(f"WITH {_MATCHES} SELECT doc_id, count(*) AS n_matches, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum(CASE WHEN longest THEN 1 ELSE 0 END) AS BIGINT) AS n_longest FROM (SELECT *, \"end\" = max(\"end\") OVER (PARTITION BY doc_id, start) AS longest FROM m) GROUP BY doc_id")
def j3_substring_matches(spark, sf_dir):
    """Every match, after a look at two characters."""
    m = M.longest_at_start(_matches(spark, sf_dir)[1])
    return m.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.sum("start").cast("long").alias("sum_start"), F.sum(F.col("longest").cast("long")).alias("n_longest"))


_ORDERED = "row_number() OVER (PARTITION BY doc_id, start ORDER BY precedence DESC, \"end\" DESC, ord)"


@query(f"""WITH RECURSIVE {_MATCHES}, o AS (SELECT *, CASE key WHEN 'ing' THEN 1 WHEN 'ring' THEN 2 WHEN 'in' THEN 3 ELSE length(output) + 10 END AS ord FROM m WHERE NOT candidate),
best AS (SELECT doc_id, start, "end" AS e, output FROM (SELECT *, {_ORDERED} AS k FROM o) WHERE k = 1),
nxt AS (SELECT doc_id, start, e, output, (SELECT min(b.start) FROM best b WHERE b.doc_id = best.doc_id AND b.start >= best.e) AS n FROM best),
walk AS (SELECT * FROM nxt WHERE (doc_id, start) IN (SELECT doc_id, min(start) FROM nxt GROUP BY doc_id) UNION ALL SELECT n.doc_id, n.start, n.e, n.output, n.n FROM walk w JOIN nxt n ON n.doc_id = w.doc_id AND n.start = w.n)
SELECT doc_id, count(*) AS n_taken, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum(length(output)) AS BIGINT) AS out_length FROM walk GROUP BY doc_id""")
def w5_greedy_replacement(spark, sf_dir):
    """At each place the record of highest priority, then the longest,
    then the first; left to right, past what is taken."""
    order = F.when(F.col("key") == "ing", 1).when(F.col("key") == "ring", 2).when(F.col("key") == "in", 3).otherwise(F.length("output") + 10)
    m = _matches(spark, sf_dir)[1].where("not candidate").withColumn("ord", order)
    kept = M.walked(M.best_at(m, F.col("precedence"), F.col("ord")).select("doc_id", "start", "end", "output"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_taken"), F.sum("start").cast("long").alias("sum_start"), F.sum(F.length("output")).cast("long").alias("out_length"))


_DECIDED = f"""{_MATCHES},
live1 AS (SELECT * FROM m WHERE NOT (candidate AND (doc_id, start, "end") IN (SELECT doc_id, start, "end" FROM m WHERE NOT candidate))),
high AS (SELECT * FROM live1 a WHERE NOT EXISTS (SELECT 1 FROM live1 b WHERE b.doc_id = a.doc_id AND a.start < b."end" AND b.start < a."end" AND b.precedence > a.precedence)),
live2 AS (SELECT * FROM high a WHERE NOT (a.precedence > 0 AND EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND b.precedence = a.precedence AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start))),
live3 AS (SELECT * EXCLUDE far FROM (SELECT *, max("end") OVER (PARTITION BY doc_id, start) AS far FROM live2) WHERE "end" = far),
marked AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", output ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= start, true) AS opens FROM live3),
comp AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end", output ROWS UNBOUNDED PRECEDING) AS component FROM marked),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, component) AS n, min(start) OVER (PARTITION BY doc_id, component) AS a, max("end") OVER (PARTITION BY doc_id, component) AS b FROM comp),
many AS (SELECT DISTINCT s.doc_id, component, start, "end", output, a, substring(d.text, a + 1, b - a) AS piece FROM sized s JOIN documents d USING (doc_id) WHERE n BETWEEN 2 AND 24),
chains AS (
  SELECT doc_id, component, piece, a, a AS pos, 0 AS cover, ',' AS took FROM (SELECT DISTINCT doc_id, component, piece, a FROM many)
  UNION ALL
  SELECT c.doc_id, c.component, c.piece, c.a, m."end", c.cover + m."end" - m.start, c.took || m.start || ':' || m."end" || ':' || m.output || ','
  FROM chains c JOIN many m ON m.doc_id = c.doc_id AND m.component = c.component AND m.start >= c.pos),
top AS (SELECT * FROM chains QUALIFY cover = max(cover) OVER (PARTITION BY doc_id, component)),
fate AS (SELECT doc_id, component, count(DISTINCT took) AS ways, max(took) AS took FROM top GROUP BY doc_id, component),
decided AS (SELECT s.doc_id, s.component, s.a, s.b, s.start, s."end", s.output, CASE WHEN s.n = 1 THEN 'applied' WHEN s.n > 24 OR f.ways > 1 THEN 'unresolved' WHEN contains(f.took, ',' || s.start || ':' || s."end" || ':' || s.output || ',') THEN 'applied' ELSE 'blocked' END AS status
  FROM sized s LEFT JOIN fate f USING (doc_id, component))"""


@query(f"""WITH RECURSIVE {_DECIDED},
cuts AS (SELECT doc_id, start, "end", output, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM (SELECT DISTINCT doc_id, start, "end", output FROM decided WHERE status = 'applied')),
parts AS (SELECT c.doc_id, string_agg(substring(d.text, before + 1, start - before) || output, '' ORDER BY start) || substring(any_value(d.text), max("end") + 1) AS rendered FROM cuts c JOIN documents d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM m WHERE m.doc_id = d.doc_id) AS n_matches, coalesce(x.n_applied, 0) AS n_applied, coalesce(x.n_unresolved, 0) AS n_unresolved, md5(coalesce(p.rendered, d.text)) AS rendered_md5
FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (status = 'applied') AS n_applied, count(*) FILTER (status = 'unresolved') AS n_unresolved FROM decided GROUP BY doc_id) x USING (doc_id) LEFT JOIN parts p USING (doc_id)""")
def rewrite_documents(spark, sf_dir):
    """Texts with their uncontested rewrites."""
    docs, m = _matches(spark, sf_dir)
    count = lambda s: F.size(F.filter("status", lambda x: x == s)).cast("long")
    n = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long")
    return M.decisions(docs, m).select("doc_id", n.alias("n_matches"), count("applied").alias("n_applied"), count("unresolved").alias("n_unresolved"), F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"))


@query(f"""WITH RECURSIVE {_DECIDED},
told AS (SELECT key, output, start, "end", doc_id, 'candidate_alternative' AS reason FROM m WHERE (doc_id, start, "end", key, output) NOT IN (SELECT doc_id, start, "end", key, output FROM live1)
UNION ALL SELECT key, output, start, "end", doc_id, 'shadowed_by_higher_precedence' FROM live1 WHERE (doc_id, start, "end", key, output) NOT IN (SELECT doc_id, start, "end", key, output FROM high)
UNION ALL SELECT key, output, start, "end", doc_id, 'shadowed_by_longer_high_precedence' FROM high WHERE (doc_id, start, "end", key, output) NOT IN (SELECT doc_id, start, "end", key, output FROM live2)
UNION ALL SELECT key, output, start, "end", doc_id, 'shadowed_by_longer_match' FROM live2 WHERE (doc_id, start, "end", key, output) NOT IN (SELECT doc_id, start, "end", key, output FROM live3)
UNION ALL SELECT NULL, output, start, "end", doc_id, CASE status WHEN 'applied' THEN 'applied' WHEN 'blocked' THEN 'outranked_by_overlap' ELSE CASE WHEN bool_and(start = a AND "end" = b) OVER (PARTITION BY doc_id, component) THEN 'conflicting_productive_outputs' ELSE 'unresolved_shifted_overlap' END END FROM decided)
SELECT reason, output, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start FROM told GROUP BY reason, output""")
def c9_reasons(spark, sf_dir):
    """Why each candidate of the corpus was applied or not."""
    d = M.arbitrate(*_matches(spark, sf_dir))
    return d.groupBy(F.coalesce("reason", "status").alias("reason"), "output").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("sum_start"))


@query(f"""WITH RECURSIVE {_DECIDED},
open_ AS (SELECT DISTINCT doc_id, component, a, b FROM decided WHERE status = 'unresolved'),
sure AS (SELECT doc_id, component, bool_and(start = a AND "end" = b) AS same FROM decided WHERE status = 'unresolved' GROUP BY doc_id, component)
SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", CASE WHEN same THEN 'conflicting_productive_outputs' ELSE 'unresolved_shifted_overlap' END AS reasons FROM open_ JOIN sure USING (doc_id, component)""")
def w3_unresolved_regions(spark, sf_dir):
    """What stays open, merged where regions overlap, with all reasons."""
    d = M.decisions(*_matches(spark, sf_dir)).select("doc_id", F.explode("regions").alias("r"))
    return d.select("doc_id", "r.start", "r.end", F.array_join("r.reasons", "|").alias("reasons"))


@query(f"""WITH RECURSIVE {_DECIDED},
spans AS (SELECT DISTINCT doc_id, start, "end", output FROM decided WHERE status = 'applied'),
moved AS (SELECT *, start + coalesce(sum(length(output) - ("end" - start)) OVER (PARTITION BY doc_id ORDER BY start, "end", output ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM spans)
SELECT doc_id, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_start, CAST(sum(r + length(output)) AS BIGINT) AS sum_end FROM moved GROUP BY doc_id""")
def w7_rendered_offsets(spark, sf_dir):
    """Where applied spans lie in the rendered text."""
    docs, m = _matches(spark, sf_dir)
    return M.rendered_offsets(M.arbitrate(docs, m)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("rendered_start").cast("long").alias("sum_start"), F.sum("rendered_end").cast("long").alias("sum_end"))


@query(f"""WITH {_MATCHES}, spans AS (SELECT DISTINCT doc_id, start, "end" FROM m),
marked AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= start, true) AS opens FROM spans),
comp AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS component FROM marked)
SELECT doc_id, count(*) AS n_regions, max(n) AS most, CAST(sum(width) AS BIGINT) AS covered FROM (SELECT doc_id, component, count(*) AS n, max("end") - min(start) AS width FROM comp GROUP BY doc_id, component) GROUP BY doc_id""")
def w2_overlap_regions(spark, sf_dir):
    """Merged regions of overlapping matches."""
    spans = _matches(spark, sf_dir)[1].select("doc_id", "start", "end").distinct()
    each = M.overlap_components(spans).groupBy("doc_id", "component").agg(F.count("*").alias("n"), (F.max("end") - F.min("start")).alias("width"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_regions"), F.max("n").alias("most"), F.sum("width").cast("long").alias("covered"))


@query(f"""WITH {_MATCHES} SELECT doc_id, start, string_agg(output, '|' ORDER BY output) AS outputs, bool_and(candidate) AS candidate FROM (SELECT doc_id, start, "end", output, bool_and(candidate) AS candidate FROM m GROUP BY ALL) GROUP BY doc_id, start, "end" HAVING count(DISTINCT output) > 1""".replace('"end" HAVING', '"end" HAVING').replace("GROUP BY ALL", 'GROUP BY doc_id, start, "end", output'))
def e3_conflicting_outputs(spark, sf_dir):
    """Spans with several outputs; candidate only if all are."""
    m = _matches(spark, sf_dir)[1].groupBy("doc_id", "start", "end", "output").agg(F.bool_and("candidate").alias("candidate"))
    return m.groupBy("doc_id", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("output")), "|").alias("outputs"), F.bool_and("candidate").alias("candidate"), F.count("*").alias("n")).where("n > 1").select("doc_id", "start", "outputs", "candidate")


@query("WITH rules(key) AS (VALUES ('the'), ('of'), ('tion')) SELECT key, CAST(sum((length(text) - length(replace(text, key, ''))) // length(key)) AS BIGINT) AS by_join, CAST(sum((length(text) - length(replace(text, key, ''))) // length(key)) AS BIGINT) AS by_scan FROM documents, rules GROUP BY key")
def j6_access_path_parity(spark, sf_dir):
    """The n-gram join and a scan for each rule find the same."""
    docs = table(spark, sf_dir, "documents")
    keys = ("the", "of", "tion")
    joined = M.substring_matches(docs, values(spark, ", ".join(f"('{k}')" for k in keys), "key")).groupBy("key").agg(F.count("*").alias("by_join"))
    hits = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.expr(f"(length(text) - length(replace(text, '{k}', ''))) div {len(k)}").alias("n")) for k in keys]))
    scanned = docs.select(hits.alias("h")).groupBy(F.col("h.key").alias("key")).agg(F.sum("h.n").alias("by_scan"))
    return joined.join(scanned, "key")


@query(f"""WITH RECURSIVE {_DECIDED} SELECT d.doc_id, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status <> 'applied') AS kept_out FROM decided d WHERE output = 'on' GROUP BY d.doc_id""")
def c41_ledger_by_rule(spark, sf_dir):
    """Of the ledger of all decisions, the entries that one rule took part in."""
    made = M.decisions(*_matches(spark, sf_dir)).select("doc_id", F.arrays_zip("items", "status").alias("x"))
    own = F.filter("x", lambda e: e["items"]["output"] == "on")
    n = lambda cond: F.size(F.filter(own, cond)).cast("long")
    ledger = made.select("doc_id", n(lambda e: e["status"] == "applied").alias("applied"), n(lambda e: e["status"] != "applied").alias("kept_out"))
    return ledger.where("applied + kept_out > 0")


@query(f"""WITH {_MATCHES}, spans AS (SELECT DISTINCT doc_id, start, "end" FROM m), covered AS (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS i FROM spans),
free AS (SELECT d.doc_id, i FROM (SELECT doc_id, unnest(range(0, length(text))) AS i FROM documents) d ANTI JOIN covered c ON c.doc_id = d.doc_id AND c.i = d.i),
runs AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g, i FROM free)
SELECT doc_id, count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_unknown, CAST(sum("end" - start) FILTER (NOT known) AS BIGINT) AS unknown_length, CAST(max("end") AS BIGINT) AS last_end FROM (SELECT doc_id, start, "end", true AS known FROM spans UNION ALL SELECT doc_id, min(i), max(i) + 1, false FROM runs GROUP BY doc_id, g) GROUP BY doc_id""")
def c7_span_lattice(spark, sf_dir):
    """All spans that are known, and what lies between as unknown runs."""
    s = M.spans_and_gaps(*_matches(spark, sf_dir))
    open_ = ~F.col("known")
    return s.groupBy("doc_id").agg(F.count_if("known").alias("n_known"), F.count_if(open_).alias("n_unknown"), F.sum(F.when(open_, F.col("end") - F.col("start"))).cast("long").alias("unknown_length"), F.max("end").cast("long").alias("last_end"))


@query(f"""WITH RECURSIVE {_DECIDED.replace("JOIN rules USING (key))", "JOIN rules USING (key) WHERE key NOT IN ('an', 'ring'))")} SELECT output, count(*) FILTER (status = 'applied') AS applied FROM decided GROUP BY output HAVING count(*) FILTER (status = 'applied') > 0""")
def p22_origin_mask(spark, sf_dir):
    """Candidates whose certified origins are all switched off go before the
    arbitration; one origin that is on keeps a branch."""
    docs, m = _matches(spark, sf_dir)
    origins = values(spark, "('an','on',true,false), ('ring','ryng',false,true), ('th','Þ',true,false), ('th','Þ',true,true), ('the','dhe',true,null)", "input, output, eligible, enabled")
    d = M.arbitrate(docs, R.masked(m, origins))
    return d.where("status = 'applied'").groupBy("output").agg(F.count("*").alias("applied"))
