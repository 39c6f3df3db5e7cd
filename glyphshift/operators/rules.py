"""Rule tables: profiles, toggles, order, conflicts and validation."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RULES = 2_000_000


def enabled(rules: DataFrame, profile: str, column: str = "enabled_by") -> DataFrame:
    """Rules that name no profile or this one."""
    return rules.where(F.col(column).isNull() | F.array_contains(column, profile))


def usable_form(tags: Column, allowed: tuple[str, ...] = ()) -> Column:
    """No tag, or only opted-in ones; search-only forms never."""
    return F.forall(tags, lambda t: (t != "sK") & t.isin(*allowed) if allowed else F.lit(False))


def toggled(rules: DataFrame, nodes: DataFrame, depth: int = 20) -> DataFrame:
    """rules(id, node, enabled, ...) that are on and all of whose tree nodes
    nodes(node, parent, enabled) are on. A cycle, or a tree deeper than depth,
    fails."""
    state = nodes.select("node", F.col("parent"), F.coalesce("enabled", F.lit(True)).alias("up"))
    for _ in range(depth):
        above = state.select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("up").alias("_u"))
        step = state.join(above, state["parent"] == above["_n"], "left")
        state = step.select("node", F.col("_p").alias("parent"), (F.col("up") & F.coalesce("_u", F.lit(True))).alias("up"))
        if depth and state.where("parent is not null").isEmpty():
            break
    else:
        raise ValueError("the rule tree has a cycle or is too deep")
    return rules.join(state.where("up").select("node"), "node", "left_semi").where(F.coalesce("enabled", F.lit(True)))


def kahn(rules: list[tuple], rank) -> list:
    """Ids of rules(id, dependencies) so that each follows its dependencies; of
    those that are ready the least rank(id), then id, comes next."""
    known = {r[0] for r in rules}
    waits, after = {}, {}
    for id_, on, *_ in rules:
        for d in on:
            if d not in known:
                raise ValueError(f"rule {id_} depends on {d}, which is missing")
            after.setdefault(d, []).append(id_)
        waits[id_] = len(on)
    ready = [(rank(i), i) for i, n in waits.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for d in after.get(i, ()):
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(ready, (rank(d), d))
    if len(out) < len(known):
        raise ValueError(f"rules depend on each other in a circle: {sorted(known - set(out))[:5]}")
    return out


def _table(rules: DataFrame, *columns: str) -> list[tuple]:
    """A rule table's order is worked out on the driver, from ids and links alone."""
    n = rules.count()
    if n > MOST_RULES:
        raise ValueError(f"{n} rules; an order is worked out for {MOST_RULES} at most")
    return [tuple(r) for r in rules.select(*columns).collect()]


def ordered(rules: DataFrame) -> DataFrame:
    """rules(id, stage, depends_on array) plus position: by stage, then after all
    dependencies, the least id of the ready ones first. A missing, later-stage or
    circular dependency fails."""
    told = _table(rules, "id", F.coalesce("depends_on", F.array()).alias("on"), "stage")
    stage = {i: s for i, _, s in told}
    for i, on, s in told:
        late = [d for d in on if stage.get(d, s) > s]
        if late:
            raise ValueError(f"rule {i} depends on {late[0]}, which is of a later stage")
    order = sorted(kahn(told, stage.__getitem__), key=stage.__getitem__)
    kind = rules.schema["id"].dataType.simpleString()
    places = rules.sparkSession.createDataFrame([(i, k) for k, i in enumerate(order)], f"id {kind}, position int")
    return rules.join(places, "id").orderBy("position")


#: Ranks of rule classes in a projection.
CLASSES = ("diachronic", "phonological", "orthographic", "render")


def projection_order(rules: DataFrame, disabled: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """The active rules(id, class, dependencies array) plus position: topological;
    of the ready ones the earliest class, then the least id. Circles fail through
    disabled rules too; a dependency that is not active is no bond."""
    told = _table(rules, "id", F.coalesce("dependencies", F.array()).alias("on"), "class")
    known = {i for i, *_ in told}
    for i in only or ():
        if i not in known:
            raise ValueError(f"unknown enabled rule {i}")
    kahn(told, lambda _: 0)
    active = {i for i in known if i not in disabled and (only is None or i in only)}
    rank = {i: CLASSES.index(c) if c in CLASSES else len(CLASSES) for i, _, c in told}
    order = kahn([(i, [d for d in on if d in active]) for i, on, _ in told if i in active], rank.__getitem__)
    places = rules.sparkSession.createDataFrame([(i, k) for k, i in enumerate(order)], "id string, position int")
    return rules.join(places, "id").orderBy("position")


def branch_conflicts(rules: DataFrame, key: str = "input", out: str = "output") -> DataFrame:
    """Inputs with several outputs, as sorted text."""
    return rules.groupBy(key).agg(F.array_sort(F.collect_set(out)).alias("outputs")).where(F.size("outputs") > 1)


def cross_stage_winners(rules: DataFrame) -> DataFrame:
    """Keys that stand in two stages or more, with the id of the rule of highest
    (priority, stage, place)."""
    best = F.max_by("id", F.struct("priority", "stage", "place"))
    return rules.groupBy("input").agg(F.count_distinct("stage").alias("stages"), best.alias("winner")).where("stages > 1")


def shared_output_enabled(branches: DataFrame) -> DataFrame:
    """A branch is on if any of the entries that share its output is."""
    return branches.groupBy("input", "output").agg(F.bool_or(F.col("eligible") & F.coalesce("enabled", F.lit(True))).alias("on"))


def masked(candidates: DataFrame, origins: DataFrame) -> DataFrame:
    """candidates(key, output, ...) without those whose branch(input, output) is
    certified by origins(input, output, eligible, enabled) none of which is on;
    what no origin certifies stays. Nothing is added, reordered or changed."""
    off = shared_output_enabled(origins).where("not `on`").select(F.col("input").alias("key"), "output")
    return candidates.join(off, ["key", "output"], "left_anti").select(*candidates.columns)


def selection_order(rules: DataFrame, profile: str) -> DataFrame:
    """rules(id, stage, priority, place, profiles array) that a profile allows, plus
    position: by stage, highest priority, place and id. No list allows all."""
    own = rules.where(F.col("profiles").isNull() | F.array_contains("profiles", profile))
    return own.withColumn("position", F.row_number().over(Window.orderBy("stage", F.col("priority").desc(), "place", "id")))  # a rule table


def cardinality(source: Column, target: Column) -> Column:
    """one_to_one, one_to_many, many_to_one or many_to_many by distinct forms."""
    a, b = F.size(F.array_distinct(source)) == 1, F.size(F.array_distinct(target)) == 1
    return F.when(F.size(source) == 0, None).when(a & b, "one_to_one").when(a, "one_to_many").when(b, "many_to_one").otherwise("many_to_many")


POLICIES = ("anywhere", "lexical_boundary", "left_boundary", "right_boundary", "whole_lexeme")
PRODUCTIVE = ("substring_productive", "character_productive")


def relation_faults(relations: DataFrame) -> DataFrame:
    """relations(id, kind, mode, from, to, basis, semantics, applicability) plus
    faults, the invariants that don't hold, in their order, and cardinality."""
    kind, mode, basis, said, where_ = (F.col(c) for c in ("kind", "mode", "basis", "semantics", "applicability"))
    f, t = F.array_sort(F.array_distinct("from")), F.array_sort(F.array_distinct("to"))
    same, productive = f == t, mode.isin(*PRODUCTIVE)
    identity, preserve, mapping = kind == "identity", kind == "preserve", kind == "mapping"
    checks = {
        "forms_missing": (F.size("from") == 0) | (F.size("to") == 0),
        "applicability_unknown": where_.isNotNull() & ~where_.isin(*POLICIES), "applicability_not_productive": where_.isNotNull() & ~productive,
        "block_not_preserve": (mode == "preserve_block") & ~preserve,
        "identity_without_semantics": identity & said.isNull(), "identity_changes_forms": identity & ~same,
        "implicit_basis": identity & (said == "implicit") & (basis != "implicit_identity"), "attested_basis": identity & (said == "attested") & (basis != "attested_identity"), "identity_preserves": identity & (said == "preserve"),
        "preserve_changes_forms": preserve & ~same, "preserve_mode": preserve & (mode != "preserve_block"), "preserve_semantics": preserve & ~said.eqNullSafe("preserve"), "preserve_basis": preserve & (basis != "preserve_exact"),
        "productive_not_deterministic": productive & (~mapping | (F.size(t) != 1)),
        "characters_expected": (mode == "character_productive") & (F.exists(f, lambda x: F.length(x) != 1) | (F.length(F.coalesce(F.get(t, F.lit(0)), F.lit(""))) != 1)),
        "mapping_targets": mapping & (F.size(t) != 1), "semantics_unexpected": said.isNotNull() & ~identity & ~preserve,
    }
    return relations.select("*", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])).alias("faults"), cardinality(F.col("from"), F.col("to")).alias("cardinality"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(code, id) of every row that a check returns."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(code).alias("code"), F.col("id").cast("string").alias("id")) for code, d in checks.items()])


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose reference no parent has."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def topological_violations(rules: DataFrame) -> DataFrame:
    edges = rules.select("id", "stage", F.explode("depends_on").alias("on"))
    return edges.join(rules.select(F.col("id").alias("on"), F.col("stage").alias("s")), "on", "left").where("s is null or s > stage")
