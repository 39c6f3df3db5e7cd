"""Rule programs as tables: a program's tests are predicates over a state, its
emissions rows. Running them is a join and a filter for each level of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROGRAM = "program string, profiles array<string>, symbol string, lexemes array<string>, mode string, needs map<string,string>, outputs array<struct<output:string,candidate:boolean>>, preserve boolean, calls array<string>"


def holds() -> Column:
    """All tests of a program over a state's profile, symbol, lexemes and
    context; a null test is none. Lexemes are hypotheses: mode all (the default)
    wants every one of at least one in the program's set, some any of them, none
    not one."""
    inside = lambda x: F.array_contains("p_lexemes", x)
    have = F.coalesce("lexemes", F.array().cast("array<string>"))
    lexical = F.when(F.col("mode") == "some", F.exists(have, inside)).when(F.col("mode") == "none", ~F.exists(have, inside)).otherwise((F.size(have) > 0) & F.forall(have, inside))
    told = F.coalesce("context", F.create_map().cast("map<string,string>"))
    tests = (
        F.col("p_profiles").isNull() | F.array_contains("p_profiles", F.col("profile")),
        F.col("p_symbol").isNull() | (F.col("p_symbol") == F.col("symbol")),
        F.col("p_lexemes").isNull() | lexical,
        F.col("needs").isNull() | F.forall(F.map_entries("needs"), lambda e: F.coalesce(F.try_element_at(told, e["key"]) == e["value"], F.lit(False))),
    )
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def run_programs(states: DataFrame, programs: DataFrame, depth: int = 16) -> DataFrame:
    """state_id, output, candidate and preserved: a row for each distinct output
    of states(state_id, program, profile, symbol, lexemes, context), and one with
    a null output where a program only preserves.

    A program whose tests fail gives nothing, nor do the programs that it calls.
    An output is a candidate if every emission of it is one, or if the state has
    several outputs. Calls nested deeper than depth, thus circles, fail."""
    p = programs.select("program", *[F.col(c).alias(f"p_{c}") for c in ("profiles", "symbol", "lexemes")], "mode", "needs", "outputs", F.coalesce("preserve", F.lit(False)).alias("preserve"), "calls")
    cur, made = states, None
    for _ in range(depth):
        fired = cur.join(p, "program").where(holds())
        rows = fired.select("state_id", F.explode_outer("outputs").alias("o"), "preserve").select("state_id", "o.output", F.coalesce("o.candidate", F.lit(False)).alias("candidate"), "preserve")
        made = rows if made is None else made.unionByName(rows)
        cur = fired.where(F.size("calls") > 0).withColumn("program", F.explode("calls")).select(*states.columns)
        if cur.isEmpty():
            break
    else:
        raise ValueError(f"programs call each other deeper than {depth}")
    mine = Window.partitionBy("state_id")
    each = made.groupBy("state_id", "output").agg(F.bool_and("candidate").alias("candidate"), F.bool_or("preserve").alias("preserve"))
    several = F.count("output").over(mine) > 1
    out = each.withColumn("candidate", F.col("output").isNotNull() & (F.col("candidate") | several)).withColumn("preserved", F.bool_or("preserve").over(mine))
    return out.where("output is not null or preserve").select("state_id", "output", "candidate", "preserved")


def dangling_calls(programs: DataFrame) -> DataFrame:
    """(program, call) where no program has the called name."""
    calls = programs.select("program", F.explode("calls").alias("call")).distinct()
    return calls.join(programs.select(F.col("program").alias("call")), "call", "left_anti").select("program", "call")
