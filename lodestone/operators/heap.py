"""Values of variables and fields before and after each statement, with updates that replace where they can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import written

CELL = ["stmt", "base", "field"]
ROW = [*CELL, "value", "object"]


def _executed(before: DataFrame, statements: dict[str, DataFrame]) -> DataFrame:
    """What holds after every statement, from what holds before it."""
    values = before.filter("field IS NULL").select("stmt", F.col("base").alias("name"), "value", "object")
    objects = values.filter("object").select("stmt", "name", F.col("value").alias("held"))
    to_name = [F.col("to").alias("base"), F.lit(None).cast("string").alias("field"), "value", "object"]
    copied = statements["copy"].join(values, (values["stmt"] == F.col("s")) & (values["name"] == F.col("frm"))).select(F.col("s").alias("stmt"), *to_name)
    read = statements["load"].join(objects, (objects["stmt"] == F.col("s")) & (objects["name"] == F.col("frm"))).select("s", "to", F.col("f"), "held")
    loaded = read.join(before, (before["stmt"] == F.col("s")) & (before["base"] == F.col("held")) & (before["field"] == F.col("f"))).select(F.col("s").alias("stmt"), *to_name)
    aimed = statements["store"].join(objects, (objects["stmt"] == F.col("s")) & (objects["name"] == F.col("to"))).select("s", "frm", "f", "held")
    stored = aimed.join(values, (values["stmt"] == F.col("s")) & (values["name"] == F.col("frm"))).select(F.col("s").alias("stmt"), F.col("held").alias("base"), F.col("f").alias("field"), "value", "object")
    # a write to a variable replaces what it had; one to a field does if it can only mean one object
    names = statements["all"].filter("op <> 'store'").select(F.col("s").alias("stmt"), F.col("to").alias("base"), F.lit(None).cast("string").alias("field"))
    single = aimed.groupBy("s", "f").agg(F.count_distinct("held").alias("n"), F.min("held").alias("base")).filter("n = 1").select(F.col("s").alias("stmt"), "base", F.col("f").alias("field"))
    gone = names.union(single).select(*(F.col(c).alias(f"_{c}") for c in CELL))
    kept = before.join(gone, (F.col("stmt") == F.col("_stmt")) & (F.col("base") == F.col("_base")) & F.col("field").eqNullSafe(F.col("_field")), "left_anti")
    made = statements["make"].select(F.col("s").alias("stmt"), *to_name)
    return made.union(copied).union(loaded).union(stored).union(kept.select(*ROW)).distinct()


def heap_states(statements: DataFrame, edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """What cells hold after each statement, and gaps (``stmt`` whose state still changed when the bound on rounds was met).

    ``statements``: ``stmt``, ``op``, ``to``, ``frm``, ``field``, ``value``, ``object``; one a number: ``make`` (``to`` gets ``value``, an object or not), ``copy`` (``to`` gets what ``frm``
    has), ``load`` (``to`` gets ``frm.field``), ``store`` (``to.field`` gets what ``frm`` has).  ``edges``: ``src``, ``dst`` of statements.  States: ``stmt``, ``base`` (a variable, or an object where ``field``
    is not null), ``field``, ``value``, ``object``.

    A write to a field of what can only be one object replaces what the field had, to one of several adds to each.  So more objects may mean fewer replacements: states do not only grow, and every round
    makes the states of all statements anew from those of the last one, by equi-joins on statement and cell, until two are equal."""
    s = statements.select(F.col("stmt").alias("s"), "op", "to", "frm", F.col("field").alias("f"), F.col("value").cast("string").alias("value"), "object")
    s = written(s, "statements")
    parts = {"all": s, "make": s.filter("op = 'make'")}
    parts |= {k: s.filter(F.col("op") == k).select("s", "to", "frm", "f") for k in ("copy", "load", "store")}
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    state = written(parts["make"].select(F.col("s").alias("stmt"), F.col("to").alias("base"), F.lit(None).cast("string").alias("field"), "value", "object").distinct(), "states")
    n = state.count()
    for _ in range(max_rounds):
        before = state.join(links, F.col("stmt") == F.col("src")).select(F.col("dst").alias("stmt"), *ROW[1:]).distinct()
        new = written(_executed(before, parts), "states")
        m = new.count()
        changed = new.exceptAll(state)
        if n == m and changed.isEmpty():
            return new, links.select(F.col("src").alias("stmt")).limit(0)
        last, state, n = state, new, m
    open_ = state.exceptAll(last).union(last.exceptAll(state)) if max_rounds else state
    return state, written(open_.select("stmt").distinct(), "open-states")
