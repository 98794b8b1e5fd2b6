"""Answers written back under optimistic concurrency: a three-way merge of decision tables.

A writer has read a revision (``base``), changed cells (``mine``), and finds that others have written since (``theirs``).
Cells that one side alone has changed are taken from it; a cell that both have changed to different values is a conflict,
named with its three values. Rows are known by ``key``; a row that one side has removed and the other changed conflicts
as a whole. Null and empty are different values; a repeated key in any table is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Commit, Lost, Store

#: What people write; all else in a decision table is computed or fixed.
HUMAN = ("human_decision", "selected_annotation", "notes")


def merged(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str = "review_id", cells: tuple[str, ...] = HUMAN) -> DataFrame:
    """Rows of all three by one full join: (key, cells, conflicts, gone).

    ``conflicts`` has (cell, base, mine, theirs) for each cell that both changed, with their cell in the row itself;
    ``gone`` says that the row is in neither side's result. All columns besides key and cells come from theirs, else from mine.
    """
    sides = {}
    for name, df in (("base", base), ("mine", mine), ("theirs", theirs)):
        once = df.groupBy(key).agg(F.count("*").alias("times"), F.max(F.struct(*[c for c in df.columns if c != key])).alias("row"))
        sides[name] = once.select(F.col(key).alias("id"), F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit(f"{name} has more than one row "), F.col(key)))).otherwise(F.col("row")).alias(name))
    rows = sides["base"].join(sides["mine"], "id", "full").join(sides["theirs"], "id", "full")
    was, here, there = F.col("base"), F.col("mine"), F.col("theirs")
    had = [s.isNotNull() for s in (was, here, there)]
    found, out, comparable = [], [], had[1] & had[2]
    for c in cells:
        b, m, t = was[c], here[c], there[c]
        both = ~m.eqNullSafe(b) & ~t.eqNullSafe(b) & ~m.eqNullSafe(t)
        found.append(F.when(comparable & both, F.struct(F.lit(c).alias("cell"), b.alias("base"), m.alias("mine"), t.alias("theirs"))))
        out.append(F.when(had[1] & (~had[2] | ~m.eqNullSafe(b)), F.when(comparable & both, t).otherwise(m)).otherwise(t).alias(c))
    changed = [F.lit(False), F.lit(False)]
    for c in cells:
        changed = [changed[0] | ~here[c].eqNullSafe(was[c]), changed[1] | ~there[c].eqNullSafe(was[c])]
    removed = F.when(had[0] & ~had[1] & had[2] & changed[1], "removed here, changed there").when(had[0] & had[1] & ~had[2] & changed[0], "changed here, removed there")
    found.append(F.when(removed.isNotNull(), F.struct(F.lit("row").alias("cell"), F.lit(None).cast("string").alias("base"), F.when(had[1], "changed").otherwise("removed").alias("mine"), F.when(had[2], "changed").otherwise("removed").alias("theirs"))))
    gone = F.when(removed.isNotNull(), ~had[2]).otherwise(had[0] & ~(had[1] & had[2]))
    others = [F.coalesce(there[c], here[c]).alias(c) for c in theirs.columns if c != key and c not in cells]
    return rows.select(F.col("id").alias(key), *others, *out, F.array_compact(F.array(*found)).alias("conflicts"), gone.alias("gone"))


def conflicts(rows: DataFrame, key: str = "review_id") -> DataFrame:
    """(key, cell, base, mine, theirs): one row for each conflict of ``merged``."""
    return rows.select(key, F.explode("conflicts").alias("c")).select(key, "c.*")


def settled(rows: DataFrame) -> DataFrame:
    """The merged table; conflicting cells hold what the other writer wrote."""
    return rows.where("NOT gone").drop("conflicts", "gone")


def write_back(store: Store, mine: DataFrame, base: Commit, table: str = "decisions", key: str = "review_id", cells: tuple[str, ...] = HUMAN, tries: int = 5) -> tuple[Commit | None, DataFrame]:
    """Commit ``mine``, made from ``base``: (commit, conflicts). With conflicts nothing is written and the commit is None.

    Where the store has moved on, the writer's cells are merged with what is there now; the version of ``base`` is kept in
    the store's history, so the merge needs nothing from the other writers. A commit that loses the race is merged again.
    """
    began = store.read(table, base.version)
    for _ in range(tries):
        now = store.current()
        rows = mine
        if now.number != base.number:
            both = merged(began, mine, store.read(table, now.version), key, cells)
            told = conflicts(both, key)
            if told.limit(1).count():
                return None, told
            rows = settled(both)
        try:
            none = store.spark.createDataFrame([], f"{key} string, cell string, base string, mine string, theirs string")
            return store.commit(store.stage({table: rows}), now, "answers"), none
        except Lost:
            continue
    raise Lost(f"{store.path} is written too often; try again")


def edited(answers: DataFrame, edits: DataFrame, allowed: dict[str, tuple[str, ...]], key: str = "review_id") -> DataFrame:
    """``answers`` after ``edits(key, human_decision, selected_annotation, notes)``; a null cell of an edit leaves what was there.

    A KEEP choice selects its side's annotation, and any other choice but MANUAL_FIX none. An edit of a row that isn't there,
    or a choice that its kind of row doesn't offer, is an error.
    """
    kind = F.lit(False)
    for issue, choices in allowed.items():
        kind = kind | ((F.col("issue_type") == issue) & F.col("e.human_decision").isin(*choices))
    told = edits.groupBy(key).agg(F.count("*").alias("times"), F.first(F.struct(*HUMAN)).alias("e"))
    both = answers.join(told, key, "full")
    wrong = (
        F.when(F.col("issue_type").isNull(), F.concat(F.lit("no such row: "), F.col(key)))
        .when(F.col("times") > 1, F.concat(F.lit("edited twice: "), F.col(key)))
        .when(F.col("e.human_decision").isNotNull() & ~kind, F.concat(F.lit("choice not offered: "), F.col(key)))
    )
    d = F.col("e.human_decision")
    selected = F.when(d == "KEEP_A", F.col("annotation_a")).when(d == "KEEP_B", F.col("annotation_b")).when(d == "MANUAL_FIX", F.coalesce("e.selected_annotation", "selected_annotation")).when(d.isNotNull(), F.lit("")).otherwise(F.col("selected_annotation"))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.coalesce(d, "human_decision"))
    new = {"human_decision": checked, "selected_annotation": selected, "notes": F.coalesce("e.notes", "notes")}
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in answers.columns))
