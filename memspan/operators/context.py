"""Context assembly: ranked sections in a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.functions import scores


def fits(lines: DataFrame, order: list[Column], budget: int, line: str = "line", most: int = 300) -> DataFrame:
    """The lines, of the first ``most``, before the one that exceeds the budget: a section stops there.

    One task sums up the few lines that are left of any number.
    """
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.orderBy(*order).limit(most).withColumn("tokens", scores.token_estimate(F.col(line))).withColumn("used", F.sum("tokens").over(window)).where(F.col("used") <= budget)


def packed_sections(lines: DataFrame, budget: int) -> DataFrame:
    """``section, pos, line`` that fit: each section stops at its first overflow, later ones go on with what is left.

    Sections have stated limits, so all lines are a small array, which one fold passes through.
    """
    rows = lines.select(F.struct("section", "pos", "line", scores.token_estimate(F.col("line")).alias("n")).alias("r"))
    listed = rows.agg(F.array_sort(F.collect_list("r")).alias("rows"))
    item = rows.schema["r"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("shut"), F.array().cast(f"array<{item}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fit = (x["section"] != acc["shut"]) & (acc["used"] + x["n"] <= budget)
        return F.struct(
            F.when(fit, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"),
            F.when(fit, acc["shut"]).otherwise(x["section"]).alias("shut"),
            F.when(fit, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
        )

    return listed.select(F.explode(F.aggregate("rows", start, step, lambda a: a["kept"])).alias("r")).select("r.section", "r.pos", "r.line")


def section(number: int, rows: DataFrame, order: list, line: Column, most: int) -> DataFrame:
    """A section's first ``most`` rows as lines."""
    few = rows.orderBy(*order).limit(most)
    return few.select(F.lit(number).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("pos"), F.concat(line, F.lit("\n")).alias("line"))


def outcome_icon(outcome: Column) -> Column:
    return F.when(outcome == "committed", "✓").when(outcome == "uncommitted", "○").otherwise("•")


def memory_lines(told: DataFrame, order: list) -> DataFrame:
    return section(1, told, order, F.concat(F.lit("- ["), "category", F.lit("] **"), "title", F.lit("**: "), "content"), 10)


def fact_lines(facts: DataFrame) -> DataFrame:
    """Known facts ``id, fact, confidence, strength``, the surest first."""
    return section(2, facts.where("strength > 0.3 and fact <> ''"), [F.desc("confidence"), "id"], F.concat(F.lit("- "), "fact"), 10)


def procedure_lines(procedures: DataFrame) -> DataFrame:
    """Known procedures ``id, name, steps, trigger_condition, frequency, strength``, the most frequent first."""
    known = procedures.where("strength > 0.3 and name <> '' and size(steps) > 0")
    return section(3, known, [F.desc("frequency"), "id"], F.concat(F.lit("- **"), "name", F.lit("** (when: "), F.coalesce("trigger_condition", F.lit("")), F.lit("): "), F.array_join("steps", " -> ")), 5)


def observation_lines(obs: DataFrame, project: str) -> DataFrame:
    seen = obs.where((F.col("project") == project) & (F.col("importance") >= 4))
    return section(4, seen, [F.desc("ts_us"), "id"], F.concat(F.lit("- **"), "title", F.lit("**: "), "narrative"), 20)


def run_lines(runs: DataFrame, project: str, order: list | None = None) -> DataFrame:
    """Outcomes of the project's closed runs with a lesson, the latest first if no order is given."""
    closed = runs.where((F.col("project") == project) & F.expr("ended_s is not null and lesson <> ''"))
    line = F.concat(F.lit("- "), outcome_icon(F.col("outcome")), F.lit(" **"), F.substring(F.coalesce("prompt", F.lit("")), 1, 60), F.lit("...**: "), "lesson")
    return section(5, closed, order or [F.desc("ended_s"), "id"], line, 8)


def core_lines(block: DataFrame) -> DataFrame:
    """The rendered core memory ``block``, as a section of one line that goes first."""
    return block.where("block <> ''").limit(1).select(F.lit(0).alias("section"), F.lit(1).alias("pos"), F.col("block").alias("line"))


HEADERS = {1: "# Saved memories", 2: "# Known facts", 3: "# Procedures", 4: "# Recent observations", 5: "# Recent task outcomes"}


def rendered(lines: DataFrame) -> DataFrame:
    """One text of packed lines; headers are not charged to the budget."""
    heads = F.create_map(*(F.lit(x) for pair in HEADERS.items() for x in pair))
    told = lines.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("body"))
    text = F.concat(F.coalesce(F.concat(heads[F.col("section")], F.lit("\n\n")), F.lit("")), F.col("body"))
    return told.select("section", text.alias("text")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n").alias("context"))
