"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Among all document rates that meet the token constraints, entropy balancing takes
those nearest to 1 in relative entropy: rate = exp(lambda of the source), or with a
second constraint exp(lambda of the source + mu of the group), where lambda and mu
maximise the concave dual. Newton's method needs sums of words by (source, group)
only. The sources' block of the Hessian is diagonal and stays a distributed table,
one row for each source; the groups' block, which couples with it, is reduced to
its Schur complement, a matrix as small as the stated list of groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import materialize, packed, ranked, table

#: No document is taken more often.
MOST_COPIES = 3
#: Newton steps of disjoint sources that run between two tests of convergence, relative error at which they end, and most tests.
NEWTON_STEPS, TOLERANCE, NEWTON_ROUNDS = 8, 1e-9, 100
#: Most groups of a second constraint: their matrix is solved on the driver.
GROUPS = 1000
#: Draws are 52-bit numbers. The search for a source's last draw goes by buckets of 2**36 and 1 draws, so a source has
#: up to 65,536 rows in the first round and that part of its documents in the second.
DRAW_BITS, SEARCH = 52, (36, 0)
#: After a source's first document that no longer fits, later ones that do fill the rest; so many times.
FILLS = 2
WORDS = r"[^\x20\x09-\x0D]+"
NEW = ["mix_size", "mix_draw", "mix_source_size", "mix_target", "mix_rate", "mix_copies"]


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def draw(key: Column, text: Column) -> Column:
    """A fixed pseudo-random number below 2**52 for each id and text; only repeated rows share one."""
    of_text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), of_text).cast("binary")), 1, 13), 16, 10).cast("long")


def same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source``, nulls equal."""
    return left.join(right.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def targets(sums: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``weight`` and ``target`` for each (source, words) row, as a written table.

    Weights repeat along the sources by code point, null last. Targets share the
    sum of all words by weight; one stops at ``most`` times its source's words
    and what is over goes to the others by weight. That is the water level
    t with target = min(most * words, weight * t): each round stops the sources
    that t overflows, whose sums give the next, higher t, until none is added.
    No source table is collected or gathered in one task.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int")).cast("long")
    weighed = ranked(sums.select("source", "words"), [F.col("source").asc_nulls_last()], "rank")
    weighed = materialize(weighed.select("source", "words", weight.alias("weight"), (F.lit(most) * F.col("words")).cast("long").alias("stop")), "mix-weights")
    level, known = 0.0, None
    while True:
        stopped = (F.col("stop") < F.col("weight") * F.lit(level)) if known is not None else F.lit(False)
        sums_of = lambda c, of: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0))
        found = weighed.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("all"), sums_of("stop", stopped).alias("held"), sums_of("weight", ~stopped).alias("free"), F.count_if(stopped).alias("n")).first()
        if found.n == known or not found.free:
            break
        known, level = found.n, float(found.all - found.held) / float(found.free)
    return weighed.select("source", "words", "weight", F.least(F.col("stop").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def tilt(x: Column, words: Column, target: Column) -> Column:
    """lambda of each source after some steps of Newton's method on the dual from ``x``; 0 for a source without words."""
    step = lambda x, _: x + (target - words * F.exp(x)) / (words * F.exp(x))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), x, step)
    return F.when((words > 0) & (target > 0), solved).otherwise(F.lit(0.0))


def solve(sources: DataFrame) -> DataFrame:
    """``sources`` (source, words, target) with ``tilt``, when the sources are the only constraint.

    The Hessian is diagonal then, so each source takes its own steps, side by
    side; after every few a sum over all sources tells whether the dual's
    gradient has vanished.
    """
    now = sources.withColumn("tilt", F.lit(0.0))
    for _ in range(NEWTON_ROUNDS):
        now = materialize(now.withColumn("tilt", tilt(F.col("tilt"), F.col("words").cast("double"), F.col("target"))), "mix-newton")
        error = F.abs(F.col("words") * F.exp("tilt") - F.col("target")) / F.col("target")
        if (now.filter("words > 0 AND target > 0").agg(F.max(error)).first()[0] or 0.0) <= TOLERANCE:
            return now
    raise ArithmeticError("Newton's method has not converged")


def balance(cells: DataFrame, sources: DataFrame, groups: dict[str, float]) -> tuple[DataFrame, dict[str, float]]:
    """(``sources`` with ``tilt``, mu of each group) for two overlapping constraints.

    ``cells``: words by (source, group), ``sources``: (source, words, target),
    ``groups``: target words of each group, at most GROUPS of them. Each
    iteration is a pass over the cells with the full Hessian; it ends when no
    constraint is off by more than TOLERANCE of all words. Both kinds of targets
    must have the same sum and be within reach of positive rates; otherwise
    ArithmeticError.
    """
    names = sorted(groups)
    if len(names) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    spark, mu = cells.sparkSession, np.zeros(len(names))
    total = sum(groups.values())
    now = materialize(sources.withColumn("tilt", F.lit(0.0)), "mix-newton")
    number = spark.createDataFrame([(g, i) for i, g in enumerate(names)], "group string, g int")
    cells = materialize(cells.filter("words > 0").join(F.broadcast(number), "group").select("source", "g", F.col("words").cast("double").alias("words")), "mix-cells")
    for _ in range(NEWTON_ROUNDS):
        rate = F.exp(F.col("tilt") + F.element_at(F.array(*map(F.lit, mu.tolist())), F.col("g") + 1))
        rows = same(cells, now.select("source", "tilt", "target")).withColumn("r", F.col("words") * rate)
        by_source = rows.groupBy("source", "tilt", "target").agg(F.sum("r").alias("d"), F.collect_list(F.struct("g", "r")).alias("cells"))
        by_source = materialize(by_source.withColumn("gap", F.col("target") - F.col("d")), "mix-step")
        pairs = by_source.select("d", "gap", F.explode("cells").alias("a"), "cells").select("d", "gap", "a", F.explode("cells").alias("b"))
        matrix, right, got = np.zeros((len(names), len(names))), np.array([groups[g] for g in names], float), np.zeros(len(names))
        for r in pairs.groupBy(F.col("a.g").alias("i"), F.col("b.g").alias("j")).agg(F.sum(F.col("a.r") * F.col("b.r") / F.col("d")).alias("x")).collect():
            matrix[r.i, r.j] -= r.x
        for r in by_source.select("d", "gap", F.explode("cells").alias("a")).groupBy(F.col("a.g").alias("i")).agg(F.sum("a.r").alias("r"), F.sum(F.col("a.r") * F.col("gap") / F.col("d")).alias("x")).collect():
            matrix[r.i, r.i] += r.r
            got[r.i], right[r.i] = r.r, right[r.i] - r.r - r.x
        worst = by_source.agg(F.max(F.abs("gap"))).first()[0] or 0.0
        if max(worst, max((abs(got[i] - groups[g]) for i, g in enumerate(names)), default=0.0)) <= TOLERANCE * max(total, 1.0):
            return now, dict(zip(names, mu.tolist(), strict=True))
        step = np.linalg.lstsq(matrix, right, rcond=1e-12)[0]  # a constant can move from lambda to mu: the least step is taken
        step = np.clip(step, -2.0, 2.0)
        moved = F.aggregate("cells", F.lit(0.0), lambda x, c: x + c["r"] * F.element_at(F.array(*map(F.lit, step.tolist())), c["g"] + 1))
        change = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("gap") - moved) / F.col("d")))
        mu = mu + step
        now = materialize(same(sources, by_source.select("source", (F.col("tilt") + change).alias("tilt")), "left").fillna(0.0, ["tilt"]), "mix-newton")
    raise ArithmeticError("the constraints contradict each other")


def _last_draws(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Where each source (source, after, gap) crosses its gap: (source, cross, before, tied, each).

    Only documents with a later draw than ``after`` and of at most ``gap`` words
    count; sources that never cross are left out. ``before``: words of the draws
    below ``cross``; there stand ``tied`` rows of ``each`` words.
    """
    found, above = state.select("source", "after", "gap", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before")), DRAW_BITS
    for shift in SEARCH:
        inside = same(rows, found).filter((F.col("draw") > F.col("after")) & (F.col("size") <= F.col("gap")) & (F.shiftright("draw", above) == F.col("bucket")))
        buckets = inside.groupBy("source", "after", "gap", "before", F.shiftright("draw", shift).alias("at")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("tied"), F.max("size").alias("each"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("at"))
        over = buckets.withColumn("upto", upto).filter("upto > gap").groupBy("source", "after", "gap").agg(F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"), "tied", "each")).alias("x"))
        found = over.select("source", "after", "gap", F.col("x.at").alias("bucket"), "x.before", "x.tied", "x.each")
        found, above = materialize(found, "mix-crossing") if shift else found, shift
    return found.select("source", F.col("bucket").alias("cross"), "before", "tied", "each")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """How often to take each document so that each source's words come near its target.

    ``docs`` has doc_id, source and either ``mix_size`` (its words) and
    ``mix_draw`` or text. Returns its columns and those of NEW (replaced if
    present, but for the two above); names that begin with _mix_ are for use
    within. ``take`` keeps columns of any name.

    Rates become whole copies in a fixed order: every document of a source is
    taken floor(rate) times, and once more those with the smallest draws (hashes
    of doc_id and text), as many as fit into what is left of the target; after
    the first that does not fit, later and smaller ones fill the rest. The last
    draws are found by rounds of sums over hash buckets, so no source meets in
    one task, and reruns agree. Repeated rows share a draw; where it is the last,
    as many of them are taken as fit.

    Null texts and empty texts have size 0; null sources are one source, the
    last; rows with a null id differ by their texts. Sources without any word
    keep their documents once. Empty tables give empty results.
    """
    docs, rows = _sized(docs)
    return _rounded(docs, rows, solve(targets(rows.groupBy("source").agg(F.sum("size").alias("words")), cycle, most)), most)


def mix_groups(docs: DataFrame, group: str, groups: dict[str, float], cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``mix`` under a second constraint: the column ``group`` shares all words as ``groups`` weighs its values.

    Targets of sources and of groups overlap, so rates follow from both (see
    ``balance``) and become copies within each (source, group), whose targets
    mix_target and mix_source_size then are. Documents whose group is not listed are left out;
    rates above ``most`` are cut to it.
    """
    docs = docs.filter(F.col(group).isin(*groups))
    docs, rows = _sized(docs, group)
    cells = materialize(rows.groupBy("source", F.col("group").cast("string").alias("group")).agg(F.sum("size").alias("words")), "mix-cells")
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("words")), cycle, most)
    total, weights = sources.agg(F.sum("target")).first()[0] or 0.0, sum(groups.values())
    tilts, mu = balance(cells, sources, {g: total * w / weights for g, w in groups.items()})
    of_group = F.element_at(F.create_map(*[F.lit(x) for pair in mu.items() for x in pair]), F.col("group"))
    cell = F.to_json(F.struct("source", "group"))
    rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") + of_group))
    units = same(cells, tilts.select("source", "tilt")).select(cell.alias("source"), "words", (F.col("words") * rate).alias("target"), F.log(rate).alias("tilt"))
    renamed = docs.withColumn("_mix_own", F.struct(F.col("source"))).withColumn("source", F.to_json(F.struct("source", F.col(group).cast("string").alias("group"))))
    mixed = _rounded(renamed, rows.withColumn("source", cell), materialize(units, "mix-units"), most)
    return mixed.withColumn("source", F.col("_mix_own")["source"]).drop("_mix_own")


def _sized(docs: DataFrame, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with sizes and draws, and a written table of (source, size, draw)."""
    if not {"mix_size", "mix_draw"} <= set(docs.columns):
        docs = docs.withColumns({"mix_size": word_count(F.col("text")), "mix_draw": draw(F.col("doc_id"), F.col("text"))})
    docs = docs.drop(*NEW[2:])
    own = [F.col(group).cast("string").alias("group")] if group else []
    return docs, materialize(docs.select("source", *own, F.col("mix_size").alias("size"), F.col("mix_draw").alias("draw")), "mix-rows")


def _rounded(docs: DataFrame, rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Rates as copies: ``sources`` has source, words, target and tilt, the log of its documents' rate."""
    base = F.floor(F.exp("tilt") + 1e-9).cast("long")
    sources = sources.withColumn("rate", F.exp("tilt")).withColumn("base", base)
    # Half a word more, so that a target is rounded to the nearest whole one.
    state = sources.select("source", F.lit(-1).cast("long").alias("after"), (F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("words")) + 0.5).alias("gap"))
    steps = []
    for _ in range(FILLS + 1):
        state = same(state, _last_draws(rows, state), "left")
        left = F.when(F.col("each") > 0, F.floor((F.col("gap") - F.col("before")) / F.col("each"))).otherwise(0).cast("long")
        state = materialize(state.withColumn("some", left), "mix-step")
        steps.append(state.select("source", F.struct("after", "cross", "gap", "some", "tied").alias("step")))
        state = state.filter("cross IS NOT NULL").select("source", F.col("cross").alias("after"), (F.col("gap") - F.col("before") - F.col("some") * F.col("each")).alias("gap"))
    rounds = steps[0]
    for more in steps[1:]:
        rounds = rounds.union(more)
    rounds = rounds.groupBy("source").agg(F.collect_list("step").alias("_mix_steps"))
    known = sources.select("source", F.col("words").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"), F.col("base").alias("_mix_base"))
    known = materialize(same(known, rounds), "mix-known")

    at = F.col("mix_draw")
    taken = F.exists("_mix_steps", lambda s: (at > s["after"]) & (s["cross"].isNull() | (at < s["cross"])) & (F.col("mix_size") <= s["gap"]))
    whole = F.exists("_mix_steps", lambda s: (at == s["cross"]) & (s["some"] >= s["tied"]) & (F.col("mix_size") <= s["gap"]))
    partly = F.exists("_mix_steps", lambda s: (at == s["cross"]) & (s["some"] > 0) & (s["some"] < s["tied"]) & (F.col("mix_size") <= s["gap"]))
    copies = lambda once: F.when(F.col("mix_source_size") == 0, 1).otherwise(F.least(F.lit(most), F.col("_mix_base") + F.when(once, 1).otherwise(0))).cast("long")
    marked = same(docs, known)
    if known.filter(F.exists("_mix_steps", lambda s: (s["some"] > 0) & (s["some"] < s["tied"]))).isEmpty():
        return marked.withColumn("mix_copies", copies(taken | whole)).drop("_mix_base", "_mix_steps")
    # Repeated rows at a last draw: numbered within their draw, the first ones are taken.
    plain = marked.filter(~F.coalesce(partly, F.lit(False))).withColumn("mix_copies", copies(taken | whole))
    tied = ranked(marked.filter(partly), [F.col("source").asc_nulls_first(), F.col("mix_draw")], "_mix_rank", by=["source", "mix_draw"])
    some = F.aggregate("_mix_steps", F.lit(0).cast("long"), lambda n, s: F.when(at == s["cross"], s["some"]).otherwise(n))
    tied = tied.withColumn("mix_copies", copies(F.col("_mix_rank") < some)).drop("_mix_rank")
    return plain.unionByName(tied).drop("_mix_base", "_mix_steps")


def take(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """The mixed corpus: each document as many times as ``mix`` says, with its own columns, whatever their names.

    Nulls, ties, repeated rows and empty tables are as ``mix`` has them.
    """
    rows = docs.select("doc_id", "source", packed(docs), word_count(F.col("text")).alias("mix_size"), draw(F.col("doc_id"), F.col("text")).alias("mix_draw"))
    mixed = mix(rows, cycle, most).filter("mix_copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("mix_size"), draw(F.col("doc_id"), F.col("text")).alias("mix_draw"))
    mixed = mix(materialize(sized, "mix-sizes"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def _sql_rounds() -> str:
    """SQL for the rounds of taking what fits: tables t0, t1, ... of rows taken and g1, g2, ... of what is left."""
    out = []
    for k in range(FILLS + 1):
        out.append(f"""f{k} AS (
  SELECT d.rid, d.source, d.size, d.draw, g.gap, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.rid ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN g{k} g ON d.source IS NOT DISTINCT FROM g.source WHERE d.draw > g.after AND d.size <= g.gap
), g{k + 1} AS (
  SELECT source, min(draw) FILTER (upto > gap) AS after, any_value(gap) - coalesce(max(upto) FILTER (upto <= gap), 0) AS gap FROM f{k} GROUP BY source HAVING count(*) FILTER (upto > gap) > 0
)""")
    return ", ".join(out)


OP9_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS draw
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM docs GROUP BY source
), levels AS (
  SELECT *, CAST(sum(words) OVER () - coalesce(sum(3 * words) OVER e, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS DOUBLE) AS level
  FROM sums WINDOW e AS (ORDER BY CAST(3 * words AS DOUBLE) / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), known AS (
  SELECT source, words, least(CAST(3 * words AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels
), based AS MATERIALIZED (
  SELECT *, CASE WHEN words = 0 THEN 1 ELSE floor(target / words + 1e-9) END AS base FROM known
), g0 AS (
  SELECT source, CAST(-1 AS BIGINT) AS after, greatest(0, target - base * words) + 0.5 AS gap FROM based
), {_sql_rounds()}, once AS (
  {" UNION ALL ".join(f"SELECT rid FROM f{k} WHERE upto <= gap" for k in range(FILLS + 1))}
)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
       CAST(least(3, base + CASE WHEN o.rid IS NOT NULL THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM docs d JOIN based b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN once o ON o.rid = d.rid
"""
