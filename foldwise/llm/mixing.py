"""Operator 4: mixing sources to target weights by iterative proportional fitting.

Token counts are summed once into cells (source, language, topic).  The cells'
weights are raked to the target share of each margin in turn, until the margins
are met within ``TOLERANCE``; then each document is sampled with its cell's
probability.  The sample's size is the token budget: a share of all tokens.  A
cell, and a margin value, gives at most the tokens it has, and the others are
raked to make up for it, so no small cell limits the rest.  Without a budget
(None) the probability is weight / largest weight after a fixed number of rounds.
DataFrame functions only.

A cell table has a row for each combination of margin values that occurs, however
many documents hold it.  Its factors stay in Spark; every few rounds they are
written to shared storage, which cuts the plan.

Defined results: a null margin value is a value of its own; a null text has no
tokens, an empty cell weight 0 and its documents are sampled like the cell's
others; a value without a target, or with target 0, gets weight 0, and a target
without a value is left out; the sampling number is a hash of the id, so repeated
rows and every rerun decide alike (a null id is hashed as an empty one); an empty
table gives an empty table; other columns are carried or not read; a margin named
like a column of the cells (n, docs, w, weight, probability) is an error.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import saved

log = logging.getLogger(__name__)

#: Raking rounds without a budget, and the rounds after which the cells are written out.
ROUNDS, CUT = 8, 2
#: Default targets: observed token shares to this power, normalised.
TEMPER = 0.9
#: Share of the tokens that a sample is to hold; the sum of a margin's differences
#: from its targets, as a share of the sample, at which raking ends; rounds at most.
BUDGET, TOLERANCE, MOST_ROUNDS = 0.8, 1e-4, 60
SEED = "mix"


def tokens(text: str | Column) -> Column:
    """Words between ASCII white space of a text (null: 0)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def topic(text: str | Column) -> Column:
    """A coarse topic from a text's form: table, shouting, note, long prose or
    prose (at least a fiftieth of the characters, and two more, are marks)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.char_length(t)

    def marks(mark: str) -> Column:
        return (n - F.char_length(F.replace(t, F.lit(mark), F.lit("")))) * 50 >= n + 100

    return (F.when(marks("|"), F.lit("table")).when(marks("!!"), F.lit("shouting")).when(n < 200, F.lit("note"))
            .when(n >= 5000, F.lit("long prose")).otherwise(F.lit("prose")))


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from the id's hash, the same in every engine."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / 4294967296.0


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """Targets (value, share) of a margin from its observed token shares."""
    rows = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("n").alias("n")).where("n > 0")
    rows = rows.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("p"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("p").alias("all")))).select("value", (F.col("p") / F.col("all")).alias("share"))


def rake(cells: DataFrame, margins: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margin columns, token count ``n``) with ``weight``: the factor on
    each cell's share of the tokens such that the shares meet the targets (value,
    share) of every margin as nearly as the cells allow."""
    now = cells.withColumn("w", F.col("n").cast("double"))
    for k, (margin, targets) in enumerate(margins.items()):
        # a target is looked up once; a margin value without one gets 0
        t = targets.select(F.col("value").alias("_v"), F.col("share").alias(f"_t{k}"))
        now = (now.join(t, F.col(margin).eqNullSafe(F.col("_v")), "left").drop("_v")
               .withColumn(f"_t{k}", F.coalesce(f"_t{k}", F.lit(0.0))))
    now = saved(now)
    for r in range(rounds):
        for k, margin in enumerate(margins):
            # a margin value's cells, never its documents, meet in one window
            now = now.withColumn("_s", F.sum("w").over(Window.partitionBy(margin)))
            now = now.withColumn("w", F.when(F.col("_s") > 0, F.col("w") * F.col(f"_t{k}") / F.col("_s")).otherwise(0.0)).drop("_s")
        if (r + 1) % CUT == 0:
            now = saved(now)
    total = now.agg(F.sum("n").alias("_all"))
    weight = F.when(F.col("n") > 0, F.col("w") * F.col("_all") / F.col("n")).otherwise(0.0)
    return now.crossJoin(F.broadcast(total)).withColumn("weight", weight).select(*cells.columns, "weight")


def bounded(cells: DataFrame, margin: str, targets: DataFrame, budget: float) -> DataFrame:
    """``value`` and ``goal``, the tokens that each margin value is to give: in
    proportion to its target share, at most those it has, ``budget`` in all."""
    have = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("n").cast("double").alias("have"))
    t = targets.select(F.col("value").alias("_v"), "share")
    have = saved(have.join(t, F.col("value").eqNullSafe(F.col("_v")), "left").select("value", "have", F.coalesce("share", F.lit(0.0)).alias("share")))
    scale = 0.0
    while True:                                        # more values give all they have each time
        full = F.col("share") * scale >= F.col("have")
        r = have.where("share > 0").agg(F.sum(F.when(full, F.col("have"))).alias("full"), F.sum(F.when(~full, F.col("share"))).alias("rest")).first()
        new = (budget - (r.full or 0.0)) / r.rest if r.rest else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return have.select("value", F.least(F.col("share") * scale, F.col("have")).alias("goal"))


def margin_error(cells: DataFrame, margins: list[str]) -> float:
    """The largest, over the margins, of the summed differences between the weights ``w``
    of a margin's values and their goals (``_g0``, ``_g1``, ...); all margins in one query."""
    goal = F.coalesce(*(F.when(F.grouping(m) == 0, F.first(f"_g{k}")) for k, m in enumerate(margins)))
    values = cells.groupingSets([[F.col(m)] for m in margins], *margins).agg(F.grouping_id().alias("_m"), F.abs(F.sum("w") - goal).alias("_d"))
    return values.groupBy("_m").agg(F.sum("_d").alias("_d")).agg(F.max("_d")).first()[0]


def balanced(cells: DataFrame, margins: Mapping[str, DataFrame], budget: float = BUDGET, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` with ``probability`` (at most 1) and ``weight`` (probability over the
    budget) such that the expected tokens meet the targets (value, share) of every
    margin, and the largest margin error that is left."""
    wanted = budget * float(cells.agg(F.sum("n")).first()[0] or 0)
    now = cells.withColumn("w", F.col("n") * F.lit(float(budget)))
    for k, (margin, targets) in enumerate(margins.items()):
        g = bounded(cells, margin, targets, wanted).select(F.col("value").alias("_v"), F.col("goal").alias(f"_g{k}"))
        now = now.join(g, F.col(margin).eqNullSafe(F.col("_v")), "left").drop("_v")
    now = saved(now)
    error, done = float("inf"), 0
    while wanted > 0 and error > tolerance and done < MOST_ROUNDS:
        for _ in range(CUT):
            for k, margin in enumerate(margins):
                now = now.withColumn("_s", F.sum("w").over(Window.partitionBy(margin)))
                raised = F.least(F.col("n").cast("double"), F.col("w") * F.col(f"_g{k}") / F.col("_s"))
                now = now.withColumn("w", F.when(F.col("_s") > 0, raised).otherwise(0.0)).drop("_s")
        now, done = saved(now), done + CUT
        error = margin_error(now, list(margins)) / wanted
    if wanted > 0 and error > tolerance:
        log.warning("mixing: margin error %.6f after %d rounds; the cells do not allow the targets at this budget", error, done)
    chance = F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(0.0)
    return now.select(*cells.columns, (chance / F.lit(float(budget))).alias("weight"), chance.alias("probability")), error if wanted > 0 else 0.0


def _cells(docs: DataFrame, margins: Mapping[str, Column], text: str, targets: Mapping[str, DataFrame] | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cells of ``docs`` by ``margins`` with their token count, and every margin's targets."""
    if taken := {"n", "docs", "w", "weight", "probability"} & set(margins):
        raise ValueError(f"mixing: margins can't be named {sorted(taken)}")
    cells = saved(docs.select(*(c.alias(m) for m, c in margins.items()), tokens(text).alias("_n"))
                  .groupBy(*margins).agg(F.sum("_n").alias("n"), F.count("*").alias("docs")))
    goals = {m: (targets or {}).get(m) for m in margins}
    return cells, {m: tempered(cells, m) if g is None else g for m, g in goals.items()}


def calibrated(docs: DataFrame, margins: Mapping[str, Column], text: str = "text", rounds: int = ROUNDS,
               targets: Mapping[str, DataFrame] | None = None, budget: float | None = BUDGET) -> DataFrame:
    """Cells of ``docs`` by ``margins`` (name -> column) with their token count,
    raked weight and sampling probability."""
    cells, goals = _cells(docs, margins, text, targets)
    if budget is not None:
        return balanced(cells, goals, budget)[0]
    raked = rake(cells, goals, rounds)
    top = raked.agg(F.max("weight").alias("top"))
    return raked.crossJoin(F.broadcast(top)).withColumn(
        "probability", F.when(F.col("top") > 0, F.col("weight") / F.col("top")).otherwise(0.0)).drop("top")


def report(docs: DataFrame, margins: Mapping[str, Column] | None = None, text: str = "text", targets: Mapping[str, DataFrame] | None = None,
           budget: float = BUDGET) -> dict[str, float]:
    """Expected shares of the documents and tokens that a sample keeps, and the margin error."""
    out, error = balanced(*_cells(docs, margins or default_margins(), text, targets), budget)
    r = out.agg(*((F.sum(F.col("probability") * F.col(c)) / F.sum(c)).alias(c) for c in ("docs", "n"))).first()
    return {"documents": r.docs or 0.0, "tokens": r.n or 0.0, "margin_error": error}


def default_margins() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic("text")}


def decided(docs: DataFrame, margins: Mapping[str, Column] | None = None, id_col: str = "doc_id", text: str = "text",
            rounds: int = ROUNDS, targets: Mapping[str, DataFrame] | None = None, budget: float | None = BUDGET) -> DataFrame:
    """One row per row of ``docs``: its margin values, tokens, the weight and
    probability of its cell, and whether it is sampled.  The join on the cells
    splits a hot cell's rows, as each finds one cell row."""
    margins = dict(margins or default_margins())
    cells = calibrated(docs, margins, text, rounds, targets, budget)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(m) for m, c in margins.items()), tokens(text).alias("n_tokens"))
    on = None
    for m in margins:
        same = F.col(m).eqNullSafe(F.col("_" + m))
        on = same if on is None else on & same
    found = rows.join(cells.select(*(F.col(m).alias("_" + m) for m in margins), "weight", "probability"), on)
    return found.select("doc_id", *margins, "n_tokens", "weight", "probability",
                        (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, margins: Mapping[str, Column] | None = None, id_col: str = "doc_id", text: str = "text",
           rounds: int = ROUNDS, targets: Mapping[str, DataFrame] | None = None, budget: float | None = BUDGET) -> DataFrame:
    """The sampled rows of ``docs``."""
    margins = dict(margins or default_margins())
    cells = calibrated(docs, margins, text, rounds, targets, budget)
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names)), *(c.alias(f"m{i}") for i, c in enumerate(margins.values())))
    on = None
    for i in range(len(margins)):
        same = F.col(f"m{i}").eqNullSafe(F.col(f"_m{i}"))
        on = same if on is None else on & same
    chances = cells.select(*(F.col(m).alias(f"_m{i}") for i, m in enumerate(margins)), "probability")
    row_id = names[docs.columns.index(id_col)]
    kept = keyed.join(chances, on).where(uniform(F.col(row_id)) < F.col("probability"))
    return kept.select(*names).toDF(*docs.columns)
