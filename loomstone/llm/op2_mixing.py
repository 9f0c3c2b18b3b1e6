"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source shall give a target number of words, and no document more than ``most`` times its own. Among all rates that do
so, the mix takes those closest in relative entropy over words to the corpus as it is. The convex dual has a multiplier per
source and, if a covariate is given, one that all sources share, for the token constraint that the covariate's mean over words
stays what it is in the corpus. A document's rate is ``exp(its source's multiplier + shared multiplier * covariate)``, ``most`` at
most. Newton iterations from the corpus as it is solve the dual: each is one distributed aggregation of gradient and Hessian
over the classes of documents that are equal in source, size and covariate; the Hessian is diagonal with one border, so a
Schur complement gives the step, which is halved while the dual does not fall. They end when every constraint is met within
``TOLERANCE`` of its total, or the shared multiplier stands at ``TILT``.

Rates become copies: every document gets the whole part of its rate, and the rest of its source's target goes as one further
copy to documents in an order by a digest of their ids (divided by the fraction of the rate, if that differs within a source),
up to a cut, so that only one copy a source is partial. The cut is found by aggregating ranges of that order, ranges within
one of them, and so on, and then the rows of the last; rows then need only what is known per source, so none is moved but
where several equal rows lie at a cut.

Nothing is ordered in one task but the ranges of one level (32 a source), the rows of one of a million ranges, and partition counts;
names are numbered by ranges, and the sharing of the excess is a loop of aggregations. Only single rows come to the driver.

Defined results: a null or empty text has size 0 and takes 0; null is a source like others, ordered last; equal ids with
equal sizes are interchangeable; a source without words has target 0; a null covariate counts as 0; other columns are not
looked at and may have any name; a very long text is counted in the JVM, with no more memory than itself; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm.common import Scratch, any_row, table

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
TOLERANCE = 1e-11
#: Aggregations at most; largest step of a source's multiplier and of the shared one; largest size of the shared one.
PASSES, STEP, SHARED_STEP, TILT = 80, 2.0, 0.5, 1.0
#: The order of a source's documents has 2 ** BITS ranges, which are narrowed down LEVEL bits at a time.
BITS, LEVEL = 20, 5
SOURCE = ["missing", "name"]


def word_count(text: str) -> Column:
    """Number of words: the length of what is left when each word is its first character and white space is gone."""
    pattern = rf"^{SPACE}+|([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+{SPACE}*+"
    return F.coalesce(F.length(F.regexp_replace(F.col(text), pattern, "$1")), F.lit(0)).cast("long")


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def targets(sources: DataFrame, scratch: Scratch, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """For each source (columns missing, name, source_size) its ``target``, and ``full`` if that is its cap, ``most`` times its
    size. Weights repeat over the sources in the order of their names, null last; what sources at their caps leave is
    shared again by weight, until none is above its cap."""
    laid = scratch.cut(sources.repartitionByRange(*SOURCE).sortWithinPartitions(*SOURCE).withColumn("at", F.monotonically_increasing_id()), "sources")
    parts = laid.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    parts = parts.select("part", before.alias("parts_before"))
    number = F.col("parts_before") + F.expr("at & 8589934591L")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    s = laid.join(parts, F.shiftright("at", 33) == F.col("part")).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    s = scratch.cut(s.select(*SOURCE, "source_size", "weight", "cap", (F.col("cap") / F.col("weight")).alias("fills_at")), "weighed")
    words, all_weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), _sum(F.col("weight"))).first()
    total, capped, open_weight, n = share * words, 0.0, all_weight, 0
    while True:
        level = (total - capped) / open_weight if open_weight > 0 else math.inf
        capped, full_weight, now = s.where(F.col("fills_at") <= level).agg(_sum(F.col("cap")), _sum(F.col("weight")), F.count(F.lit(1))).first()
        open_weight = all_weight - full_weight
        if now == n:
            break
        n = now
    full = F.col("fills_at") <= level
    return scratch.cut(s.select(*SOURCE, "source_size", full.alias("full"), F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target")), "targets")


def rate_of(shared: float, mean: float, most: float) -> Column:
    tilted = F.least(F.lit(most), F.exp(F.col("multiplier") + F.lit(shared) * (F.col("x") - F.lit(mean))))
    return F.when(F.col("target") <= 0, 0.0).when(F.col("full"), F.lit(most)).otherwise(tilted)


def balance(classes: DataFrame, sources: DataFrame, scratch: Scratch, constrained: bool, most: float = MOST) -> tuple[DataFrame, float, float, dict]:
    """Solves the dual. classes: missing, name, size, x (the covariate), n; sources: those of ``targets``. Gives sources with
    ``multiplier``, the shared multiplier, the mean of x, and what the last pass measured: passes, residual (largest share of its
    target that a source's rates miss), shared_residual (what the rates move x from its mean, as a share of its spread).
    constrained: whether the mean of x is a constraint."""
    words = F.col("n") * F.col("size")
    w, wx = classes.agg(F.coalesce(F.sum(words), F.lit(0)), _sum(words * F.col("x"))).first()
    mean = wx / w if w else 0.0
    spread = classes.agg(_sum(words * F.abs(F.col("x") - F.lit(mean)))).first()[0]
    judged = (F.col("target") > 0) & ~F.col("full")
    state, shared, base, t = sources.withColumn("multiplier", F.lit(0.0)), 0.0, None, 1.0
    for k in range(1, PASSES + 1):
        x = F.col("x") - F.lit(mean)
        z = F.col("multiplier") + F.lit(shared) * x
        c = classes.join(state, SOURCE).withColumn("rate", rate_of(shared, mean, most)).withColumn("dx", x).withColumn("words", words)
        free = judged & (F.col("rate") < most)
        loss = F.when(~judged, F.col("rate") * F.lit(shared) * F.col("dx")).when(free, F.exp(z)).otherwise(F.lit(most) * (z + (1 - math.log(most))))
        given, of_free = F.col("words") * F.col("rate"), F.when(free, F.col("words") * F.col("rate"))
        g = c.groupBy(*SOURCE, "source_size", "target", "full", "multiplier").agg(
            F.sum(given).alias("given"), _sum(of_free).alias("b"), _sum(of_free * F.col("dx")).alias("c1"), _sum(of_free * F.col("dx") * F.col("dx")).alias("c2"), F.sum(given * F.col("dx")).alias("drift"),
            F.sum(F.col("words") * loss).alias("loss"), F.max(F.lit(math.log(most)) - F.lit(shared) * F.col("dx")).alias("bound_at"),
        )
        g = scratch.cut(g.withColumn("gap", F.when(judged, F.col("given") - F.col("target")).otherwise(0.0)), "gradient")
        live = judged & (F.col("b") > 0)
        m = g.agg(
            F.coalesce(F.max(F.when(judged, F.abs("gap") / F.col("target"))), F.lit(0.0)).alias("residual"), _sum(F.col("drift")).alias("drift"), _sum(F.col("c2")).alias("c2"),
            _sum(F.when(live, F.col("c1") * F.col("c1") / F.col("b"))).alias("c11"), _sum(F.when(live, F.col("c1") * F.col("gap") / F.col("b"))).alias("c1g"),
            _sum(F.col("loss") - F.when(judged, F.col("multiplier") * F.col("target")).otherwise(0.0)).alias("dual"),
        ).first()
        moved = abs(m["drift"]) / spread if constrained and spread > 0 else 0.0
        found = {"passes": k, "residual": m["residual"], "shared_residual": moved}
        if m["residual"] <= TOLERANCE and (moved <= TOLERANCE or abs(shared) >= TILT and m["drift"] * shared < 0):
            break
        if base and m["dual"] > base["dual"] + 1e-12 * abs(base["dual"]) and t > 1e-3:
            t /= 2
        else:
            bend = m["c2"] - m["c11"]
            step = (m["c1g"] - m["drift"]) / bend if moved > TOLERANCE and bend > 1e-12 * spread else 0.0
            step = max(-TILT, min(TILT, shared + max(-SHARED_STEP, min(SHARED_STEP, step)))) - shared
            base, t = {"g": g, "dual": m["dual"], "shared": shared, "step": step}, 1.0
        shared = base["shared"] + t * base["step"]
        own = F.when(F.col("b") > 0, -(F.col("gap") + F.col("c1") * F.lit(base["step"])) / F.col("b")).otherwise(F.col("bound_at") - F.col("multiplier") - 0.1)
        moving = F.when(judged, F.lit(t) * F.greatest(F.lit(-STEP), F.least(F.lit(STEP), own))).otherwise(0.0)
        state = base["g"].select(*SOURCE, "source_size", "target", "full", (F.col("multiplier") + moving).alias("multiplier"))
    return g.select(*SOURCE, "source_size", "target", "full", "multiplier"), shared, mean, found


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, covariate=None, with_row: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies
    (whole ones), rate, and, if asked for, ``row``, a struct of the row's own columns. covariate: a function from the column of
    sizes to a numeric column whose mean over words the mix keeps, such as ``log_size``."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    d = docs.select(
        F.col(id_col).alias("doc_id"), word_count(text_col).alias("size"), F.col(source_col).isNull().alias("missing"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("digest"), *([F.struct(*docs.columns).alias("row")] if with_row else []),
    )
    d = d.withColumn("x", F.lit(0.0) if covariate is None else F.coalesce(covariate(F.col("size")).cast("double"), F.lit(0.0)))
    light = scratch.cut(d.drop("row"), "sizes")
    classes = scratch.cut(light.groupBy(*SOURCE, "size", "x").agg(F.count(F.lit(1)).alias("n")), "classes")
    s = targets(classes.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), scratch, share, weights, most)
    s, shared, mean, _ = balance(classes, s, scratch, covariate is not None, most)
    rate = rate_of(shared, mean, most)
    whole = F.floor(rate + 1e-9)
    rest = F.round("target").cast("long") - F.sum(whole * F.col("n") * F.col("size"))
    s = scratch.cut(classes.join(s, SOURCE).groupBy(*s.columns).agg(rest.alias("more")), "rates")

    def ordered(rows: DataFrame) -> DataFrame:
        """rows with rate, whole, and their place in their source's order: range, key, digest, doc_id, size."""
        r = rows.join(s, SOURCE).withColumn("rate", rate).withColumn("whole", whole)
        if covariate is None:
            return r.withColumn("key", F.lit(0.0)).withColumn("range", F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), 32 - BITS))
        part = F.col("rate") - F.col("whole")
        key = F.when(part > 1e-9, F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / F.lit(float(16**13)) / part).otherwise(F.lit(1e18))
        return r.withColumn("key", key).withColumn("range", F.least(F.floor(F.col("key") * (1 << BITS - 2)), F.lit((1 << BITS) - 1)))  # nearly all keys are below 4

    place = lambda: F.struct("key", "digest", "doc_id", "size")
    before = lambda by, words: F.coalesce(F.sum(words).over(W.partitionBy(*SOURCE).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = (F.col("start") < F.col("more")) & (F.col("more") <= F.col("start") + F.col("words"))
    rows = ordered(light.where("size > 0")).select(*SOURCE, "more", "range", "size", place().alias("place"))
    at = s.select(*SOURCE, F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("base"))
    for shift in range(BITS - LEVEL, -1, -LEVEL):  # the cut is in one range of a level, and in one of the ranges within that
        inside = rows.join(at, SOURCE).where(F.shiftright("range", shift + LEVEL) == F.col("cut"))
        sums = inside.groupBy(*SOURCE, "more", "base", F.shiftright("range", shift).alias("part")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("start", F.col("base") + before("part", F.col("words"))).where(here)
        at = scratch.cut(sums.select(*SOURCE, F.col("part").alias("cut"), F.col("start").alias("base")), "ranges")
    inside = rows.join(at, SOURCE).where(F.col("range") == F.col("cut")).groupBy(*SOURCE, "more", "base", "place").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("words"))
    cuts = inside.withColumn("start", F.col("base") + before("place", F.col("words"))).where(here).select(*SOURCE, F.col("place").alias("cut"), (F.col("more") - F.col("start")).alias("left"), "many")
    s = scratch.cut(s.join(cuts, SOURCE, "left"), "cuts")

    r = ordered(d if with_row else light).withColumn("place", place())
    tie = F.coalesce((F.col("place") == F.col("cut")) & (F.col("many") > 1) & (F.col("size") > 0), F.lit(False))
    if any_row(s.where("many > 1")):  # equal rows at a cut: they are numbered, partition by partition
        ties = scratch.cut(r.where(tie).withColumn("at", F.monotonically_increasing_id()), "ties")
        part = F.shiftright("at", 33)
        starts = ties.groupBy(*SOURCE, part.alias("part")).agg(F.count(F.lit(1)).alias("words")).withColumn("start", before("part", F.col("words"))).drop("words")
        number = F.col("start") + F.row_number().over(W.partitionBy(*SOURCE, "part").orderBy("at")) - 1
        ties = ties.withColumn("part", part).join(starts, [*SOURCE, "part"]).withColumn("number", number).select(*r.columns, "number")
        r = r.where(~tie).withColumn("number", F.lit(0).cast("long")).unionByName(ties)
    else:
        r = r.withColumn("number", F.lit(0).cast("long"))
    extra = F.when(F.col("cut").isNull() | (F.col("place") > F.col("cut")), 0).when(F.col("place") < F.col("cut"), F.col("size"))
    extra = extra.otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("number") * F.col("size"))))
    r = r.withColumn("taken", (F.col("whole") * F.col("size") + extra).cast("long"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return r.select("doc_id", "size", "source_size", "target", "taken", copies.alias("copies"), "rate", *(["row"] if with_row else []))


def log_size(size: Column) -> Column:
    """A covariate: the logarithm of a document's number of words."""
    return F.log(F.greatest(size, F.lit(1)).cast("double"))


def materialise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus, with the columns of docs: every document as many times as the mix takes it, the last time cut after
    the words taken."""
    m = mix(docs, text_col=text_col, with_row=True, **options)
    rest = F.when(F.col("size") > 0, F.col("taken") - F.col("copies") * F.col("size")).otherwise(0)
    times = F.sequence(F.lit(1), F.col("copies") + (F.col("rest") > 0).cast("int"))
    m = m.withColumn("rest", rest).where("copies > 0 or rest > 0").withColumn("copy", F.explode(times))
    text = F.col("row")[text_col]
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"({SPACE}*{WORD})")), 1, F.greatest(F.col("rest"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("copy") > F.col("copies"), cut).otherwise(text)
    return m.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
f AS (SELECT *, CAST(2.0 AS DOUBLE) * source_size AS cap, CAST(2.0 AS DOUBLE) * source_size / weight AS fills_at, CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(source_size) AS BIGINT) FROM s) AS total FROM s),
g AS (SELECT *, fills_at <= (total - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER b, 0)) AS is_full FROM f
      WINDOW b AS (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * ((total - coalesce((SELECT sum(cap) FROM g WHERE is_full), 0)) / (SELECT sum(weight) FROM g WHERE NOT is_full)) END AS target FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(floor(rate + 1e-9) * size + greatest(0, least(size, round(target) - floor(rate + 1e-9) * source_size - pos)) AS BIGINT) AS taken FROM r)
SELECT doc_id, size, source_size, target, taken, CAST(CASE WHEN size > 0 THEN floor(taken / size) ELSE 0 END AS INTEGER) AS copies, round(rate, 6) AS rate FROM x
"""
QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL = {"op2_mixing": SQL}
