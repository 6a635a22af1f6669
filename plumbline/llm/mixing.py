"""Mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, salted_join
from plumbline.operators.ranges import row_numbers
from plumbline.session import cut_lineage

#: A rate and a number of copies never exceed this.
MOST = 3
#: Newton's method ends when every source's tokens are this near to its target, relative to it; what is left goes in
#: the rounding. Steps of it between two written states: few, since a step reads its state twice.
NEAR, STEPS, ROUNDS = 1e-7, 2, 40
#: How often the words that rounding leaves over are handed to a cell of smaller documents.
HANDED = 3
#: Bits of a document's hash by which the documents of a cell are counted, twice, to find the last with a copy more.
PREFIX = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(by_source: DataFrame) -> DataFrame:
    """``by_source`` (source, source_size, ...) plus ``sid``, the place of the source, and ``target``: sources by code
    point, null last, weigh 1, 2, 3 in turn and share 100 % of all sizes; what a source can't take at ``MOST`` times
    its size is shared anew by weight among the others.

    A round of the sharing is one aggregate of one row; the sources that are full only grow, so a few rounds end it.
    """
    ranked = row_numbers(by_source, [F.col("source").isNull().asc(), F.col("source").asc()], "sid")
    ranked = cut_lineage(ranked.withColumn("weight", (F.col("sid") - 1) % 3 + 1))
    room, total = MOST * F.col("source_size"), ranked.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, None
    while True:
        full = F.lit(False) if seen is None else room <= level * F.col("weight")
        now = tuple(ranked.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, room))).first())
        if now == seen or not now[0]:
            break
        level, seen = (total - (now[1] or 0)) / now[0], now
    share = level * F.col("weight")
    return ranked.withColumn("target", F.when(room <= share, room.cast("double")).otherwise(share)).drop("weight")


def _rate(t: Column, x: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(t * x, F.lit(50.0))))


def _exact(x: Column) -> Column:
    """A term of a sum as a decimal: the sum is then the same in whatever order tasks add it up."""
    return F.sum(x.cast("decimal(30,8)")).cast("double")


def solve_tilts(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, t) for cells (sid, x, n, tokens) and sources (sid, source_size, target): the tilt with the sum of
    min(MOST, exp(t * x)) * tokens equal to the target, for all sources at once.

    The dual is convex and this sum, its gradient, rises in t. A Newton step is a grouped sum over the cells; steps
    are held inside a bracket that each of them narrows, and one that leaves it is a bisection. The bracket begins at
    the tilts that give every cell the wanted mean rate or more, and the full rate or less, by the smallest x.
    """
    least = cells.groupBy("sid").agg(F.min("x").alias("low_x"))
    share = F.col("target") / F.col("source_size")
    fixed = (share >= MOST) | (share <= 0)
    begin = sources.where("source_size > 0").join(least, "sid").select(
        "sid", "target", F.lit(0.0).alias("t"),
        F.when(share < 1, F.log(share) / F.col("low_x")).otherwise(0.0).alias("lo"),
        F.when(share > 1, F.log(F.lit(float(MOST))) / F.col("low_x")).otherwise(0.0).alias("hi"), fixed.alias("done"),
    )

    def step(state: DataFrame) -> DataFrame:
        r = _rate(F.col("t"), F.col("x"))
        free = F.when(r < MOST, r * F.col("x") * F.col("tokens")).otherwise(F.lit(0.0))
        open_ = state.where("not done").select("sid", "t")
        sums = cells.join(open_, "sid").groupBy("sid").agg(_exact(r * F.col("tokens")).alias("g"), _exact(free).alias("h"))
        g = F.col("g") - F.col("target")
        lo, hi = F.when(g < 0, F.col("t")).otherwise(F.col("lo")), F.when(g > 0, F.col("t")).otherwise(F.col("hi"))
        newton = F.col("t") - F.try_divide(g, F.col("h"))
        moved = F.when(F.coalesce((newton > lo) & (newton < hi), F.lit(False)), newton).otherwise((lo + hi) / 2)
        done = F.col("done") | F.coalesce(F.abs(g) <= NEAR * F.col("target"), F.lit(False))
        return state.join(sums, "sid", "left").select("sid", "target", F.when(done, F.col("t")).otherwise(moved).alias("t"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))

    state = cut_lineage(begin)
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        for _ in range(STEPS):
            state = step(state)
        state = cut_lineage(state)
    return state.select("sid", "t")


def _hand_over(cells: DataFrame) -> DataFrame:
    """``cells`` (sid, size, n, copies, target) with what a source's copies miss its target by made up for, as far as
    one cell can: by copies of the largest size that fits in what is missing or too much."""
    off = cells.groupBy("sid").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    joined = cells.join(off, "sid")
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("off")) & F.when(F.col("off") > 0, F.col("copies") < MOST * F.col("n")).otherwise(F.col("copies") > 0)
    chosen = joined.where(fits).groupBy("sid").agg(F.max("size").alias("take"), F.max("off").alias("by"))
    out = cells.join(chosen, "sid", "left")
    times = F.floor(F.abs("by") / F.col("take"))
    new = F.when(F.col("by") > 0, F.least(F.col("copies") + times, MOST * F.col("n"))).otherwise(F.greatest(F.col("copies") - times, F.lit(0)))
    return out.withColumn("copies", F.when(F.col("size") == F.col("take"), new).otherwise(F.col("copies")).cast("long")).drop("take", "by")


def _last_with_more(base: DataFrame, plan: DataFrame) -> DataFrame:
    """(sid, size, cut): the hash of the last document of each cell that gets a copy more, the ``extra``-th smallest.

    Documents are counted by ``PREFIX`` bits of their hashes, and those of the value where the count passes ``extra``
    by the next bits; what is left, a 65,536th of the cell, is ranked. One exact rule for cells of every size, and no
    task ranks a cell.
    """
    on, rows = ["source_", "none_", "size"], base
    want = plan.where("extra > 0").select(*on, "sid", F.col("extra").alias("rest"))
    for level in (1, 2):
        rows = rows.withColumn("p", F.shiftrightunsigned("u", 63 - level * PREFIX).bitwiseAND(F.lit((1 << PREFIX) - 1)).cast("int"))
        counts = rows.groupBy(*on, "p").agg(F.count(F.lit(1)).alias("c")).join(want, on)
        upto = F.sum("c").over(Window.partitionBy("sid", "size").orderBy("p"))  # at most 2 ** PREFIX rows
        found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("c") < F.col("rest")))
        found = found.select(*on, "p", "sid", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest"))
        rows, want = cut_lineage(rows.join(found.select(*on, "p"), [*on, "p"]).drop("p")), found.drop("p")
    ranked = rows.join(want, on).withColumn("k", F.row_number().over(Window.partitionBy("sid", "size").orderBy("u")))
    return ranked.where("k = rest").select("sid", "size", F.col("u").alias("cut"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, rate, copies, taken.

    Size is the number of words. Within a source, rates minimise the relative entropy to one copy each under the
    constraint that tokens meet the target, with at most ``MOST`` a document: rate = min(MOST, exp(t * size / mean)).
    The documents are counted, before their shuffle, by cells (source, size), and Newton's iterations are grouped sums
    over these for all sources at once; see ``solve_tilts``. Rates become copies by rounding the running sum of copies
    from the largest size down, which leaves at most half the largest document; that is handed to cells of smaller
    ones a few times. Inside a cell, documents with the smallest hashes of their ids get the copy more, in cells of
    every size by one exact rule.

    Defined cases: a null text has size 0; documents of size 0 have one copy and take no words; null is a source of
    its own; a source without words has target 0; rows that repeat an id are decided alike and may miss the rounding by
    that; an empty table gives an empty table; other columns are ignored. Reruns agree, under whatever partitioning:
    the sums that decide are of whole numbers or decimals.
    """
    source = F.col(f"`{source_col}`")
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(source.cast("string"), F.lit("")).alias("source_"), source.isNull().alias("none_"), word_count(F.col(f"`{text_col}`")).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(10), F.col(f"`{id_col}`")), 1).alias("u"),
    )
    base = cut_lineage(base)  # the only pass over the texts
    cells = cut_lineage(base.groupBy("source_", "none_", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cells.groupBy("source_", "none_").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    aims = cut_lineage(targets(sources.withColumn("source", F.when(~F.col("none_"), F.col("source_")))).drop("source"))
    tokens = (F.col("n") * F.col("size")).cast("double")
    cells = cut_lineage(cells.join(aims, ["source_", "none_"]).withColumn("x", F.try_divide(F.col("size").cast("double") * F.col("docs"), F.col("source_size"))).withColumn("tokens", tokens))
    tilts = solve_tilts(cells.where("size > 0").select("sid", "x", "n", "tokens"), aims)

    full = F.col("target") >= MOST * F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(full, float(MOST)).otherwise(_rate(F.col("t"), F.col("x")))
    plan = cells.join(tilts, "sid", "left").withColumn("rate", rate)
    down = Window.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(down)
    plan = plan.withColumn("upto", upto).withColumn("upto_before", F.coalesce(F.lag("upto").over(Window.partitionBy("sid").orderBy(F.desc("size"))), F.lit(0.0)))
    rounded = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto_before") + 0.5)
    copies = F.when((F.col("size") == 0), F.col("n")).otherwise(F.greatest(F.lit(0), F.least(MOST * F.col("n"), rounded))).cast("long")
    plan = plan.select("source_", "none_", "sid", "size", "n", "source_size", "target", "rate", copies.alias("copies"))
    for _ in range(HANDED):
        plan = cut_lineage(_hand_over(plan))
    plan = plan.withColumn("each", F.floor(F.col("copies") / F.col("n"))).withColumn("extra", F.col("copies") % F.col("n"))

    plan = plan.join(_last_with_more(base, plan), ["sid", "size"], "left").select("source_", "none_", "size", "source_size", "target", "rate", "each", F.coalesce("cut", F.lit(-1)).alias("cut"))
    out = salted_join(base, plan, ["source_", "none_", "size"], "u")
    made = F.col("each") + (F.col("u") <= F.col("cut")).cast("int")
    return out.select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", made.cast("int").alias("copies"), (made * F.col("size")).cast("long").alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns as they were.

    Only ids and copies meet the rows, in one join on the id (rows that share an id are decided by their sizes).
    """
    key, size, copies, times = (fresh(docs, x) for x in ("_key", "_size", "_copies", "_times"))
    made = mix(docs, id_col, text_col, source_col)
    # A row that repeats with equal id and size has one decision.
    made = made.groupBy(F.col(id_col).alias(key), F.col("size").alias(size)).agg(F.max("copies").alias(copies))
    own = docs.join(made, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (word_count(F.col(f"`{text_col}`")) == F.col(size)))
    return own.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
