"""Samples and splits of the records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import sampling as S
from plumbline.operators.ranges import row_numbers
from plumbline.plans.catalog import proxy, query, table

SHARES = [("test", 0.6), ("dev", 0.2), ("private", 0.2)]


@query("smp_01_cell_cap", "select id, subtask, expected from (select *, row_number() over (partition by subtask, expected order by quality desc nulls last, md5('cap:' || id)) as rn from records where expected is not null) where rn <= 12")
def cell_cap(spark, sf):
    """At most twelve rows a cell, rows of high quality first, then in a hashed order."""
    r = proxy(spark, sf, "records").where("expected is not null").select("id", "subtask", "expected", "quality")
    return S.cap_per_cell(r, ["subtask", "expected"], 12, F.desc_nulls_last("quality"), S.order_key("cap", "id")).select("id", "subtask", "expected")


@query("smp_02_cell_order", "select id, row_number() over (partition by subtask order by sha256(concat('7:', subtask, ':', id))) as place from records")
def cell_order(spark, sf):
    """An order of its own for each cell."""
    key = F.sha2(F.concat_ws(":", F.lit("7"), "subtask", F.col("id").cast("string")), 256)
    return proxy(spark, sf, "records").select("id", F.row_number().over(Window.partitionBy("subtask").orderBy(key)).cast("long").alias("place"))


@query(
    "smp_03_group_split",
    "with g as (select grp, count(*) as n from records group by grp), c as (select *, coalesce(sum(n) over (order by md5('split:' || grp), grp rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from g) select grp, n, case when before < 0.3 * total then 'dev' else 'test' end as new_split from c",
)
def group_split(spark, sf):
    return S.group_split(proxy(spark, sf, "records"), "grp", 0.3, "split")


ALLOCATION = """
  with s as (select subtask, count(*) as n from records group by subtask), b as (select *, least(n, 20) as base, 200 - sum(least(n, 20)) over () as rest0 from s),
  e as (select *, greatest(rest0, 0) * (n - base)::double / greatest(sum(n - base) over (), 1) as exact from b), w as (select *, floor(exact)::bigint as whole, greatest(rest0, 0) - sum(floor(exact)) over () as rest from e),
  k as (select *, row_number() over (order by round(exact - whole, 9) desc, subtask) as k from w) select subtask, n, least(n, base + whole + (k <= rest)::int)::bigint as take from k
"""


@query("smp_04_allocation", ALLOCATION)
def allocation(spark, sf):
    sizes = proxy(spark, sf, "records").groupBy("subtask").agg(F.count(F.lit(1)).alias("n"))
    return S.allocate(sizes, 200, 20)


@query("smp_05_stratified_draw", f"with a as ({ALLOCATION}) select id, subtask from (select r.id, r.subtask, a.take, row_number() over (partition by r.subtask order by md5('draw:' || r.id)) as rn from records r join a using (subtask)) where rn <= take")
def stratified_draw(spark, sf):
    r = proxy(spark, sf, "records").select("id", "subtask")
    a = S.allocate(r.groupBy("subtask").agg(F.count(F.lit(1)).alias("n")), 200, 20)
    return S.stratified(r, ["subtask"], a, 200, S.order_key("draw", "id"))


@query("smp_06_round_robin", "select id, source from (select id, source, row_number() over (partition by source order by md5('rr:' || id)) as turn from records) order by turn, source limit 50")
def round_robin(spark, sf):
    return S.round_robin(proxy(spark, sf, "records").select("id", "source"), ["source"], 50, S.order_key("rr", "id")).select("id", "source")


@query("smp_07_round_robin_settled", "select id, source from (select id, source, row_number() over (partition by source order by expected is null, md5('rs:' || id)) as turn from records) order by turn, source limit 40")
def round_robin_settled(spark, sf):
    """Turns over sources, labelled rows first."""
    r = proxy(spark, sf, "records").select("id", "source", "expected")
    return S.round_robin(r, ["source"], 40, F.col("expected").isNull(), S.order_key("rs", "id")).select("id", "source")


@query("smp_08_bucketed_targets")
def bucketed_targets(spark, sf):
    """A sequential choice a source: targets by length bucket, two rows a first word, one a group."""
    r = proxy(spark, sf, "records").where("expected is not null")
    word = F.coalesce(F.regexp_extract(F.lower("text"), X.WORD, 0), F.lit(""))
    c = r.select("id", "source", "grp", F.when(F.length("text") < 500, "short").when(F.length("text") < 2500, "medium").otherwise("long").alias("bucket"), word.alias("word"), S.order_key("bt", "id").alias("ord"))
    return S.greedy_buckets(c, "source", "id long, source string, grp long, bucket string, word string", {"short": 2, "medium": 3, "long": 2}, 2)


@query("smp_09_top_up")
def top_up(spark, sf):
    """A second round over what the first left: other groups, the shortfall by bucket."""
    first = bucketed_targets(spark, sf)
    r = proxy(spark, sf, "records").where("expected is not null").join(first.select("grp").distinct(), "grp", "left_anti")
    c = r.select("id", "source", "grp", F.lit("any").alias("bucket"), F.coalesce(F.regexp_extract(F.lower("text"), X.WORD, 0), F.lit("")).alias("word"), S.order_key("tu", "id").alias("ord"))
    return S.greedy_buckets(c, "source", "id long, source string, grp long, bucket string, word string", {"any": 2}, 1)


@query(
    "smp_12_matched_pairs",
    "with n as (select subtask, floor(least(count(*) filter (expected = 'yes'), count(*) filter (expected = 'no')) * 1.25) as most from records where expected is not null group by 1) select id, subtask, expected from (select r.*, n.most, row_number() over (partition by r.subtask, r.expected order by md5('match:' || r.id)) as rn from records r join n using (subtask) where r.expected is not null) where rn <= most",
)
def matched_pairs(spark, sf):
    r = proxy(spark, sf, "records").where("expected is not null").select("id", "subtask", "expected")
    return S.matched(r, ["subtask"], "expected", 1.25, S.order_key("match", "id"))


@query(
    "smp_11_length_quota",
    "with b as (select id, floor(log2(greatest(1, length(text))))::int as bin, md5('lq:' || id) as k from records where text is not null), r as (select *, row_number() over (partition by bin order by k) as rn from b), f as (select id, bin, 1 as pass from r where rn <= 10), s as (select id, bin, 2 as pass from (select *, row_number() over (order by k) as m from r where rn > 10) where m <= 25) select * from f union all select * from s",
)
def length_quota(spark, sf):
    """Ten rows a length bin, then 25 of what is left."""
    b = proxy(spark, sf, "records").where("text is not null").select("id", X.log2_bin(F.length("text")).alias("bin"), S.order_key("lq", "id").alias("k"))
    first = S.cap_per_cell(b, ["bin"], 10, F.col("k"))
    rest = b.join(first.select("id"), "id", "left_anti").orderBy("k").limit(25)
    return first.select("id", "bin", F.lit(1).alias("pass")).union(rest.select("id", "bin", F.lit(2)))


@query("smp_14_quota_with_refill", "with r as (select id, source, row_number() over (partition by source order by md5('q:' || id)) as rn, md5('q:' || id) as k from records where expected is not null), f as (select id from r where rn <= 3), m as (select 70 - count(*) as missing from f), s as (select id from (select id, row_number() over (order by k) as x from r where rn > 3) where x <= (select missing from m)) select id from f union all select id from s")
def quota_with_refill(spark, sf):
    """Three rows a source; what is missing of seventy from the rest."""
    r = proxy(spark, sf, "records").where("expected is not null").select("id", "source", S.order_key("q", "id").alias("k"))
    ranked = r.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("k")))
    first = ranked.where("rn <= 3").select("id")
    missing = max(0, 70 - first.count())  # one number
    return first.union(ranked.where("rn > 3").orderBy("k").limit(missing).select("id"))


HASH_SPLIT = "case when u < 0.6 then 'test' when u < 0.8 then 'dev' else 'private' end"


@query("smp_15_hash_split", f"select id, {HASH_SPLIT} as new_split from (select id, ('0x' || substr(sha256('split:' || grp), 1, 13))::bigint / 4503599627370496.0::double as u from records)")
def hash_split(spark, sf):
    """A split by the hash of the group: no shuffle, and a group never straddles."""
    u = X.unit_interval(F.sha2(F.concat(F.lit("split:"), F.col("grp").cast("string")), 256))
    return proxy(spark, sf, "records").select("id", S.hash_split(u, SHARES).alias("new_split"))


@query("smp_16_rank_split", "select id, case when u < 0.6 then 'test' when u < 0.8 then 'dev' else 'private' end as new_split from (select id, (row_number() over (partition by subtask order by md5('rank:' || id)) - 1)::double / count(*) over (partition by subtask) as u from records)")
def rank_split(spark, sf):
    r = proxy(spark, sf, "records").select("id", "subtask")
    return S.rank_split(r, ["subtask"], SHARES, S.order_key("rank", "id")).select("id", "new_split")


@query("smp_18_rounded_rank_split", "select id, case when rn <= round(0.25 * n) then 'dev' else 'test' end as new_split from (select id, row_number() over (partition by subtask, expected order by md5('rr2:' || id)) as rn, count(*) over (partition by subtask, expected) as n from records where expected is not null)")
def rounded_rank_split(spark, sf):
    w = Window.partitionBy("subtask", "expected")
    r = proxy(spark, sf, "records").where("expected is not null").select("id", F.row_number().over(w.orderBy(S.order_key("rr2", "id"))).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return r.select("id", F.when(F.col("rn") <= F.round(0.25 * F.col("n")), "dev").otherwise("test").alias("new_split"))


@query("smp_21_seeded_halves", "select grp, ntile(2) over (order by md5('half:' || grp)) as half from (select distinct grp from records)")
def seeded_halves(spark, sf):
    g = proxy(spark, sf, "records").select("grp").distinct().withColumn("h", S.order_key("half", "grp"))
    placed = row_numbers(g, [F.col("h").asc(), F.col("grp").asc()])
    n = g.agg(F.count(F.lit(1)).alias("n"))
    return placed.crossJoin(F.broadcast(n)).select("grp", F.when(F.col("at") <= F.ceil(F.col("n") / 2), 1).otherwise(2).cast("long").alias("half"))  # one row


@query("smp_22_balanced_folds")
def balanced_folds(spark, sf):
    """Groups to five folds of even size; no group in two."""
    g = proxy(spark, sf, "records").where("expected is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return S.balanced_folds(g, "grp", "n", 5)


@query("smp_23_pinned_split", "select r.id, coalesce(p.split, case when r.id % 2 = 0 then 'test' else 'dev' end) as new_split from records r left join (select id, split from records where id % 4 = 0) p on r.id = p.id")
def pinned_split(spark, sf):
    """Rows of an earlier release keep their split."""
    r = proxy(spark, sf, "records").select("id", "split")
    before = r.where("id % 4 = 0").select("id", F.col("split").alias("pinned"))
    return r.join(before, "id", "left").select("id", F.coalesce("pinned", F.when(F.col("id") % 2 == 0, "test").otherwise("dev")).alias("new_split"))


@query(
    "smp_24_showcase",
    "with r as (select id, subtask, expected, source, row_number() over (partition by subtask, expected, source order by md5('show:' || id)) as turn from records where expected is not null) select id, subtask, expected from (select *, row_number() over (partition by subtask, expected order by turn, source) as rn from r) where rn <= 6",
)
def showcase(spark, sf):
    """Six rows a subtask and label, sources in turn."""
    r = proxy(spark, sf, "records").where("expected is not null").select("id", "subtask", "expected", "source")
    r = r.withColumn("turn", F.row_number().over(Window.partitionBy("subtask", "expected", "source").orderBy(S.order_key("show", "id"))))
    return S.cap_per_cell(r, ["subtask", "expected"], 6, F.col("turn"), F.col("source")).select("id", "subtask", "expected")


@query("smp_25_capped_pool", "with f as (select user_id, min(event_id) as event_id, event_type from events group by user_id, event_type) select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) as rn from f) where rn <= 2")
def capped_pool(spark, sf):
    """The first event of each type a user has, at most two a user."""
    f = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return S.cap_per_cell(f, ["user_id"], 2, F.col("event_id")).select("user_id", "event_id")
