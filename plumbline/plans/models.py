"""Whether labels can be told by shortcuts: simple scorers, out-of-fold models, gates over cells, controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import metrics
from plumbline.operators import shortcuts as S
from plumbline.operators.boards import unit_hash
from plumbline.plans.catalog import proxy, query, table

FOLD_SQL = "(('0x' || substr(md5('fold:' || grp), 1, 8))::bigint % 3)::int"
LABELLED = f"select id, grp, source, split, text, (expected = 'yes')::int as y, {FOLD_SQL} as fold from records where expected is not null and text is not null"
TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


def labelled(spark, sf):
    r = proxy(spark, sf, "records").where("expected is not null and text is not null")
    return r.select("id", "grp", "source", "split", "text", (F.col("expected") == "yes").cast("int").alias("y"), S.fold_of(F.col("grp")).alias("fold"))


def auroc_sql(rows: str, keys: str = "name") -> str:
    """AUROC of (keys, y, score) rows by mean ranks."""
    return f"""select {keys}, round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / nullif(count(*) filter (y = 1) * count(*) filter (y = 0), 0), 6) as auroc
    from (select *, (rank() over (partition by {keys} order by score) + (count(*) over (partition by {keys}, score) - 1) / 2.0)::double as rk from ({rows})) group by {keys}"""


def auroc(rows, keys):
    return metrics.auroc(rows.withColumn("positive", F.col("y") == 1), keys)


RATE_SQL = f"""select r.id, r.y, coalesce((t.s - f.s)::double / nullif(t.n - f.n, 0), (a.s - b.s)::double / (a.n - b.n)) as score from ({LABELLED}) r
  join (select source, sum(y) as s, count(*) as n from ({LABELLED}) group by 1) t on t.source is not distinct from r.source join (select source, fold, sum(y) as s, count(*) as n from ({LABELLED}) group by 1, 2) f on f.source is not distinct from r.source and f.fold = r.fold
  cross join (select sum(y) as s, count(*) as n from ({LABELLED})) a join (select fold, sum(y) as s, count(*) as n from ({LABELLED}) group by 1) b on b.fold = r.fold"""
GAP_SQL = f"""select fold, token, gap from (select *, row_number() over (partition by fold order by gap desc, token) as rn from (
  select f.fold, t.token, t.p - coalesce(x.p, 0) as p, t.q - coalesce(x.q, 0) as q, round((t.p - coalesce(x.p, 0))::double / greatest(a.p - f.p, 1) - (t.q - coalesce(x.q, 0))::double / greatest(a.q - f.q, 1), 9) as gap
  from (select token, sum(y) as p, sum(1 - y) as q from (select y, unnest({TOKENS}) as token from ({LABELLED})) group by 1) t cross join (select fold, sum(y) as p, sum(1 - y) as q from ({LABELLED}) group by 1) f cross join (select sum(y) as p, sum(1 - y) as q from ({LABELLED})) a
  left join (select token, fold, sum(y) as p, sum(1 - y) as q from (select y, fold, unnest({TOKENS}) as token from ({LABELLED})) group by 1, 2) x on x.token = t.token and x.fold = f.fold) where p > 0 and p + q >= 3) where rn <= 20"""
RULE_SQL = f"with g as ({GAP_SQL}), t as (select id, fold, unnest({TOKENS}) as token from ({LABELLED})), h as (select t.id, count(*) as n from t join g on g.fold = t.fold and g.token = t.token group by 1) select r.id, r.y, coalesce(h.n, 0)::double as score from ({LABELLED}) r left join h on h.id = r.id"
SCORERS_SQL = f"select id, y, 'regex' as name, regexp_matches(text, '[0-9]{{3}}')::int::double as score from ({LABELLED}) union all select id, y, 'keywords', (contains(lower(text), 'token')::int + contains(lower(text), '@')::int + contains(lower(text), 'please')::int)::double from ({LABELLED}) union all select id, y, 'length', length(text)::double from ({LABELLED})"


@query("ml_02_out_of_fold", f"select id, y, round(score, 9) as score from ({RATE_SQL})")
def out_of_fold_rate(spark, sf):
    """Rows scored by the other folds alone: the rate of their source there."""
    return S.left_out_rate(labelled(spark, sf), "source").select("id", "y", F.round("score", 9).alias("score"))


@query("ml_03_target_rate", f"select source, fold, round((sum(sum(y)) over (partition by source) - sum(y))::double / nullif(sum(count(*)) over (partition by source) - count(*), 0), 9) as rate from ({LABELLED}) group by 1, 2")
def target_rate(spark, sf):
    """The rate of each category as its other folds have it; none where they don't have the category."""
    rows = labelled(spark, sf)
    by = rows.groupBy("source", "fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    total = by.groupBy("source").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return by.join(total, "source").select("source", "fold", F.round(F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")), 9).alias("rate"))


@query("ml_04_gap_tokens", GAP_SQL)
def gap_tokens(spark, sf):
    """Tokens that positive texts have more often than negative ones, by the other folds."""
    return S.top_gap_tokens(labelled(spark, sf))


@query("ml_05_token_rule", RULE_SQL)
def token_rule(spark, sf):
    rows = labelled(spark, sf)
    return S.token_rule(rows, S.top_gap_tokens(rows))


def scorers(rows):
    t, low = F.col("text"), F.lower("text")
    made = {"regex": t.rlike("[0-9]{3}").cast("double"), "keywords": sum((low.contains(w).cast("double") for w in ("token", "@", "please")), F.lit(0.0)), "length": F.length(t).cast("double")}
    return rows.withColumn("x", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), s.alias("score")) for n, s in made.items()]))).select(*rows.columns, "x.*")


@query("ml_06_plain_scorers", SCORERS_SQL)
def plain_scorers(spark, sf):
    """Scores that read next to nothing: a pattern, a few words, the length."""
    return scorers(labelled(spark, sf)).select("id", "y", "name", "score")


@query(
    "ml_01_separability",
    f"with a as ({auroc_sql(f'select * from ({SCORERS_SQL}) union all select id, y, {chr(39)}source rate{chr(39)}, round(score, 9) from ({RATE_SQL}) union all select id, y, {chr(39)}token rule{chr(39)}, score from ({RULE_SQL})')}) select name, auroc, round(greatest(auroc, 1 - auroc), 6) as separability, case when auroc >= 0.5 then 'higher' else 'lower' end as direction, greatest(auroc, 1 - auroc) <= 0.75 as fit from a",
)
def separability(spark, sf):
    """How far each baseline tells the classes apart, and whether that is little enough."""
    rows = labelled(spark, sf)
    parts = scorers(rows).select("name", "y", "score")
    parts = parts.union(S.left_out_rate(rows, "source").select(F.lit("source rate"), "y", F.round("score", 9))).union(S.token_rule(rows, S.top_gap_tokens(rows)).select(F.lit("token rule"), "y", "score"))
    a = auroc(parts, ["name"]).withColumn("auroc", F.round("auroc", 6))
    worst = F.greatest(F.col("auroc"), 1 - F.col("auroc"))
    return a.select("name", "auroc", F.round(worst, 6).alias("separability"), F.when(F.col("auroc") >= 0.5, "higher").otherwise("lower").alias("direction"), (worst <= 0.75).alias("fit"))


def worded(rows, *kinds, buckets):
    """(id, y, fold, inner) and the hashed n-grams of each kind: no row of what goes on holds its n-grams as strings."""
    inner = F.pmod((F.xxhash64("grp") % 2 + 1).cast("int"), F.lit(2)).alias("inner")
    made = {"char": S.char_ngrams(F.col("text")).alias("chars"), "word": X.words(F.col("text")).alias("words")}
    return S.hashed(rows.select("id", "y", "fold", inner, *[made[k] for k in kinds]), kinds, buckets)


@query("ml_07_ngram_lasso")
def ngram_lasso(spark, sf):
    """Out-of-fold AUROC of a sparse logistic regression on character n-grams."""
    scored = S.out_of_fold(worded(labelled(spark, sf), "char", buckets=1 << 15), S.ngram_model)
    return auroc(scored.withColumn("name", F.lit("char n-grams, L1")), ["name"]).select("name", F.round("auroc", 3).alias("auroc"))


@query("ml_08_ngram_ridge")
def ngram_ridge(spark, sf):
    """The same with squared penalty for characters and for words, its strength chosen on inner folds by group."""
    rows, out = worded(labelled(spark, sf), "char", "word", buckets=1 << 14), None
    for kind in ("char", "word"):
        scored = S.out_of_fold(rows, lambda train, kind=kind: S.chosen_model(train, kind)).withColumn("name", F.lit(kind))
        out = scored if out is None else out.union(scored)
    return auroc(out, ["name"]).select("name", F.round("auroc", 3).alias("auroc"))


NUISANCE = ["source", "licence", "size"]


@query("ml_09_nuisance_models")
def nuisance_models(spark, sf):
    """What source, licence and length alone tell: one-hot under a logistic regression, and boosted trees."""
    r = proxy(spark, sf, "records").where("expected is not null and text is not null")
    rows = r.select("id", (F.col("expected") == "yes").cast("int").alias("y"), S.fold_of(F.col("grp")).alias("fold"), "source", "licence", X.log2_bin(F.length("text")).cast("string").alias("size")).cache()
    out = None
    for trees in (False, True):
        scored = S.out_of_fold(rows, lambda train, trees=trees: S.nuisance_model(train, NUISANCE, trees)).withColumn("name", F.lit("trees" if trees else "one-hot"))
        out = scored if out is None else out.union(scored)
    return auroc(out, ["name"]).select("name", F.round("auroc", 3).alias("auroc"))


@query(
    "ml_10_masked_texts",
    "with s as (select id, text, greatest(instr(text, '@') - 1, 0) as a, case when instr(text, '@') > 0 then least(instr(text, '@') + 9, length(text)) else 0 end as b from records where contains(text, '@')) select id, md5(substr(text, 1, a) || '[MASK]' || substr(text, b + 1)) as masked, md5(substr(text, greatest(a - 40, 0) + 1, a - greatest(a - 40, 0)) || '[MASK]' || substr(text, b + 1, 40)) as neighbours from s",
)
def masked_texts(spark, sf):
    """A text without its span, and only what stands around it: what a model may read that must not see the span."""
    s = proxy(spark, sf, "records").where(F.col("text").contains("@")).select("id", "text", (F.instr("text", F.lit("@")) - 1).alias("a"), F.least(F.instr("text", F.lit("@")) + 9, F.length("text")).alias("b"))
    rest = F.substring("text", F.col("b") + 1, F.length("text"))
    begin = F.greatest(F.col("a") - 40, F.lit(0))
    return s.select(
        "id", F.md5(F.concat(F.substring("text", F.lit(1), F.col("a")), F.lit("[MASK]"), rest)).alias("masked"),
        F.md5(F.concat(F.substring("text", begin + 1, F.col("a") - begin), F.lit("[MASK]"), F.substring("text", F.col("b") + 1, F.lit(40)))).alias("neighbours"),
    )


CELLS_SQL = f"select s.name, v.view, r.source, s.y, s.score from ({SCORERS_SQL}) s join ({LABELLED}) r on r.id = s.id join (select 'all' as view union all select 'test') v on v.view = 'all' or r.split = 'test'"


def cells(spark, sf):
    rows = scorers(labelled(spark, sf))
    return rows.withColumn("view", F.explode(F.when(F.col("split") == "test", F.array(F.lit("all"), F.lit("test"))).otherwise(F.array(F.lit("all")))))


@query("ml_11_gate_cells", f"with a as ({auroc_sql(CELLS_SQL, 'name, view, source')}), n as (select name, view, source, count(*) as n, count(distinct y) as classes from ({CELLS_SQL}) group by 1, 2, 3) select n.name, n.view, n.source, n.n, a.auroc, case when classes < 2 then 'one class' when greatest(auroc, 1 - auroc) > 0.75 then 'fail' else 'pass' end as verdict from n join a on a.name = n.name and a.view = n.view and a.source is not distinct from n.source")
def gate_cells(spark, sf):
    """Every scorer on every view and subset against the bound: one grouped pass over exploded cells."""
    keys, x = ["name", "view", "source"], cells(spark, sf)
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes"))
    j = n.join(auroc(x, keys), keys, "left").withColumn("auroc", F.round("auroc", 6))
    verdict = F.when(F.col("classes") < 2, "one class").when(F.greatest(F.col("auroc"), 1 - F.col("auroc")) > 0.75, "fail").otherwise("pass")
    return j.select(*keys, "n", "auroc", verdict.alias("verdict"))


@query("ml_12_strata_report", f"select r.fold, r.split, count(*) as n, sum(r.y)::bigint as positives, round(avg(length(r.text)) filter (r.y = 1), 6) as mean_positive, round(avg(length(r.text)) filter (r.y = 0), 6) as mean_negative from ({LABELLED}) r group by 1, 2")
def strata_report(spark, sf):
    n, y = F.length("text"), F.col("y")
    return labelled(spark, sf).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.round(F.avg(F.when(y == 1, n)), 6).alias("mean_positive"), F.round(F.avg(F.when(y == 0, n)), 6).alias("mean_negative"))


@query(
    "ml_13_compared_subsets",
    f"""with f as (select y, 'source' as facet, source as value from ({LABELLED}) union all select y, 'split', split from ({LABELLED}) union all select y, 'long', (length(text) > 5000)::varchar from ({LABELLED}) union all select y, 'tail', (id % 50)::varchar from ({LABELLED})),
    c as (select facet, value, sum(y)::bigint as p, sum(1 - y)::bigint as q from f group by 1, 2), a as (select sum(y)::bigint as p, sum(1 - y)::bigint as q from ({LABELLED}))
    select facet, value, case when c.p = 0 then a.p else c.p end as n_pos, case when c.q = 0 then a.q else c.q end as n_neg, c.p = 0 or c.q = 0 as against_all from c cross join a""",
)
def compared_subsets(spark, sf):
    """Subsets by facet; one that holds a single class is compared with all rows of the other."""
    rows = labelled(spark, sf)
    facets = {"source": F.col("source"), "split": F.col("split"), "long": (F.length("text") > 5000).cast("string"), "tail": (F.col("id") % 50).cast("string")}
    f = rows.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in facets.items()])).alias("f")).select("y", "f.*")
    c = f.groupBy("facet", "value").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    all_ = rows.agg(F.sum("y").alias("ap"), F.sum(1 - F.col("y")).alias("aq"))
    j = c.crossJoin(F.broadcast(all_))  # one row
    return j.select("facet", "value", F.when(F.col("p") == 0, F.col("ap")).otherwise(F.col("p")).alias("n_pos"), F.when(F.col("q") == 0, F.col("aq")).otherwise(F.col("q")).alias("n_neg"), ((F.col("p") == 0) | (F.col("q") == 0)).alias("against_all"))


CONTROLS_SQL = f"select 'planted' as name, y, (y = 1 and ('0x' || substr(md5('plant:' || id), 1, 8))::bigint / 4294967296.0 < 0.3)::int::double as score from ({LABELLED}) union all select 'shuffled', (('0x' || substr(md5('shuffle:' || grp), 1, 8))::bigint % 2)::int, length(text)::double from ({LABELLED})"


@query("ml_14_controls", f"with a as ({auroc_sql(CONTROLS_SQL)}) select name, auroc, case when name = 'planted' then auroc >= 0.6 else abs(auroc - 0.5) < 0.15 end as as_expected from a")
def controls(spark, sf):
    """A planted signal must be found and labels dealt at random by group must not be."""
    rows = labelled(spark, sf)
    planted = (F.col("y") == 1) & (unit_hash(F.lit("plant"), F.col("id")) < 0.3)
    dealt = (F.conv(F.substring(F.md5(F.concat(F.lit("shuffle:"), F.col("grp").cast("string"))), 1, 8), 16, 10).cast("long") % 2).cast("int")
    x = rows.select(F.lit("planted").alias("name"), "y", planted.cast("double").alias("score")).union(rows.select(F.lit("shuffled"), dealt, F.length("text").cast("double")))
    a = auroc(x, ["name"]).withColumn("auroc", F.round("auroc", 6))
    return a.withColumn("as_expected", F.when(F.col("name") == "planted", F.col("auroc") >= 0.6).otherwise(F.abs(F.col("auroc") - 0.5) < 0.15))


@query("ml_15_linear_probe")
def linear_probe(spark, sf):
    """Held-out AUROC of a linear probe on vectors, whole and on their first principal components."""
    v = S.as_vectors(table(spark, sf, "embeddings").where("label is not null"), "embedding")
    rows = v.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("y"), (F.col("vec_id") % 5 == 0).alias("held"), "v").cache()
    out = None
    for name, dims in (("whole", None), ("8 components", 8)):
        scored = S.probe(rows.where("not held"), dims).transform(rows.where("held")).select(F.lit(name).alias("name"), "y", F.element_at(S.vector_to_array("probability"), 2).alias("score"))
        out = scored if out is None else out.union(scored)
    return auroc(out, ["name"]).select("name", F.round("auroc", 3).alias("auroc"))


@query("xtr_30_top_features")
def top_features(spark, sf):
    """The words that a sparse model of all rows leans on most, either way."""
    rows = labelled(spark, sf).select("y", X.words(F.col("text")).alias("words")).cache()
    return S.top_features(rows).select("token", F.round("weight", 3).alias("weight"))


@query("xtr_76_views_of_rows", f"select r.id, v.view, case v.view when 'cv' then 'fold ' || r.fold when 'halves' then case when r.fold % 2 = 0 then 'train' else 'report' end else case when r.split = 'test' then 'report' else 'train' end end as role from ({LABELLED}) r cross join (select 'cv' as view union all select 'halves' union all select 'transfer') v")
def views_of_rows(spark, sf):
    """Every row in each view with the part that it has there."""
    fold = F.col("fold")
    roles = {"cv": F.concat(F.lit("fold "), fold.cast("string")), "halves": F.when(fold % 2 == 0, "train").otherwise("report"), "transfer": F.when(F.col("split") == "test", "report").otherwise("train")}
    return labelled(spark, sf).select("id", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), r.alias("role")) for v, r in roles.items()])).alias("x")).select("id", "x.*")

