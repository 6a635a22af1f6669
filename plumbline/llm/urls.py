"""URL filters: rules first, then a path-template tree for each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import UPPER, salted_join
from plumbline.session import cut_lineage

#: (verdict, rule): the host up to the first slash, the path from it on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first :// and the next /, ? or #, A-Z in lower case; then up to ? or #."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(ordered):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segment_type(segment: Column) -> Column:
    """A segment with what varies by its form generalised: numbers, hex and ids, an ending kept."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    body = F.when(end != "", F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")).otherwise(segment)
    kind = (
        F.when(body.rlike(r"^[0-9]+$"), "{n}")
        .when(body.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{id}")
        .when(body.rlike(r"^(?=.*[0-9])[A-Za-z0-9_-]{16,}$"), "{id}")
        .otherwise(body)
    )
    return F.concat(kind, end)


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\x00", *parts))


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


def grow(leaves: DataFrame, variable_children: int) -> DataFrame:
    """``leaves`` (host, leaf, typed, ...) plus ``steps``: the leaf's way from its host's root, a wildcard wherever a
    node has more than ``variable_children`` different segments below it.

    A round goes down one branching of all hosts at once: what all leaves of a node have in common is one step, so
    the number of rounds is that of branchings on one path, not of its segments.
    """
    state = leaves.withColumns({"steps": F.array().cast("array<string>"), "rest": F.col("typed")})
    done = None
    while True:
        state = cut_lineage(state.withColumn("node", _key("host", F.to_json("steps"))))
        ended = state.where(F.size("rest") == 0).drop("node", "rest")
        done = ended if done is None else done.union(ended)
        state = state.where(F.size("rest") > 0)
        if state.isEmpty():
            return done
        joined = F.array_join("rest", "/")
        stats = state.groupBy("node").agg(F.count_distinct(F.col("rest")[0]).alias("kids"), F.min(joined).alias("low"), F.max(joined).alias("high"))
        # Of sorted strings the first and the last differ where any two do.
        equal = F.transform(F.arrays_zip(F.split("low", "/").alias("a"), F.split("high", "/").alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
        common = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)) - 1, F.size(equal))
        stats = stats.select("node", "kids", F.when(F.col("kids") == 1, common).otherwise(1).cast("int").alias("jump")).where("kids > 1 or jump > 0")
        state = salted_join(state, stats, ["node"], "leaf")
        step = F.when(F.col("kids") > variable_children, "*").otherwise(F.array_join(F.slice("rest", F.lit(1), F.col("jump")), "/"))
        left = F.slice("rest", F.col("jump") + 1, F.size("rest"))
        state = state.withColumns({"steps": F.concat("steps", F.array(step)), "rest": left}).drop("kids", "jump", "node")


def merge_alike(leaves: DataFrame, alike: float) -> DataFrame:
    """``leaves`` (host, steps, bad, lab, ...) with statistically similar sibling branches made one, bottom up.

    From the deepest level to the first: siblings whose subtrees have the same templates form a group, and a member
    stays apart if its share of blocked labels differs from the rest's by more than ``alike`` standard errors (two
    proportions). A branch without labels is judged by those of the same branch on other hosts of the suffix, and one
    without any has nothing against it. The others become one branch, named after the
    first of them with a plus, which one level up makes their parents alike in turn.
    """
    top = leaves.agg(F.max(F.size("steps"))).first()[0] or 0
    for level in range(top, 0, -1):
        way = F.to_json(F.slice("steps", 1, level - 1))
        parent = _key(F.col("host"), way)
        tree = leaves.where(F.size("steps") >= level).groupBy("host", "steps").agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab"))
        below = F.xxhash64(F.to_json(F.slice(F.col("steps"), F.lit(level + 1), F.size("steps"))))
        node = [parent.alias("parent"), _key(suffix_of(F.col("host")), way, F.col("steps")[level - 1]).alias("like"), F.col("steps")[level - 1].alias("seg"), F.col("host")]
        sibs = cut_lineage(tree.groupBy(*node).agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab"), F.bit_xor(below).alias("shape")))
        others = sibs.groupBy("like").agg(F.sum("bad").alias("sbad"), F.sum("lab").alias("slab")).where("slab > 0")
        sibs = salted_join(sibs, others, ["like"], "host", "left")
        own = F.col("lab") > 0
        sibs = sibs.withColumns({"bad": F.when(own, F.col("bad")).otherwise(F.coalesce("sbad", F.lit(0))), "lab": F.when(own, F.col("lab")).otherwise(F.coalesce("slab", F.lit(0)))})
        group = Window.partitionBy("parent", "shape")  # siblings: at most as many as a node may have
        rest_bad, rest_lab = F.sum("bad").over(group) - F.col("bad"), F.sum("lab").over(group) - F.col("lab")
        pooled = F.try_divide(F.sum("bad").over(group), F.sum("lab").over(group))
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("lab")) + F.try_divide(F.lit(1), rest_lab)))
        apart = F.coalesce(F.abs(F.try_divide(F.col("bad"), F.col("lab")) - F.try_divide(rest_bad, rest_lab)) > alike * error, F.lit(False))
        sibs = sibs.withColumn("apart", apart)
        among = Window.partitionBy("parent", "shape", "apart")
        named = sibs.withColumns({"first": F.min("seg").over(among), "many": F.count(F.lit(1)).over(among)}).where("not apart and many > 1")
        named = named.select("parent", "seg", F.concat("first", F.lit("+")).alias("named"))
        keyed = leaves.withColumn("parent", F.when(F.size("steps") >= level, parent)).withColumn("seg", F.get("steps", F.lit(level - 1)))
        joined = salted_join(keyed, named, ["parent", "seg"], "leaf", "left")
        swapped = F.concat(F.slice("steps", 1, level - 1), F.array("named"), F.slice(F.col("steps"), F.lit(level + 1), F.size("steps")))
        leaves = cut_lineage(joined.withColumn("steps", F.when(F.col("named").isNotNull(), swapped).otherwise(F.col("steps"))).drop("parent", "seg", "named"))
    return leaves


def purities(leaves: DataFrame, rate: float, prior_weight: float, inherit: float) -> DataFrame:
    """(host, steps, labelled, purity) of each template: its share of blocked labels, smoothed down the tree.

    From the root on, a node's share is smoothed by ``prior_weight`` labels at the share of the same node on other
    hosts of the suffix (the last label of the host), and that by as many at what the node inherits: its parent's
    smoothed share, moved a part of 1 - ``inherit`` back to the rate of all labels. So labels reach branches that have
    none, the less the further off they are.
    """
    tree = leaves.groupBy("host", "steps").agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab"))
    ways = tree.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("steps"))))
    ways = ways.withColumns({"way": F.to_json(F.slice("steps", F.lit(1), F.col("depth"))), "suffix": suffix_of(F.col("host"))})
    nodes = cut_lineage(ways.groupBy("suffix", "host", "way").agg(F.sum("bad").alias("nbad"), F.sum("lab").alias("nlab")))
    cross = nodes.groupBy("suffix", "way").agg(F.sum("nbad").alias("sbad"), F.sum("nlab").alias("slab"))
    nodes = salted_join(nodes, cross, ["suffix", "way"], "host").drop("suffix")
    seen = salted_join(ways.drop("suffix", "bad"), nodes, ["host", "way"], "steps")
    level = F.struct("depth", "nbad", "nlab", (F.col("sbad") - F.col("nbad")).alias("obad"), (F.col("slab") - F.col("nlab")).alias("olab"))
    path = seen.groupBy("host", "steps").agg(F.max("lab").alias("labelled"), F.sort_array(F.collect_list(level)).alias("path"))  # one row a level

    def smooth(above: Column, x: Column) -> Column:
        prior = (x["obad"] + prior_weight * (rate + inherit * (above - rate))) / (x["olab"] + prior_weight)
        return (x["nbad"] + prior_weight * prior) / (x["nlab"] + prior_weight)

    return path.select("host", "steps", "labelled", F.aggregate("path", F.lit(float(rate)), smooth).alias("purity"))


def judge_urls(
    pages: DataFrame, rules=RULES, variable_children: int = 20, alike: float = 1.96, prior_weight: float = 4.0, inherit: float = 0.85, reject_at: float = 0.8,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity, labelled.

    Rules decide where one fits, the longest first. Their decisions also are the labels from which the tree learns.
    Per host, paths become templates of as many segments as they have: segments that vary by form (numbers, ids) are
    wildcards, and so are the children of a node that has more than ``variable_children`` different ones (see
    ``grow``); statistically similar branches become one (see ``merge_alike``); shares of blocked labels are smoothed
    down the tree and across the hosts of a suffix (see ``purities``). A template without a rule is rejected if its
    share reaches ``reject_at``.

    All counts are sums grouped by hashed nodes, pre-aggregated before their shuffle, so a host with a third of all
    pages costs no more than its templates; joins that hand them back deal the rows of a hot node over several tasks.

    Defined cases: a null url or one without :// has empty host and path and is judged like any other; empty paths
    have the template of the root; rows that repeat are answered each; an empty table gives an empty table; other
    columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("u"))
    host, path = url_parts(F.col("u"))
    rows = rows.select("id", host.alias("host"), path.alias("path")).withColumn("r", first_rule(F.col("host"), F.col("path"), rules))
    typed = F.transform(F.filter(F.split(F.col("path"), "/"), lambda s: s != ""), segment_type)
    rows = rows.select("id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), typed.alias("typed"))
    rows = cut_lineage(rows.withColumn("leaf", _key(F.col("host"), F.to_json("typed"))))
    bad, lab = F.count_if(F.col("ruled") == "block"), F.count("ruled")
    leaves = rows.groupBy("leaf").agg(F.first("host").alias("host"), F.first("typed").alias("typed"), bad.alias("bad"), lab.alias("lab"))
    leaves = merge_alike(grow(leaves, variable_children), alike)
    rate = leaves.agg(F.try_divide(F.sum("bad"), F.sum("lab"))).first()[0] or 0.0  # one number
    judged = purities(leaves, float(rate), prior_weight, inherit)
    judged = salted_join(leaves.select("leaf", "host", "steps"), judged, ["host", "steps"], "leaf")
    judged = judged.select("leaf", F.concat(F.lit("/"), F.array_join("steps", "/")).alias("template"), "purity", "labelled")
    out = salted_join(rows, judged, ["leaf"], "id")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity", "labelled")
