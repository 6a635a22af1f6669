"""The template tree against a plain version, on the real table and on made-up hosts."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm.urls import RULES, first_rule, judge_urls, segment_type, url_parts


def plain_tree(rows, variable_children=20, alike=1.96, weight=4.0, inherit=0.85):
    """{page: (template, purity)} for (page, host, typed segments, ruled)."""
    way = {}

    def down(host, steps, members):  # members: {leaf: rest}
        for leaf, rest in members.items():
            if not rest:
                way[host, leaf] = tuple(steps)
        members = {k: r for k, r in members.items() if r}
        if not members:
            return
        kids = {r[0] for r in members.values()}
        if len(kids) == 1:
            rests, n = list(members.values()), 1
            while all(len(r) > n and r[n] == rests[0][n] for r in rests) and all(len(r) > n for r in rests):
                n += 1
            down(host, [*steps, "/".join(rests[0][:n])], {k: r[n:] for k, r in members.items()})
        elif len(kids) > variable_children:
            down(host, [*steps, "*"], {k: r[1:] for k, r in members.items()})
        else:
            for kid in kids:
                down(host, [*steps, kid], {k: r[1:] for k, r in members.items() if r[0] == kid})

    by_host, bad, lab = defaultdict(dict), defaultdict(int), defaultdict(int)
    for _, host, typed, ruled in rows:
        by_host[host][tuple(typed)] = list(typed)
        bad[host, tuple(typed)] += ruled == "block"
        lab[host, tuple(typed)] += ruled is not None
    for host, members in by_host.items():
        down(host, [], members)
    for level in range(max(map(len, way.values()), default=0), 0, -1):
        sib, shape, like = defaultdict(lambda: [0, 0]), defaultdict(set), defaultdict(lambda: [0, 0])
        for (host, leaf), steps in way.items():
            if len(steps) >= level:
                node = (host, steps[: level - 1], steps[level - 1])
                for k, v in enumerate((bad[host, leaf], lab[host, leaf])):
                    sib[node][k] += v
                    like[(host.rsplit(".", 1)[-1], *node[1:])][k] += v
                shape[node].add(steps[level:])
        sib = {n: v if v[1] else like[(n[0].rsplit(".", 1)[-1], *n[1:])] for n, v in sib.items()}
        groups = defaultdict(list)
        for node in sib:
            groups[node[0], node[1], frozenset(shape[node])].append(node)
        named = {}
        for nodes in groups.values():
            b_all, l_all = (sum(sib[n][k] for n in nodes) for k in (0, 1))
            near = []
            for n in nodes:
                b, ln = sib[n]
                if ln and l_all - ln:
                    p = b_all / l_all
                    if abs(b / ln - (b_all - b) / (l_all - ln)) > alike * math.sqrt(p * (1 - p) * (1 / ln + 1 / (l_all - ln))):
                        continue
                near.append(n)
            if len(near) > 1:
                named.update({n: min(x[2] for x in near) + "+" for n in near})
        for key, steps in way.items():
            if len(steps) >= level and (new := named.get((key[0], steps[: level - 1], steps[level - 1]))) is not None:
                way[key] = (*steps[: level - 1], new, *steps[level:])
    nodes, cross = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (host, leaf), steps in way.items():
        for d in range(len(steps) + 1):
            for k, v in enumerate((bad[host, leaf], lab[host, leaf])):
                nodes[host, steps[:d]][k] += v
                cross[host.rsplit(".", 1)[-1], steps[:d]][k] += v
    rate = sum(bad.values()) / max(1, sum(lab.values()))
    out = {}
    for page, host, typed, _ in rows:
        steps, p = way[host, tuple(typed)], rate
        for d in range(len(steps) + 1):
            (b, n), (cb, cn) = nodes[host, steps[:d]], cross[host.rsplit(".", 1)[-1], steps[:d]]
            prior = (cb - b + weight * (rate + inherit * (p - rate))) / (cn - n + weight)
            p = (b + weight * prior) / (n + weight)
        out[page] = ("/" + "/".join(steps), p)
    return out


def check(pages, rules=RULES, **kw):
    host, path = url_parts(F.col("url"))
    typed = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), segment_type)
    rows = [tuple(r) for r in pages.select("page_id", host, typed, first_rule(host, path, rules)["verdict"]).collect()]
    want = plain_tree(rows, **({"variable_children": kw["variable_children"]} if kw else {}))
    got = judge_urls(pages, rules, **kw).collect()
    assert len(got) == len(rows)
    for r in got:
        template, purity = want[r.page_id]
        assert (r.template, round(r.purity, 9)) == (template, round(purity, 9)), r
        if r.rule is None:
            assert r.verdict == ("block" if r.purity >= 0.8 else "allow")
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_tree_on_the_real_table(spark, sf):
    got = check(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet"))
    said = {r.verdict for r in got if r.rule is None}
    assert said == {"block", "allow"} if sf == "sf0.1" else said, "with labels enough, the tree decides pages both ways"


def test_tree_on_deep_and_wide_hosts(spark):
    """Branches that differ only in their fifth segment, hosts with many slugs, numbers and one path of 300 segments."""
    r = random.Random(5)
    urls = []
    for h in ("a.shop.test", "b.shop.test", "c.news.test"):
        for k in range(120):
            urls.append(f"https://{h}/x/y/z/w/{r.choice(['bad', 'good', 'odd'])}/{r.randrange(10**6)}")
            urls.append(f"https://{h}/blog/{r.choice('abcdefgh')}slug-{k}/comments")
            urls.append(f"https://{h}/{r.choice(['p', 'q', 'r'])}/{r.choice(['item', 'list'])}/{r.randrange(99)}.html")
    urls += ["https://a.shop.test/" + "/".join(f"s{k}" for k in range(300)), "https://a.shop.test/" + "/".join(f"s{k}" for k in range(299)) + "/end", "https://a.shop.test", "nothing", ""]
    rules = (("block", "a.shop.test/x/y/z/w/bad/"), ("allow", "a.shop.test/x/y/z/w/good/"), ("block", "shop.test/p/"), ("allow", "test/q/"))
    pages = spark.createDataFrame([*enumerate(urls), (9999, None)], "page_id long, url string")
    got = {x.page_id: x for x in check(pages, rules, variable_children=15)}
    deep = [x for x in got.values() if x.rule is None and x.template.startswith("/x/y/z/w/odd")]
    assert deep and all(x.path.split("/")[5] == "odd" for x in deep)
    b = [x for x in got.values() if x.host == "b.shop.test" and "/w/" in x.path]
    assert {x.verdict for x in b if "/bad/" in x.path} == {"block"} and {x.verdict for x in b if "/good/" in x.path} == {"allow"}
