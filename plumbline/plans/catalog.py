"""Where queries and their SQL are registered, and the evaluation tables that stand in for real ledgers.

The proxies are plain SQL that Spark and DuckDB both run, so that a query and its SQL start from the same rows: a
record table (documents with labels, a split, a group), and a ledger of four made-up systems that answered every
labelled document, some twice, some without success, with scores that follow from ids by arithmetic alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

PROXIES = {
    "records": """
        select d.doc_id as id, d.text, d.lang as subtask, d.source, l.quality, l.toxic,
               case when l.toxic = 1 then 'yes' when l.toxic = 0 then 'no' end as expected,
               case when d.doc_id % 10 < 6 then 'test' when d.doc_id % 10 < 8 then 'dev' else 'private' end as split,
               d.doc_id - d.doc_id % 3 as grp,
               case when l.quality = 0 and d.doc_id % 7 = 0 then 'low quality' end as exclude_reason,
               case d.doc_id % 4 when 0 then 'cc-by' when 1 then 'mit' when 2 then 'apache-2.0' else 'unknown' end as licence
        from documents d left join labels l on d.doc_id = l.doc_id
    """,
    "systems": """
        select 'alpha' as system, 1 as sid, cast(0.9 as double) as skill, 'api' as kind union all
        select 'beta', 2, cast(0.6 as double), 'api' union all
        select 'gamma', 3, cast(0.35 as double), 'self' union all
        select 'delta', 4, cast(0.1 as double), 'self'
    """,
    "ledger": """
        select r.id as row_id, s.system, concat('cfg', cast(s.sid % 3 as varchar(8))) as config_hash, s.kind, r.subtask, r.source, r.grp, r.split,
               r.expected, a.seq, (r.id * 31 + s.sid * 17 + a.seq * 5) % 50 <> 0 as ok,
               case when (r.id * 31 + s.sid * 17 + a.seq * 5) % 50 <> 0 then
                 floor(100 * ((1 - s.skill) * cast((r.id * 7919 + s.sid * 104729 + a.seq * 1299709) % 10007 as double) / 10007 + s.skill * (0.2 + 0.6 * r.toxic))) / 100 end as score,
               case when (r.id * 31 + s.sid * 17 + a.seq * 5) % 50 = 0 then
                 case when r.id % 3 = 0 then 'timeout: no answer' when r.id % 3 = 1 then 'http 503: busy' else 'refused by provider policy' end end as error,
               cast(0.05 + cast((r.id * 13 + s.sid * 29 + a.seq) % 997 as double) / 1000 as double) as latency_s,
               cast(100 + (r.id * 3 + s.sid) % 900 as bigint) as tokens_in, cast(1 + (r.id + s.sid) % 40 as bigint) as tokens_out
        from records r cross join systems s cross join (select 0 as seq union all select 1) a
        where r.expected is not null and (a.seq = 0 or (r.id * 7 + s.sid) % 13 = 0)
    """,
    "latest": """
        select row_id, system, config_hash, kind, subtask, source, grp, split, expected, seq, ok, score, error, latency_s, tokens_in, tokens_out
        from (select *, row_number() over (partition by row_id, system order by seq desc) as rn from ledger) x where rn = 1
    """,
    "judgments": """
        select system, subtask, source, grp, split, row_id, expected = 'yes' as positive, score,
               case when not ok then 'failed' when score is null then 'no_decision' else 'decided' end as outcome,
               ok and score is not null and (score >= 0.5) = (expected = 'yes') as correct, latency_s, tokens_in, tokens_out, kind, config_hash
        from latest
    """,
}


def _needed(sql: str) -> list[str]:
    """The proxies that a text names, in the order in which they build on one another."""
    names, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for p in PROXIES:
            if p not in names and re.search(rf"\b{p}\b", re.sub(r"'[^']*'", "", text)):
                names.add(p)
                todo.append(PROXIES[p])
    return [p for p in PROXIES if p in names]


def expand(sql: str) -> str:
    """SQL with the proxies that it names as leading common table expressions."""
    needed = _needed(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{p} as ({PROXIES[p]})" for p in needed)
    body = sql.strip()
    if (m := re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)) is not None:
        return f"with {m[1] or ''}{head},\n{body[m.end():]}"
    return f"with {head}\n{body}"


def proxy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A proxy as a DataFrame."""
    sql = expand(f"select * from {name}")
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = expand(sql)
        return f

    return keep
