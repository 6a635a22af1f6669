"""Scans and sinks as queries: what is written is read back, and that must be what the tables say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.plans.catalog import proxy, query, table
from plumbline.sources import folders, jsonl, loaders
from plumbline.sources.versioned import VersionedTable
from plumbline.streaming.ledger import shared_folder

#: The records as JSON Lines, some of them bad: what is wrong with each follows from its id.
WRONG = "case when id % 29 = 0 then 'not json' when id % 31 = 0 then 'bad split' when id % 37 = 0 then 'expected not in labels' when coalesce(text, '') = '' then 'empty text' when id % 41 = 0 then 'bad span' end"


def as_records(r, wrong: bool = False):
    """Proxy records in the shape of ``jsonl.RECORD``."""
    i = F.col("id")
    labels = F.array(F.lit("yes"), F.lit("no"))
    expected = F.when((i % 37 == 0) & F.lit(wrong), "maybe").otherwise(F.col("expected"))
    split = F.when((i % 31 == 0) & F.lit(wrong), "train").otherwise(F.col("split"))
    end = F.when((i % 41 == 0) & F.lit(wrong), F.length("text") + 5).otherwise(1)
    span = F.array(F.struct(end.cast("int").alias("end"), F.lit("START").alias("label"), F.lit(0).alias("start")))
    return r.select(
        expected.alias("expected"), F.lit(None).cast("map<string,double>").alias("expected_distribution"), F.lit("F1").alias("feature"), F.col("grp").cast("string").alias("group"), i.cast("string").alias("id"), labels.alias("labels"),
        F.struct(F.col("exclude_reason"), F.lit("source").alias("label_basis"), "licence", "source").alias("provenance"), F.when(F.length("text") > 0, span).alias("spans"),
        split.alias("split"), F.struct("text").alias("state"), "subtask", F.when(F.col("split") == "private", "private").otherwise("public").alias("visibility"),
    )


def some_bad(spark, sf) -> str:
    """A folder of record lines, one in a few dozen cut in the middle."""
    rows = as_records(proxy(spark, sf, "records"), wrong=True)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    cut = F.when(F.col("id").cast("long") % 29 == 0, F.substring(line, 1, 25)).otherwise(line)
    folder = shared_folder(spark, "lines")
    rows.select(cut.alias("value")).write.option("lineSep", "\n").text(folder)
    return folder


@query("src_01_validated_records", "select id::varchar as id, subtask, split, expected, length(text) as n from records where text <> ''")
def validated_records(spark, sf):
    """Records written as JSON Lines and read back by the strict scan."""
    folder = shared_folder(spark, "records")
    jsonl.write_records(as_records(proxy(spark, sf, "records").where("text <> ''")), folder)
    return jsonl.read_records(spark, folder).select("id", "subtask", "split", "expected", F.length("state.text").alias("n"))


@query("src_02_tolerant_records", f"select {WRONG} as problem, count(*) as n from records group by 1")
def tolerant_records(spark, sf):
    """The same with broken and invalid lines: all are kept, with what is wrong."""
    return jsonl.read_tolerant(spark, some_bad(spark, sf)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("src_03_raw_lines", "select id % 29 <> 0 as parsed, case when id % 29 <> 0 then subtask end as subtask, count(*) as n from records group by 1, 2")
def raw_lines(spark, sf):
    """Lines as values of no fixed shape, fields taken by path."""
    raw = jsonl.read_raw(spark, some_bad(spark, sf))
    return raw.groupBy(F.col("value").isNotNull().alias("parsed"), F.try_variant_get("value", "$.subtask", "string").alias("subtask")).agg(F.count(F.lit(1)).alias("n"))


@query("src_07_gzip_lines", "select lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def gzip_lines(spark, sf):
    folder = shared_folder(spark, "gzip")
    jsonl.write_lines(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), folder, "gzip")
    parsed = jsonl.lines(spark, folder).select(F.from_json("line", "doc_id long, lang string, n_chars long").alias("r")).select("r.*")
    return parsed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@folders.source("documents")
def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@folders.source("benchmark")
def _benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


@folders.source("pages")
def _pages(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))


@query(
    "src_14_source_registry",
    " union all ".join(f"select '{n}' as source, count(*) as n, sum(length({c}))::bigint as chars from {t}" for n, c, t in (("documents", "text", "documents"), ("benchmark", "text", "benchmark"), ("pages", "html", "pages"))),
)
def source_registry(spark, sf):
    """Every registered source through its one interface."""
    parts = [folders.load(spark, n, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).select(F.lit(n).alias("source"), "n", "chars") for n in ("documents", "benchmark", "pages")]
    return parts[0].union(parts[1]).union(parts[2])


@query("src_15_fetched_text", r"select concat('web-', substr(sha1(coalesce(url, '')), 1, 10), '-', page_id) as id, regexp_extract(url, '^https?://([^/]+)', 1) as grp, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) as n from pages where html is not null")
def fetched_text(spark, sf):
    """Fetched pages as records: an id out of the address, the host as group, the text without its tags."""
    p = table(spark, sf, "pages").where("html is not null")
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\x0b\f\r]+", " "))
    ident = F.concat(F.lit("web-"), F.substring(F.sha1(F.coalesce("url", F.lit(""))), 1, 10), F.lit("-"), F.col("page_id").cast("string"))
    return p.select(ident.alias("id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("grp"), F.length(plain).cast("long").alias("n"))


@query("src_21_published_snapshot", "select split, count(*) as n, 2::bigint as version from records where id % 2 = 0 group by 1 union all select split, count(*), 1 from records where id % 3 = 0 group by 1")
def published_snapshot(spark, sf):
    """The newest snapshot that was committed, and the first, which stays readable: of three, the last was never committed."""
    t, r = VersionedTable(spark, shared_folder(spark, "snapshots")), proxy(spark, sf, "records").select("id", "split")
    first, last = t.publish(r.where("id % 3 = 0")), t.publish(r.where("id % 2 = 0"))
    t.stage(r)
    count = lambda v: t.read(v).groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(v).cast("long"))
    return count(t.manifest()["version"]).unionByName(count(first)).where(F.col("version").isin(first, last))


@query("src_23_ledger_lines", "select system, seq, count(*) as n, round(avg(score), 6) as mean from ledger where ok group by 1, 2")
def ledger_lines(spark, sf):
    """Ledger lines with a schema of just the fields that are used."""
    folder = shared_folder(spark, "ledger-lines")
    jsonl.write_lines(proxy(spark, sf, "ledger").select("row_id", "system", "seq", "ok", "score", "error"), folder)
    led = jsonl.lines(spark, folder).select(F.from_json("line", "system string, seq int, ok boolean, score double").alias("r")).select("r.*")
    return led.where("ok").groupBy("system", "seq").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("snk_01_validated_lines", "select source, licence, count(*) as n, bit_xor(('0x' || substr(sha256(text), 1, 15))::bigint) as texts from records where text <> '' group by 1, 2")
def validated_lines(spark, sf):
    """The writer refuses bad records, so what is read back is what was there, text for text."""
    folder = shared_folder(spark, "written")
    jsonl.write_records(as_records(proxy(spark, sf, "records").where("text <> ''")), folder, "gzip")
    r = jsonl.read_tolerant(spark, folder)
    h = F.conv(F.substring(F.sha2("state.text", 256), 1, 15), 16, 10).cast("long")
    return r.groupBy("provenance.source", "provenance.licence").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("texts"))


#: What is staged: the public rows, and some faults that the gates must count: private rows, texts that their licence
#: closes, rows put in twice.
STAGED = "select id, split, licence, case when licence in ('cc-by', 'mit') or id % 53 = 0 then text end as text from records, range(case when id % 89 = 0 then 2 else 1 end) where split <> 'private' or id % 97 = 8"


@query(
    "snk_05_staged_release",
    f"""with s as ({STAGED}) select gate, violations from (select 'rows written' as gate, abs((select count(*) from s) - (select count(*) from records where split <> 'private')) as violations
    union all select 'private rows', (select count(*) from s where split = 'private') union all select 'texts without licence', (select count(*) from s where text is not null and licence not in ('cc-by', 'mit'))
    union all select 'ids twice', (select count(*) from (select id from s group by 1 having count(*) > 1)))""",
)
def staged_release(spark, sf):
    """A release is written to a staging folder, read again, and judged by gates before anyone may publish it. The staged
    rows hold faults of every kind."""
    r, folder = proxy(spark, sf, "records"), shared_folder(spark, "staging")
    open_, k = F.col("licence").isin("cc-by", "mit"), F.col("id")
    staged = r.where((F.col("split") != "private") | (k % 97 == 8)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(k % 89 == 0, 2).otherwise(1))))
    staged.select("id", "split", "licence", F.when(open_ | (k % 53 == 0), F.col("text")).alias("text")).write.partitionBy("split").parquet(folder)
    back = spark.read.parquet(folder)
    seen = back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "private").alias("private"), F.count_if(F.col("text").isNotNull() & ~open_).alias("closed"))
    twice = back.groupBy("id").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("twice"))
    all_ = seen.crossJoin(r.where("split <> 'private'").agg(F.count(F.lit(1)).alias("want"))).crossJoin(twice)  # a row each
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), c.alias("violations")) for g, c in (("rows written", F.abs(F.col("n") - F.col("want"))), ("private rows", F.col("private")), ("texts without licence", F.col("closed")), ("ids twice", F.col("twice")))])
    return all_.select(F.explode(gates).alias("g")).select("g.*")


@query("snk_06_append_only_ledger", "select l.system, count(*) as n, count(distinct l.row_id) as rows, min(a.kind) as arm from (select distinct row_id, system, seq from ledger) l join systems a on a.system = l.system group by 1")
def append_only_ledger(spark, sf):
    """A ledger appended to twice, the second time with rows that it has, and the sidecar of its arms, once each."""
    led, folder = proxy(spark, sf, "ledger").select("row_id", "system", "seq", "kind"), shared_folder(spark, "append")
    rows, arms = VersionedTable(spark, f"{folder}/ledger"), VersionedTable(spark, f"{folder}/arms")
    for part in (led.where("seq = 0"), led):
        rows.append(part.select("row_id", "system", "seq"), ["row_id", "system", "seq"])
        arms.append(part.select("system", "kind"), ["system"])
    return rows.read().join(F.broadcast(arms.read()), "system").groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("rows"), F.min("kind").alias("arm"))


@query("snk_09_report_lines", "select '| ' || split || ' | ' || count(*) || ' | ' || count(expected) || ' |' as line from records group by split union all select '| split | n | labelled |' union all select '|---|---|---|'")
def report_lines(spark, sf):
    """A small table as the lines of a report."""
    t = proxy(spark, sf, "records").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("expected").alias("labelled"))
    return folders.markdown(t, ["split"]).select("line")


RAW_LINES = ["id", "split", "source", "expected", "text"]


def lines_of_records(spark, sf) -> str:
    folder = shared_folder(spark, "suite-lines")
    jsonl.write_lines(proxy(spark, sf, "records").select(*RAW_LINES), folder)
    return folder


@query("udf_06_loaded_records", "select split, expected, count(*) as n, sum(length(text))::bigint as chars from records where expected is not null and split = 'dev' group by 1, 2")
def loaded_records(spark, sf):
    """A suite's loader as a data source: the condition on the split is checked where lines are read."""
    r = loaders.load(spark, "labelled", lines_of_records(spark, sf), range_bytes=1 << 20).where("split = 'dev'")
    return r.groupBy("split", "expected").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("udf_07_suite_records", "select suite, count(*) as n, sum(length(text))::bigint as chars from (select 'plain' as suite, text from records union all select 'labelled', text from records where expected is not null union all select 'prompts', string_split(text, chr(10))[1] from records where text <> '') group by 1")
def suite_records(spark, sf):
    """The same lines through the hooks of three suites."""
    folder = lines_of_records(spark, sf)
    r = reduce(lambda a, b: a.union(b), [loaders.load(spark, x, folder).select("suite", "text") for x in ("plain", "labelled", "prompts")])
    return r.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
