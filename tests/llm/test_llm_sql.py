"""What SQL can say of queries that it can't say whole: base counts, hosts and rules, sizes."""

from __future__ import annotations

import pytest
from oracle import differences

from plumbline.llm import queries as Q

SF = "/root/testdata/sf0.01"
DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = f"""length({DIGITS}) between 14 and 19 and list_sum(list_transform(range(1, length({DIGITS}) + 1),
  lambda i: case when i % 2 = 0 then 2 * ({DIGITS})[-i]::int - case when ({DIGITS})[-i]::int > 4 then 9 else 0 end else ({DIGITS})[-i]::int end)) % 10 = 0"""

SQL = {
    "op6_pii": (
        ["doc_id", "n_email", "n_ip", "n_card", "n_phone"],
        rf"""with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
          len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: p::hugeint <= 255)))) as n_ip,
          len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: {LUHN})) as n_card,
          len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({DIGITS}) between 10 and 15)) as n_phone from d""",
    ),
    "op7_secrets": (
        ["doc_id", "n_assign", "n_access", "n_hex"],
        r"""with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) as n_assign,
          len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) as n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) as n_hex from d""",
    ),
    "op8_url_filter": (
        ["page_id", "host", "path", "rule"],
        r"""with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
        r as (select unnest(['net', 'example.net', 'example.com', 'org']) as h, unnest(['/', '/en/', '/de/', '/fr/']) as b),
        f as (select page_id, arg_max(h || b, length(h || b)) as rule from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, b) group by 1)
        select p.page_id, host, path, rule from p left join f using (page_id)""",
    ),
    "op10_source_mix": (
        ["doc_id", "size", "source_size"],
        r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents)
        select doc_id, size, (sum(size) over (partition by source))::bigint as source_size from d""",
    ),
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_columns_that_sql_can_say(spark, name):
    columns, sql = SQL[name]
    assert differences(Q.QUERIES[name](spark, SF).select(*columns), sql, SF) == []
