"""DuckDB SQL of the queries that SQL can express on whole tables."""

_WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, cast(d.payload_bytes as bigint) as payload_bytes, d.payload_digest,
  case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end as record_type,
  case when f.first <> d.page_id then f.first end as refers_to
from d left join f on f.payload_digest = d.payload_digest and d.payload_bytes >= 100
"""

ORACLE_SQL = {"op1_warc": _WARC}
