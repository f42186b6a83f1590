"""DuckDB SQL for those text queries that SQL can express on whole tables."""

from __future__ import annotations

_CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
said as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as learned,
    sum(length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + length('<turn:') + length('>') + 1 + length('</turn>') + 1) as formatted
  from rows group by conv_id)
select conv_id, n_turns::bigint as n_turns, sha256(turns) as turns_sha256, length(learned)::bigint as loss_chars,
  sha256(learned) as loss_sha256, formatted::bigint as formatted_chars
from said
"""

_TOPK = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x::double) or isinf(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0)))::bigint as score
  from usable q join usable c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, r::int as rank, vec_id, score from ranked where r <= 20
"""

ORACLE = {"op4_chat": _CHAT, "op6_topk": _TOPK}
