"""DuckDB SQL with the same rows as the corpus queries, where SQL can express them."""

_LEVEL = """
{name}_k as (
    select coalesce(1 / least(greatest(case when sum(n * above * (1 - above) * (n - 1)) > 0
        then sum((bad - n * above) * (bad - n * above) - n * above * (1 - above))
             / sum(n * above * (1 - above) * (n - 1)) else 1 / 3.0::double end, 1 / 201.0::double), 1 / 3.0::double) - 1, 2.0) k
    from {name}_above),
{name}_mean as (select a.*, k, (bad + k * above) / (n + k) mean from {name}_above a, {name}_k)"""

def _crc(text: str) -> str:
    """crc32 of a short ASCII text, bit by bit."""
    return f"""xor(4294967295::bigint, list_reduce(
        list_transform(string_split({text}, ''), lambda x: unicode(x)::bigint),
        lambda c, b: list_reduce(range(8), lambda d, i: case when d % 2 = 1 then xor(3988292384::bigint, d >> 1) else d >> 1 end,
            xor(c, b)), 4294967295::bigint))"""


_LOWER_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLE = {
    "op1_warc": """
with p as (
    select page_id, strlen(coalesce(html, '')) b, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first_id from p where b >= 100 group by d)
select page_id, b payload_bytes, d payload_digest,
    case when b >= 100 and page_id <> first_id then 'revisit' else 'response' end record_type,
    case when b >= 100 and page_id <> first_id then first_id end refers_to
from p left join f using (d)
""",
    "op5_cover_tree": """
with recursive v as (
    select vec_id, list_transform(embedding, lambda x: x::double) c from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (
    select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id
    where list_inner_product(a.c, b.c) / sqrt(list_inner_product(a.c, a.c) * list_inner_product(b.c, b.c)) >= 0.95::double),
reach as (
    select vec_id, vec_id r from embeddings union select b, r from reach join edges on a = vec_id)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
from embeddings join (select vec_id, min(r) component_id from reach group by vec_id) using (vec_id)
left join (select a vec_id, count(*) n from edges group by a) using (vec_id)
""",
    "op8_jaccard_join": """
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
sets as (
    select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(
            range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end s from w),
items as (select doc_id, len(s) n, unnest(s) item from sets),
edges as (
    select a.doc_id a, b.doc_id b from items a join items b on a.item = b.item and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (
    select doc_id, doc_id r from sets union select b, r from reach join edges on a = doc_id)
select doc_id, len(s) n_shingles, component_id from sets
join (select doc_id, min(r) component_id from reach group by doc_id) using (doc_id)
""",
    "op9_kdtree_topk": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) c from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select q.vec_id query_id, v.vec_id, list_inner_product(q.c, v.c)::bigint score
    from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op10_url_reputation": f"""
with rest as (
    select page_id, coalesce(case when instr(url, '://') > 0
        then substr(url, instr(url, '://') + 3) else '' end, '') r from pages),
parts as (
    select page_id, translate(regexp_extract(r, '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from rest),
known as (
    select doc_id page_id, max((quality = 0 or toxic = 1)::int) bad from labels
    where doc_id is not null and (quality = 0 or toxic = 1) is not null group by 1),
hosts as (
    select host, count(bad)::double n, coalesce(sum(bad), 0)::double bad,
        regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', '') bare
    from parts left join known using (page_id) group by host),
named as (
    select *, regexp_extract(bare, '[^.]*$') suffix,
        regexp_extract(bare, '([^.]*[.])?[^.]*$') as domain from hosts),
domains as (select domain, suffix, sum(n) n, sum(bad) bad from named group by all),
suffix_above as (
    select suffix, sum(n) n, sum(bad) bad,
        (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) from named) above
    from domains group by suffix),
{_LEVEL.format(name="suffix")},
domain_above as (
    select d.*, mean above from domains d join suffix_mean s using (suffix)),
{_LEVEL.format(name="domain")},
host_above as (
    select h.host, h.n, h.bad, mean above from named h join domain_mean d using (domain, suffix)),
{_LEVEL.format(name="host")},
bound as (
    select host, mean - 1.645::double * sqrt(mean * (1 - mean) / (n + k + 1)) low from host_mean)
select page_id, host, path, rule, case rule
    when 'net/' then 'block' when 'example.net/en/' then 'allow'
    when 'example.com/de/' then 'block' when 'org/fr/' then 'allow'
    else case when low > 0.3 then 'block' else 'allow' end end verdict
from (
    select *, case
        when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
        when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
        when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
        when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end rule
    from parts left join bound using (host))
""",
    "op11_conversation_repair": f"""
with recursive
coded as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
    from conversations),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from coded, unnest(case when kind = 3 then [0, 1] when kind = 0 then [] else [0] end)),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from damaged),
faults as (
    select *, case when bare = '' then 'b'
            when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd'
            when not regexp_matches(right(bare, 1), '[.!?]') then 't' else '' end as fault,
        left(lag(role) over (partition by conv_id order by pos), 1) || left(role, 1) as pair
    from placed),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
        count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as rows
    from faults group by conv_id),
-- States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Up to two turns are inserted before a row or at the end.
inserts as (
    select * from (values
        (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
        (0, 2, 2, 'I', 'user:'), (1, 2, 2, 'I', 'user:'), (3, 2, 2, 'I', 'user:'), (2, 3, 2, 'I', 'assistant:'),
        (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'),
        (3, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (2, 2, 4, 'II', 'assistant:' || chr(10) || 'user:'))
        i(state, after, price, names, turns)),
edits as (
    select * from (values
        (0, 'D', 3, 0, ''), (1, 'D', 3, 1, ''), (2, 'D', 3, 2, ''), (3, 'D', 3, 3, ''),
        (0, 'K', 0, 1, 's'), (0, 'K', 0, 2, 'u'), (1, 'K', 0, 2, 'u'), (3, 'K', 0, 2, 'u'), (2, 'K', 0, 3, 'a'),
        (0, 'R', 2, 2, 'user'), (1, 'R', 2, 2, 'user'), (3, 'R', 2, 2, 'user'), (2, 'R', 2, 3, 'assistant'))
        e(state, name, price, after, role)),
steps as (
    select i.state, e.after, i.price + e.price as price, i.names || e.name as names, e.name, i.turns, e.role
    from inserts i join edits e on i.after = e.state),
search as (
    select conv_id, 0::bigint as pos, 0 as state, {{cost: 0, audit: '', lines: []::varchar[]}} as best from counts
    union all
    select conv_id, pos, state, best from (
        select f.conv_id, f.pos, t.after as state, min({{
            cost: s.best.cost + t.price + case when t.name <> 'D' and f.fault = 't' then 1 else 0 end,
            audit: s.best.audit || t.names,
            lines: s.best.lines || case when t.turns = '' then [] else [t.turns] end || case t.name
                when 'D' then [] when 'K' then [f.role || ':' || f.text] else [t.role || ':' || f.text] end}}) as best
        from search s join faults f on f.conv_id is not distinct from s.conv_id and f.pos = s.pos + 1
        join steps t on t.state = s.state and (t.name = 'D'
            or f.fault not in ('b', 'd') and (t.name = 'R' or t.role = left(f.role, 1)))
        group by f.conv_id, f.pos, t.after)),
ends as (
    select s.conv_id, min({{cost: s.best.cost + i.price, audit: s.best.audit || i.names,
        lines: s.best.lines || case when i.turns = '' then [] else [i.turns] end}}) as best
    from search s join counts c on c.conv_id is not distinct from s.conv_id and c.rows = s.pos
    join inserts i on i.state = s.state and i.after in (0, 3) group by s.conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
    coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
    sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
""",
    "op12_decontamination": f"""
with docs as (select row_number() over () as r, doc_id, {_LOWER_WORDS} as ws from documents),
items as (select item_id::varchar as item, {_LOWER_WORDS} as ws from benchmark),
cut as (
    select distinct item, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as phrase
    from items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) u(i) where len(ws) > 0),
lengths as (select distinct n from cut),
places as (
    select r, n, i, array_to_string(ws[i:i + n - 1], ' ') as phrase
    from docs, lengths, unnest(range(1, len(ws) - n + 2)) u(i)),
found as (select r, n, i, item from places join cut using (n, phrase)),
hit as (select r, count(distinct p) as n_hit from found, unnest(range(i, i + n)) u(p) group by r),
named as (
    select r, count(distinct item) as n_items, sha256(coalesce(string_agg(distinct item, ',' order by item), '')) as items_sha256
    from found group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
""",
    "op13_merkle_manifest": f"""
with recursive
rows as (
    select doc_id, coalesce('=' || source, '') as tree, {_LEAF.format(text="text")} as leaf,
        case when {_crc("doc_id::varchar")} % 2 = 0 then {_LEAF.format(text="replace(text, chr(10), '')")} end as other
    from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as ix from rows),
nodes as (
    select tree, 0 as level, ix, leaf as digest, count(*) over (partition by tree) as n from leaves
    union all
    select tree, level, ix, digest, count(*) over (partition by tree) as n from (
        select tree, level + 1 as level, ix // 3 as ix, sha256(string_agg(digest, '' order by ix)) as digest
        from nodes where n > 1 group by tree, level, ix // 3)),
subroots as (
    select tree, digest as subroot, row_number() over (order by tree) - 1 as ix from nodes where n = 1),
tops as (
    select 0 as level, ix, subroot as digest, count(*) over () as n from subroots
    union all
    select level, ix, digest, count(*) over () as n from (
        select level + 1 as level, ix // 3 as ix, sha256(string_agg(digest, '' order by ix)) as digest
        from tops where n > 1 group by level, ix // 3)),
runs as (
    select tree, level, ix // 3 as run, list({{ix: ix, digest: digest}} order by ix) as members from nodes where n > 1 group by all),
top_runs as (
    select level, ix // 3 as run, list({{ix: ix, digest: digest}} order by ix) as members from tops where n > 1 group by all),
walk as (
    select l.doc_id, l.tree, l.ix as start, 0 as level, l.ix, coalesce(l.other, l.leaf) as node, '' as seen from leaves l
    union all
    select w.doc_id, w.tree, w.start, w.level + 1, w.ix // 3,
        sha256(array_to_string(list_transform(r.members, lambda m: case when m.ix = w.ix then w.node else m.digest end), '')),
        w.seen || array_to_string(list_transform(list_filter(r.members, lambda m: m.ix <> w.ix), lambda m: m.digest), '')
    from walk w join runs r on r.tree = w.tree and r.level = w.level and r.run = w.ix // 3),
risen as (
    select w.*, s.subroot, s.ix as place from walk w join subroots s using (tree)
    where w.level = (select max(level) from nodes n where n.tree = w.tree)),
climb as (
    select doc_id, tree, start, subroot, 0 as level, place as ix, node, seen from risen
    union all
    select w.doc_id, w.tree, w.start, w.subroot, w.level + 1, w.ix // 3,
        sha256(array_to_string(list_transform(r.members, lambda m: case when m.ix = w.ix then w.node else m.digest end), '')),
        w.seen || array_to_string(list_transform(list_filter(r.members, lambda m: m.ix <> w.ix), lambda m: m.digest), '')
    from climb w join top_runs r on r.level = w.level and r.run = w.ix // 3)
select c.doc_id, l.leaf, c.subroot, (select digest from tops where n = 1) as root, sha256(c.seen) as proof_sha256,
    c.node as folded_root, c.node = (select digest from tops where n = 1) as verified
from climb c join leaves l on l.tree = c.tree and l.ix = c.start
where c.level = (select max(level) from tops)
""",
}
