"""The SQL of the catalog queries (DuckDB's dialect)."""

from __future__ import annotations

from lodestack.functions import paths as P
from lodestack.functions import text as X
from lodestack.plans import catalog as C

_SPACE = X.UNICODE_SPACE


def _case(ext: str, rows: list[tuple[str, list[str]]], default: str) -> str:
    whens = " ".join(f"when {ext} in ({', '.join(repr(e) for e in exts)}) then '{name}'" for name, exts in rows)
    return f"case {whens} else '{default}' end"


_EXT = "lower(regexp_extract(path, '[.][^./]*$', 0))"
_NAME = "regexp_extract(path, '[^/]*$', 0)"
_PARENT = "case when path not like '%/%' then '.' when strpos(substr(path, 2), '/') = 0 and path like '/%' then '/' else regexp_extract(path, '^(.*)/[^/]*$', 1) end"
_TYPE = _case(_EXT, [(t, [f".{e}" for e in x.split()]) for t, x in P.TYPE_EXTENSIONS.items()], "file")
_LAST = "case when path like '%.%' then lower(regexp_extract(path, '[^.]*$', 0)) else '' end"
_CATEGORY = _case(_LAST, [(c, x.split()) for c, x in P.CATEGORIES], "ALL")
_MIME = _case("regexp_replace(" + _EXT + ", '^[.]', '')", [(m, x.split()) for x, m in P.MIME], "*/*")
_PARSER = (
    f"case when coalesce(size, 0) not between 1 and {P.MAX_FILE_BYTES} then 'none' when regexp_replace({_EXT}, '^[.]', '') in "
    f"({', '.join(map(repr, P.PARSED_HERE))}) then 'here' when regexp_replace({_EXT}, '^[.]', '') in ({', '.join(map(repr, P.PARSED_OLD))}) then 'plugin' else 'none' end"
)


def _stored(c: str) -> str:
    lines = f"translate(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(11) || chr(12) || chr(8232) || chr(8233), repeat(chr(10), 4))"
    return f"regexp_replace({lines}, '{X.DROPPED}', '', 'g')"


_CAT = f"""
    cat as (
        select path, r.name as name, lower(r.name) as name_lower, coalesce(r.size, 0) as size, coalesce(r.mtime_ms, 0) as mtime_ms,
            coalesce(r.kind, 'file') as kind, coalesce(r.origin, 'main') as origin
        from (select path, arg_max({{'name': coalesce(name, {_NAME}), 'size': size, 'mtime_ms': mtime_ms, 'kind': kind, 'origin': origin}}, name_id) as r
              from name_record where path is not null group by path)
        where lower(r.name) <> '')"""
_CON = f"""
    con as (
        select path, text, lower(text) as text_lower from (
            select path, {_stored("text")} as text from (
                select path, arg_max(text, (indexed_at, row_id)) as text from content_store where path is not null and text is not null group by path))
        where regexp_matches(text, '[^{_SPACE[1:]}'))"""


def _tf(gram: str) -> str:
    if len(gram) == 2 and gram[0] == gram[1]:
        return f"len(list_filter(range(1, length(text_lower)), lambda i: text_lower[i:i+1] = '{gram}'))"
    return f"((length(text_lower) - length(replace(text_lower, '{gram}', ''))) // {len(gram)})"


def _score(terms: list[str]) -> str:
    from lodestack.operators.search import query_words

    words = "regexp_extract_all(text_lower, '[a-z0-9]+|[^\\x00-\\x7F]+')"
    parts = [_tf(g) for t in terms for g in X.term_grams(t)]
    parts += [f"4 * len(list_filter({words}, lambda w: w = '{q}'))" for q in query_words(terms)]
    return " + ".join(parts)


def _has(terms: list[str]) -> str:
    return " and ".join(f"contains(text_lower, '{t}')" for t in terms)


def _snippet(term: str) -> str:
    """Over before/after parts: the context that fits 40 bytes, at whole characters."""
    near = "right(pre, 40)"
    keep = f"list_max(list_filter(range(0, length({near}) + 1), lambda k: strlen(right({near}, k)) <= 40))"
    nxt = "left(post, 40)"
    take = f"coalesce(list_min(list_filter(range(0, length({nxt}) + 1), lambda k: strlen(left({nxt}, k)) >= 40)), length({nxt}))"
    trim = f"regexp_replace(regexp_replace(replace(l || mid || r, chr(10), ' '), '^{_SPACE}+', ''), '{_SPACE}+$', '')"
    return f"""
        select path, case when length(pre) > length(l) then '…' else '' end || {trim} || case when length(post) > length(r) then '…' else '' end as snippet
        from (select path, pre, mid, post, right({near}, {keep}) as l, left({nxt}, {take}) as r
              from (select path, left(src, place - 1) as pre, substr(src, place, {len(term)}) as mid, substr(src, place + {len(term)}) as post
                    from (select path, strpos(text_lower, '{term}') as place, case when length(text) = length(text_lower) then text else text_lower end as src from matched)))"""


_TERMS = C.CONTENT_QUERY.split()
_SEARCH_TERMS = ["report"]
_DOC = f"kind <> 'folder' and {_TYPE} = 'doc'"

#: The four ranked retrievals of the query ``type:doc report``.
_RANKED = f"""
    {_CAT}, {_CON},
    named as (select * from cat where contains(name_lower, 'report')),
    matched as (select *, 'file' as kind, {_score(_SEARCH_TERMS)} as score from con where {_has(_SEARCH_TERMS)}),
    snips as ({_snippet("report")}),
    ranked as (
        select 'names' as source, row_number() over (order by strlen(name), mtime_ms desc, path) as rn, path, name, size, mtime_ms, 'name' as matched, kind, '' as snippet
        from named where origin = 'main' and kind = 'file' and {_DOC}
        union all
        select 'content', row_number() over (order by score desc, m.path), m.path, regexp_extract(m.path, '[^/]*$', 0), coalesce(c.size, 0), coalesce(c.mtime_ms, 0), 'content', 'file', s.snippet
        from (select * from matched where {_DOC}) m
        left join (select * from cat where origin = 'main' and kind = 'file') c on c.path = m.path join snips s on s.path = m.path
        union all
        select 'folders', row_number() over (order by strlen(name), mtime_ms desc, path), path, name, size, mtime_ms, 'name', kind, ''
        from named where origin = 'main' and kind = 'folder' and {_DOC}
        union all
        select 'external', row_number() over (order by kind = 'folder', strlen(name), mtime_ms desc, path), path, name, size, mtime_ms, 'name', kind, ''
        from named where origin = 'external')"""


def _merged(limit: int) -> str:
    caps = [limit // 2, limit // 4, limit * 3 // 20, limit // 10]
    names = ["names", "content", "folders", "external"]
    cap = "case source " + " ".join(f"when '{s}' then {c}" for s, c in zip(names, caps)) + " end"
    ordinal = "case source " + " ".join(f"when '{s}' then {k}" for k, s in enumerate(names)) + " end"
    return f"""
    merged as (
        select * from (select *, row_number() over (order by rn > {cap}, {ordinal}, rn) as pos from ranked) where pos <= {limit})"""


#: Differences over every pair of consecutive valid deliveries and both lists.
_ALL = """
    heads as (select snap_id, row_number() over (order by max(saved_at), snap_id) as ord
              from snapshot_head where snap_version = 4 and snap_id is not null and saved_at is not null group by snap_id),
    standing as (select ord, list_name, path, arg_max(coalesce(size, 0), row_no) as size, arg_max(coalesce(mtime_ms, 0), row_no) as mtime_ms
          from catalog_snapshot join heads using (snap_id) where list_name in ('names', 'dirs') and path not like '%/' group by ord, list_name, path),
    o as (select heads.snap_id, list_name, path, size, mtime_ms from standing join heads on heads.ord = standing.ord + 1),
    n as (select heads.snap_id, list_name, path, size, mtime_ms from standing join heads using (ord) where ord > 1),
    diff as (
        select snap_id, list_name, path, coalesce(n.size, o.size) as size, coalesce(n.mtime_ms, o.mtime_ms) as mtime_ms,
            case when o.size is null then 'added' when n.size is null then 'removed'
                 when n.size = o.size and n.mtime_ms = o.mtime_ms then 'unchanged' else 'updated' end as status
        from n full join o using (snap_id, list_name, path))"""

SQL = {
    "name_search": f"with {_CAT} select path, name, size, mtime_ms, kind, origin from cat where contains(name_lower, 'report')",
    "name_rank": f"""with {_CAT} select row_number() over (order by strlen(name), mtime_ms desc, path) as pos, path, strlen(name) as name_bytes
        from cat where contains(name_lower, 'report') qualify pos <= 100""",
    "path_parts": f"select distinct path, {_NAME} as name, {_EXT} as ext, {_PARENT} as parent from catalog_snapshot where path is not null",
    "lower_names": "select name_id, lower(name) as lowered from name_record",
    "name_bigrams": f"""with {_CAT}, g as (
        select path, unnest(case when length(name_lower) <= 1 then [name_lower] else list_transform(range(1, length(name_lower)), lambda i: name_lower[i:i+1]) end) as gram from cat)
        select gram, path, count(*) as tf from g group by gram, path""",
    "type_filter": f"with {_CAT} select path, {_TYPE} as ftype from cat where kind <> 'folder' and {_TYPE} in ('doc', 'video')",
    "dir_filter": f"with {_CAT} select path, {_PARENT} as parent from cat where contains(lower({_PARENT}), 'emulated') and contains(lower({_PARENT}), 're')",
    "ext_type_stats": f"with {_CAT} select {_TYPE} as ftype, count(*) as files, sum(size)::bigint as bytes from cat where kind <> 'folder' group by 1",
    "ui_category": f"with {_CAT} select {_CATEGORY} as category, kind, count(*) as n from cat group by 1, 2",
    "prune_dirs": f"""with r as (select distinct path, regexp_replace(scan_root, '/+$', '') as root, coalesce(list_name = 'dirs', false) as folder
            from catalog_snapshot where path is not null and scan_root is not null),
        q as (select *, substr(path, length(root) + 1) || case when folder then '/' else '' end as inside from r)
        select path, max((path = root or not (regexp_matches(inside, '(^|/)([.][^/]*|LOST[.]DIR|lost[+]found|proc|sys|dev)/|(^|/)Android/(data|obb)/')
            or regexp_matches(root, '(^|/)Android$') and regexp_matches(inside, '^/?(data|obb)/')
            or not folder and {_NAME} like '.%'))::int)::bigint as kept from q group by path""",
    "parse_gate": f"select path, {_PARSER} as parser from (select path, arg_max({{'s': size}}, (feed_id, size)).s as size from scan_feed where path is not null group by path)",
    "normalize_text": f"""select row_id, {_stored("text")} as text, (not regexp_matches({_stored("text")}, '[^{_SPACE[1:]}'))::bigint as blank from content_store""",
    "truncate_bytes": f"""select row_id, case when strlen(text) <= {X.MAX_TEXT_BYTES} then text
        else left(text, list_max(list_filter(range({X.MAX_TEXT_BYTES // 4}, {X.MAX_TEXT_BYTES + 1}), lambda k: strlen(left(text, k)) <= {X.MAX_TEXT_BYTES}))) end as cut from content_store""",
    "content_search": f"with {_CON} select path, length(text) as chars from con where {_has(_TERMS)}",
    "content_rank": f"""with {_CON}, s as (select path, ({_score(_TERMS)})::bigint as score from con where {_has(_TERMS)})
        select row_number() over (order by score desc, path) as pos, path, score from s qualify pos <= {C.LIMIT}""",
    "content_enrich": f"""with {_CAT}, {_CON} select con.path, coalesce(c.size, 0) as size, coalesce(c.mtime_ms, 0) as mtime_ms
        from con left join (select * from cat where origin = 'main' and kind = 'file') c using (path) where {_has(_TERMS)}""",
    "snippet": f"with {_CON}, matched as (select * from con where contains(text_lower, 'report')) {_snippet('report')}",
    "gram_index": f"""with {_CON}, g as (
        select path, unnest(list_transform(range(1, length(text_lower) + 1), lambda i: text_lower[i:i])) as gram from con
        union all select path, unnest(list_transform(range(1, length(text_lower)), lambda i: text_lower[i:i+1])) from con)
        select gram, path, count(*) as tf from g group by gram, path""",
    "gram_candidates": f"""with {_CON} select path, ({" + ".join(_tf(g) for t in _TERMS for g in X.term_grams(t))})::bigint as score, ({_has(_TERMS)})::bigint as verified
        from con where {" and ".join(f"contains(text_lower, '{g}')" for t in _TERMS for g in X.term_grams(t))}""",
    "word_tf": f"""with {_CON}, w as (select path, unnest(regexp_extract_all(text_lower, '[a-z0-9]+|[^\\x00-\\x7F]+')) as term from con)
        select term, path, count(*) as tf from w group by term, path""",
    "search_totals": f"""with {_RANKED} select least(count(*), {C.LIMIT}) as total, count(*) as total_matches,
        count(*) filter (source = 'names' or source = 'external' and kind <> 'folder') as total_files,
        count(*) filter (source = 'folders' or source = 'external' and kind = 'folder') as total_dirs,
        count(*) filter (source = 'content') as total_content from ranked""",
    "search_merged": f"with {_RANKED}, {_merged(300)} select pos, source, path, name, size, mtime_ms, matched, kind, snippet from merged",
    "quota_union": f"with {_RANKED}, {_merged(20)} select pos, source, rn, path from merged",
    "tab_views": f"""with {_RANKED}, {_merged(300)},
        p as (select *, case when matched = 'content' then 1 when kind = 'folder' then 2 else 0 end as page from merged)
        select {_CATEGORY} as category, count(*) as n, page::bigint as page from p group by 1, 3""",
    "ui_sort": f"""with {_CAT}, s as (select path, name, length(name) + len(list_filter(string_split(name, ''), lambda c: strlen(c) = 4)) as units, name_lower from cat where contains(name_lower, 'report'))
        select row_number() over (order by units, name_lower, path) as pos, path, name from s qualify pos <= 200""",
    "parsed_queries": """select query_id, case when raw_query is not null then array_to_string(terms, '|') end as terms,
        case when raw_query is not null then array_to_string(type_list, '|') end as types,
        case when raw_query is not null then array_to_string(dir_list, '|') end as dirs from query_log""",
    "incremental_diff": f"with {_ALL} select * from diff",
    "scan_stats": f"with {_ALL} select snap_id, list_name, status, count(*) as n, sum(size)::bigint as bytes from diff group by all",
    "removed_paths": f"with {_ALL} select snap_id, list_name, path from diff where status = 'removed'",
    "backfill_docs": f"""with {_ALL}, {_CON}, docs as (select * from diff where status <> 'removed' and {_PARSER} <> 'none')
        select snap_id, list_name, path, size, case status when 'unchanged' then 'backfill' else status end as reason from docs
        where status <> 'unchanged' or path not in (select path from con)""",
    "stale_content": f"with {_ALL}, {_CON} select snap_id, list_name, path from diff where status in ('removed', 'updated') and path in (select path from con)",
    "upsert": f"with {_ALL} select snap_id, list_name, path, size, mtime_ms from diff",
    "full_refresh": f"""with {_ALL}, {_CAT} select snap_id, case kind when 'folder' then 'dirs' else 'names' end as list_name, path, size, mtime_ms, origin
        from cat cross join heads where origin = 'external'
        union all select snap_id, list_name, path, size, mtime_ms, 'main' from standing join heads using (ord)""",
    "dedup_last": "select path, max(row_id) as row_id, arg_max({'c': length(text)}, row_id).c as chars from content_store where path is not null group by path",
    "remove_paths": f"""with {_CAT}, {_CON} select count(distinct path) as removed from scan_feed
        where path in (select path from cat) or path in (select path from con)""",
    "remove_tree": f"with {_CAT} select path, kind from cat where path <> '/storage/card0' and not starts_with(path, '/storage/card0/')",
    "external_feed": f"""with f as (select distinct path, kind from name_record where path is not null)
        select path, {_NAME} as name, 0::bigint as size, 0::bigint as mtime_ms, kind from f
        where (path = '/storage/card0' or starts_with(path, '/storage/card0/')) and not regexp_matches(path, '[\\r\\n]') and {_NAME} <> ''
            and not regexp_matches(path, '(^|/)[.][.]?(/|$)')""",
    "display_format": f"""with {_CAT}, t as (select *, case when size >= 1073741824 then 30 when size >= 1048576 then 20 when size >= 1024 then 10 end as p from cat),
        u as (select *, floor(size * 10 / (1 << p) + 0.5)::bigint as tenths from t)
        select path, case when p is null then case when size > 0 then size || ' B' else '' end
            else (tenths // 10) || '.' || (tenths % 10) || case p when 10 then ' KB' when 20 then ' MB' else ' GB' end end as size_text,
            case when mtime_ms > 0 then strftime(make_timestamp(mtime_ms * 1000), '%Y-%m-%d %H:%M') else '' end as time_text, {_MIME} as mime from u""",
    "ext_rollup": f"""with {_CAT}, t as (select origin, {_TYPE} as ftype, size from cat)
        select coalesce(origin, '*') as origin, coalesce(ftype, '*') as ftype, count(*) as n, sum(size)::bigint as bytes from t group by rollup (origin, ftype)""",
    "ext_event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2",
    "ext_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as starts from events window w as (partition by user_id order by ts)),
        s as (select user_id, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as s from g),
        c as (select user_id, s, count(*) as n from s group by user_id, s)
        select user_id, count(*) as sessions, max(n) as longest from c group by user_id""",
}
