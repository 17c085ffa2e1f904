"""SQL (DuckDB's dialect) of the queries of this subpackage that SQL can express.

Widths, unseen characters, kinds of space and look-alike letters are levelled with
``translate`` over the same tables the operators derive from the Unicode data, then
accents are composed; a text reads like another if both come out equal.
"""

from __future__ import annotations

from lodestack.llm.forms import LAST, forms
from lodestack.llm.tokens import _is_single


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def levelled(column: str) -> str:
    """A value with all that reads the same made equal."""
    f = forms()
    one = {cp: to for cp, to in f.fold.items() if len(to) == 1 and cp not in f.joining}
    none = [cp for cp, to in f.fold.items() if not to and cp < LAST]
    out = column
    for cp, to in f.fold.items():  # joined letters of European scripts
        if len(to) > 1 and (cp < 0x590 or 0x2160 <= cp < 0x2180 or 0xFB00 <= cp < 0xFB07):
            out = f"replace({out}, {_quoted(chr(cp))}, {_quoted(to)})"
    # translate drops characters beyond the length of the second list
    out = f"translate({out}, {_quoted(''.join(map(chr, [*one, *none])))}, {_quoted(''.join(one.values()))})"
    # a borrowed letter may take up the accent behind it once it is put right
    return f"nfc_normalize(translate(nfc_normalize({out}), {_quoted(''.join(f.twins))}, {_quoted(''.join(f.twins.values()))}))"


def _ranges() -> str:
    out, start = [], None
    for cp in range(0x3000, LAST + 1):
        inside = cp < LAST and _is_single(cp)
        if inside and start is None:
            start = cp
        if not inside and start is not None:
            out.append(f"\\x{{{start:X}}}-\\x{{{cp - 1:X}}}")
            start = None
    return "".join(out)


def tokens(column: str) -> str:
    """The list of tokens of a text: runs of letters and digits, Chinese characters and kana by themselves."""
    # kana and Han are parted by blanks first, so that a run ends before them
    single = _ranges()
    low = f"lower({levelled(column)})"
    return f"regexp_extract_all(regexp_replace({low}, '([{single}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{Nd}}]+')"


def _p3() -> str:
    names = f"select 'name_lower' as src_field, name_id as id, name_lower as value, {levelled('name_lower')} as key from name_record where name_id is not null and name_lower is not null"
    texts = f"select 'text', row_id, text, {levelled('text')} from content_store where row_id is not null and text is not null"
    whole = "array_to_string(list_transform(terms, lambda x: coalesce('1' || x, '0')), chr(30))"
    terms = f"select 'terms', query_id, {whole}, {levelled(whole)} from query_log where query_id is not null and terms is not null"
    return f"with r as ({names} union {texts} union {terms})"


_GROUPS = """, g as (
        select src_field, key, min(id) as group_id, count(*) as n_rows, count(distinct value) as n_spellings from r group by src_field, key)
    select distinct src_field, id, group_id, n_rows, n_spellings from r join g using (src_field, key) where n_spellings > 1"""


def _shingles() -> str:
    return f"""
    t as (select row_id, any_value({tokens("text")}) as w from content_store where row_id is not null and text is not null group by row_id),
    s as (select distinct row_id, hash(w[i:i+3]) as gram from (select row_id, w, unnest(range(1, len(w) - 2)) as i from t where len(w) >= 4)),
    n as (select row_id, count(*) as n from s group by row_id),
    common as (select a.row_id as row_a, b.row_id as row_b, count(*) as k from s a join s b on a.gram = b.gram and a.row_id < b.row_id group by all),
    pairs as (
        select row_a, row_b from common join n x on x.row_id = row_a join n y on y.row_id = row_b where k >= 0.6 * (x.n + y.n - k)
        union select a.row_id, b.row_id from t a join t b on a.w = b.w and a.row_id < b.row_id and len(a.w) > 0)"""


def _groups() -> str:
    """Classes of equal token sets, links between classes, and their connected components."""
    return f"""
    t as (select row_id, any_value({tokens("text")}) as w from content_store where row_id is not null and text is not null group by row_id),
    s as (select distinct row_id, hash(w[i:i+3]) as gram from (select row_id, w, unnest(range(1, len(w) - 2)) as i from t where len(w) >= 4)),
    keys as (select row_id, 's' || hash(list(gram order by gram)) as key from s group by row_id union all select row_id, 't' || hash(w) from t where len(w) between 1 and 3),
    members as (select row_id, min(row_id) over (partition by key) as class_id from keys),
    r as (select s.* from s join members using (row_id) where row_id = class_id),
    n as (select row_id, count(*) as n from r group by row_id),
    common as (select a.row_id as a, b.row_id as b, count(*) as k from r a join r b on a.gram = b.gram and a.row_id < b.row_id group by all),
    links as (select a, b from common join n x on x.row_id = a join n y on y.row_id = b where k >= 0.6 * (x.n + y.n - k)),
    both_ways as (select a, b from links union all select b, a from links),
    reach as (select distinct class_id as node, class_id as seen from members union select reach.node, both_ways.b from reach join both_ways on reach.seen = both_ways.a),
    labels as (select node, min(seen) as group_id from reach group by node),
    degrees as (select a as class_id, count(*) as n_links from both_ways group by a)"""


def _runs() -> str:
    return f"""
    p as (select item_id, {tokens("passage")} as w, case when lang in ('zh', 'ja') then 40 else 20 end as need from eval_item where item_id is not null and passage is not null),
    d as (select doc_id, {tokens("text")} as w from documents where doc_id is not null and text is not null),
    pg as (select distinct item_id, need, hash(w[i:i+need-1]) as gram from (select *, unnest(range(1, len(w) - need + 2)) as i from p where len(w) >= need)),
    dg as (select distinct doc_id, need, hash(w[i:i+need-1]) as gram from (select doc_id, w, need, unnest(range(1, len(w) - need + 2)) as i from d, (values (20), (40)) v(need) where len(w) >= need))"""


SQL = {
    "p3_found": f"""{_p3()} select distinct a.src_field, a.id as id_a, b.id as id_b from r a join r b on a.src_field = b.src_field and a.key = b.key and a.value <> b.value and a.id < b.id""",
    "p3_groups": f"{_p3()}{_GROUPS}",
    "p4_found": f"with {_shingles()} select row_a, row_b from pairs",
    "p4_groups": f"with recursive {_groups()} select row_id, class_id, group_id, coalesce(n_links, 0) as n_links from members join labels on node = class_id left join degrees using (class_id)",
    "p6_invariants": """select spec_id, (select count(distinct doc_id) from documents where length(text) > 0) as documents, 0::bigint as misplaced,
        0::bigint as above_capacity, 0::bigint as split_needlessly from pack_spec""",
    "p7_found": f"with {_runs()} select distinct doc_id, item_id from pg join dg using (need, gram)",
}
