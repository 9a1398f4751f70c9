"""SQL of the queries, for a check on the same tables by another engine. Its regular
expressions know no look-around and ASCII classes only; the helpers say the same in its
terms. Fragments with @name@ are put in from PARTS."""

from __future__ import annotations

# Fixed values, written out here so that the SQL takes nothing from what it checks.
DOMAIN_KEYWORDS = {
    "finance": "trading strategy alpha quant portfolio risk market stock bond derivative".split(),
    "hardware": "server ic latency fpga network cpu gpu memory cache".split(),
    "engineering": "architecture system design pattern algorithm optimization".split(),
    "fiction": "character plot story narrative chapter scene".split(),
}
MODEL_DOMAINS = "finance hardware engineering fiction science technology mathematics medicine law general".split()
# HTML to Markdown, in RE2's terms.
HTML_STEPS = (
    (r"(?is)<(script|style|head|title)\b.*?</(script|style|head|title)>", ""), (r"(?s)<!--.*?-->", ""),
    (r"(?i)<h1[^>]*>", "\n# "), (r"(?i)<h2[^>]*>", "\n## "), (r"(?i)<h3[^>]*>", "\n### "), (r"(?i)</h[1-6]>|</p>|</div>|</li>|<br[^>]*>", "\n"), (r"(?i)<li[^>]*>", "- "),
    (r"""(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>""", r"[\2](\1)"), (r"(?s)<[^>]*>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\n{3,}", "\n\n"),
)
BUCKETS = ("0.5", "1.0", "2.5", "5.0", "10.0", "25.0", "50.0", "100.0", "250.0")
GAUGES = {"service_up": "Whether the service is up.", "active_requests": "Number of currently active requests."}
COUNTERS = {"requests_total": "Total number of HTTP requests.", "requests_success_total": "Total number of successful requests.", "requests_failed_total": "Total number of failed requests."}
ERROR_RATE = "Current error rate (failed / total requests)."
DURATION = "conversion_duration_seconds"
HEADS = {"KnowledgeConcept": "## Key Concepts", "Hardware": "## Hardware", "Strategy": "## Strategies", "Narrative": "## Narratives"}
OTHER_HEAD, RELATIONSHIPS_HEAD = "## Additional Information", "## Relationships"
CARD = [("**Domain:**", "domain"), ("**Technical Description:**", "technical_desc_en"), ("**Simple Explanation:**", "layman_explanation"), ("**Analogy:**", "analogy"), ("**Creative Seed:**", "null"), ("**Visual Concept:**", "null")]
SENTENCES_OF_A_TERM = {
    "technical_desc_en": "Extracted key term: {term}",
    "layman_explanation": "A key concept named '{term}' identified in the source document. Further analysis is needed to provide a detailed explanation.",
    "analogy": "Like finding a notable landmark while exploring an unfamiliar city — '{term}' stands out as something worth understanding more deeply.",
    "visual_concept": "A conceptual diagram centered around the term '{term}', with connecting lines to related ideas and examples.",
    "fiction_seed": "In a world where '{term}' holds the key to an unexpected discovery, a protagonist must unravel its secrets before time runs out.",
}


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _markdown() -> str:
    out = "coalesce(html, '')"
    for pattern, to in HTML_STEPS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return _strip(out)


def _domain(x: str) -> str:
    """struct of the best domain of a lower-cased text."""
    rows = []
    for k, (name, words) in enumerate(DOMAIN_KEYWORDS.items()):
        n = " + ".join(f"contains(lower({x}), '{w}')::int" for w in words)
        rows.append(f"{{'n': {n}, 'k': {-k}, 'domain': '{name}', 'confidence': round(({n}) / {len(words)}::double, 2)}}")
    return f"list_max([{', '.join(rows)}])"


def _cosine(a: str, b: str) -> str:
    return f"list_inner_product({a}::double[], {b}::double[]) / (sqrt(list_inner_product({a}::double[], {a}::double[])) * sqrt(list_inner_product({b}::double[], {b}::double[])))"


PARTS = {
    "sentences": rf"list_filter(list_transform(string_split(replace(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')",
    # sentences of over 1,500 bytes are cut there, between characters
    "safe": """raw as (select doc_id, unnest(@sentences@) as s, unnest(range(len(@sentences@))) as i from docs),
        cuts as (select doc_id, i, s, case when strlen(s) > 1500 then list_reduce(list_transform(string_split(s, ''), lambda x: {'out': []::int[], 'n': strlen(x)::int, 'k': 0}),
          lambda a, x: case when a.n + x.n > 1500 then {'out': list_append(a.out, a.k), 'n': x.n, 'k': a.k + 1} else {'out': a.out, 'n': a.n + x.n, 'k': a.k + 1} end, {'out': []::int[], 'n': 0, 'k': 0}) end as f from raw),
        ranges as (select doc_id, i, s, case when f is null then [0] else list_concat([0], f.out) end as a, case when f is null then [length(s)::int] else list_append(f.out, f.k) end as b from cuts),
        safe as (select doc_id, i, unnest(range(len(a))) as j, substr(s, unnest(a) + 1, unnest(b) - unnest(a)) as s from ranges)""",
    "docs": "docs as (select doc_id, coalesce(text, '') as content from documents)",
    "pages": f"docs as (select page_id as doc_id, {_markdown()} as content from pages)",
    "talks": "docs as (select conv_id as doc_id, string_agg(repeat('#', (1 + (turn * 7) % 4)::int) || ' ' || role || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) order by turn) as content from conversations group by 1)",
    # letters and numbers beyond ASCII become "_", a word character that no term has
    "terms": r"""
        clean as (select doc_id, regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'), '[^\x00-\x7F]', '_', 'g') as c,
                         lower(regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g')) as low from docs),
        proper as (select doc_id, unnest(l) as term, unnest(range(len(l))) as i from (select doc_id, regexp_extract_all(c, '\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*)\b', 1) as l from clean)),
        word as (select doc_id, unnest(l) as term, unnest(range(len(l))) as i from (select doc_id, regexp_extract_all(regexp_replace(low, '[^\x00-\x7F]', '_', 'g'), '\b([a-zA-Z]{4,})\b', 1) as l from clean)),
        often as (select doc_id, term, min(i) as i from word group by doc_id, term having count(*) >= 3 qualify row_number() over (partition by doc_id order by min(i)) <= 50),
        every as (select doc_id, term, 0 as src, i from proper union all select doc_id, term, 1, i from often),
        once as (select doc_id, term, min((src, i)) as place from every group by all),
        keyed as (select doc_id, term, row_number() over (partition by doc_id order by place) - 1 as pos from once),
        kt as (select * from keyed where pos < 50),
        mentions as (select doc_id, lower(term) as term from kt)""",
    "requests": "r as (select event_type as endpoint, (200 + 100 * (event_id % 4))::int as status, value as duration, event_id as id, ts, user_id from events)",
    "star": "star as (select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'HAS_NATION' as type from nation union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' from supplier "
    "union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LIVES_IN' from customer union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'PLACED' from orders), "
    "step as (select src as id, dst as nxt, type || ':outgoing' as step from star union all select dst, src, type || ':incoming' from star)",
    "sections": r"""
        ln as (select doc_id, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as start_line, len(string_split(content, chr(10))) as n from docs),
        hd as (select doc_id, n, start_line, length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) as level, regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2), '^\s+|\s+$', '', 'g') as title from ln where regexp_matches(line, '^(#{1,6})\s+(.+)$')),
        ix as (select *, row_number() over (partition by doc_id order by start_line) - 1 as idx, coalesce(lead(start_line) over (partition by doc_id order by start_line), n) - 1 as end_line from hd),
        sec as (select doc_id, doc_id || '_section_' || idx as section_id, idx::int as idx, level::int as level, title, start_line::int as start_line, end_line::int as end_line,
                coalesce(doc_id || '_section_' || (select max(p.idx) from ix p where p.doc_id = ix.doc_id and p.idx < ix.idx and p.level < ix.level), '') as parent_id from ix)""",
    "cards": "cards as (select 0 as query, p_partkey as pos, 'p' || (p_partkey % 120) as id, ['KnowledgeConcept', 'Hardware', 'Strategy', 'Narrative', 'ContentAsset', 'Zeta'][p_partkey % 6 + 1] as label, case when p_partkey % 2 = 0 then p_brand end as name_th, "
    "case when p_partkey % 3 = 0 then p_name end as name_en, case when p_partkey % 5 <> 0 then p_retailprice / 1000 else 0 end as score, p_type as domain, p_name as technical_desc_en, case when p_partkey % 4 <> 0 then p_type end as layman_explanation, case when p_partkey % 4 = 0 then 'like it' end as analogy from part)",
    "titled": r"titled as (select doc_id, case when t = '' then 'Untitled Document' else t end as title from (select doc_id, regexp_replace(regexp_extract(content, '(?m)^#\s+(.+)$', 1), '^\s+|\s+$', '', 'g') as t from docs))",
    "stores": "q as (select vec_id as query, embedding as e from embeddings where vec_id % 20 = 0), pts as (select query, vec_id as id, " + _cosine("embedding", "e") + " as c from embeddings, q where vec_id <> query), "
    "fs as (select query, id, c as score from pts qualify row_number() over (partition by query order by c desc, id) <= 20), ss as (select query, id, (1 + c) / 2 as score from pts where id % 3 <> 0 qualify row_number() over (partition by query order by c desc, id) <= 20)",
}


def sql(name: str, text: str) -> None:
    for _ in range(2):  # parts may hold parts
        for key, part in PARTS.items():
            text = text.replace(f"@{key}@", part)
    ORACLE_SQL[name] = text


ORACLE_SQL: dict[str, str] = {}

sql("sentence_split", "with @docs@, s as (select doc_id, @sentences@ as l from docs) select doc_id, unnest(range(len(l)))::int as pos, unnest(l) as sentence from s")
STATE = "{'out': []::varchar[], 'cur': null::varchar, 'n': 0}"
WORDS = rf"""list_reduce(list_transform(list_filter(string_split_regex(s, '\s+'), lambda w: w <> ''), lambda w: {{'out': []::varchar[], 'cur': w, 'n': length(w)::int}}),
    lambda a, w: case when a.n + w.n + 1 > 500 and a.cur is not null then {{'out': list_append(a.out, a.cur), 'cur': w.cur, 'n': w.n + 1}} else {{'out': a.out, 'cur': case when a.cur is null then w.cur else a.cur || ' ' || w.cur end, 'n': a.n + w.n + 1}} end, {STATE})"""
OVERLAP = "case when len(l) = 0 then 0 else least(trunc(list_sum(list_transform(l, lambda x: length(x))) / len(l)::double * 0.15)::int, 75) end::int"


def _chunks(overlap: str) -> str:
    kept = "string_split(case when o < length(a.cur) then right(a.cur, o) else a.cur end, ' ')[-1]"
    return f"""w as (select doc_id, i, j, s, case when length(s) > 500 then {WORDS} end as w from safe),
    l as (select doc_id, list({{'out': case when w is null then []::varchar[] else list_append(w.out, w.cur) end, 'cur': s, 'n': length(s)::int}} order by i, j) as l from w group by 1),
    o as (select l.*, {overlap} as o from l join docs using (doc_id)),
    f as (select doc_id, list_reduce(l, lambda a, s: case
        when s.n > 500 then {{'out': list_concat(list_concat(a.out, case when a.cur is null then []::varchar[] else [a.cur] end), s.out), 'cur': null::varchar, 'n': 0}}
        when a.n + s.n > 500 and a.cur is not null then {{'out': list_append(a.out, a.cur), 'cur': case when o > 0 then {kept} || ' ' || s.cur else s.cur end, 'n': (case when o > 0 then length({kept}) else 0 end + s.n + 1)::int}}
        else {{'out': a.out, 'cur': case when a.cur is null then s.cur else a.cur || ' ' || s.cur end, 'n': a.n + s.n + 1}} end, {STATE}) as f from o),
    c as (select doc_id, case when f.cur is null then f.out else list_append(f.out, f.cur) end as c from f)
    select doc_id || '_chunk_' || unnest(range(len(c))) as point_id, doc_id, unnest(range(len(c)))::int as chunk_id, unnest(c) as content from c"""


sql("chunk_character", f"with @docs@, @safe@, {_chunks('75')}")
sql("chunk_ratio", f"with @docs@, @safe@, {_chunks(OVERLAP.replace('len(l)', 'len(@sentences@)').replace('(l,', '(@sentences@,'))}")
sql("chunk_bytes", "with docs as (select page_id as doc_id, repeat('漢字かな😀', 200 + (page_id % 7)::int) || 'x' || page_id as content from pages), @safe@, " + _chunks("75"))
sql("overlap_size", "with @docs@, s as (select doc_id, @sentences@ as l from docs) select doc_id, " + OVERLAP + " as overlap from s")
sql(
    "tts_split",
    f"""with @docs@, s as (select doc_id, content, list_filter(list_transform(string_split(regexp_replace(replace(regexp_replace(content, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), '۔', '۔' || chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') as l from docs),
    f as (select doc_id, content, l, list_reduce(list_transform(l, lambda x: {{'out': []::varchar[], 'cur': x, 'n': length(x)::int}}),
        lambda a, s: case when a.n + s.n > 300 and a.cur is not null then {{'out': list_append(a.out, a.cur), 'cur': s.cur, 'n': s.n}} else {{'out': a.out, 'cur': case when a.cur is null then s.cur else a.cur || ' ' || s.cur end, 'n': a.n + s.n}} end, {STATE}) as f from s),
    c as (select doc_id, case when length(content) <= 300 then [content] when len(l) > 0 then list_append(f.out, f.cur) else list_transform(range((ceil(length(content) / 300.0))::bigint), lambda i: substr(content, i * 300 + 1, 300)) end as c from f)
    select doc_id, unnest(range(len(c)))::int as pos, unnest(c) as chunk from c""",
)
sql("stream_slices", "with s as (select page_id, html, unnest(range(ceil(length(html) / 1024.0)::bigint)) as i from pages) select page_id, i::int as pos, substr(html, i * 1024 + 1, 1024) as slice from s")
sql(
    "byte_split",
    """with @docs@, c as (select doc_id, list_transform(string_split(content, ''), lambda x: {'out': []::int[], 'n': strlen(x)::int, 'at': 1, 'k': 0}) as l, content from docs where content <> ''),
    f as (select doc_id, content, list_reduce(l, lambda a, x: case when a.n + x.n > 1500 then {'out': list_append(a.out, a.k), 'n': x.n, 'at': 1, 'k': a.k + 1} else {'out': a.out, 'n': a.n + x.n, 'at': 1, 'k': a.k + 1} end, {'out': []::int[], 'n': 0, 'at': 1, 'k': 0}) as f from c),
    p as (select doc_id, content, list_concat([0], f.out) as a, list_append(f.out, f.k) as b from f),
    u as (select doc_id, content, unnest(range(len(a)))::int as pos, unnest(a) as a, unnest(b) as b from p)
    select doc_id, pos, strlen(substr(content, a + 1, b - a))::int as bytes, md5(substr(content, a + 1, b - a)) as digest from u""",
)
LANGUAGE = rf"""(select doc_id, content, length({_strip("content")}) as n, length(regexp_replace(content, '[^฀-๿]', '', 'g')) as th, length(regexp_replace(content, '[^A-z]', '', 'g')) as la from docs)"""
CODE = "case when n = 0 then 'en' when th > 0 and la > 0 then 'mixed' when th > 0 then 'th' else 'en' end"
sql("detect_language", f"with @docs@ select doc_id, {CODE} as language, case when n = 0 then 0.0 when th + la = 0 then 0.1 else least(1.0, format('{{:.2f}}', (th + la) / n::double)::double) end::double as confidence from {LANGUAGE}")
sql("detect_domain", f"with @docs@, b as (select doc_id, {_domain('content')} as b from docs) select doc_id, case when b.n = 0 then 'general' else b.domain end as domain, case when b.n = 0 then 0.0 else b.confidence end::double as confidence from b")
sql("model_domain", f"select p_partkey, coalesce(list_filter([{', '.join(_quoted(x) for x in MODEL_DOMAINS)}], lambda x: contains('the domain is ' || lower(p_type) || case when p_partkey % 3 = 0 then ' medicine' when p_partkey % 3 = 1 then ' law' else '' end, x))[1], 'general') as domain from part")
sql(
    "front_matter",
    f"""with docs as (select doc_id, source, case when doc_id % 3 = 0 then '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || text else text end as content from documents),
    b as (select l.*, source, {_domain("l.content")} as best from {LANGUAGE} l join (select doc_id, source from docs) using (doc_id)),
    o as (select doc_id, case when doc_id % 3 = 0 then content else '---' || chr(10) || 'domain: ' || case when best.n = 0 then 'general' else best.domain end || chr(10) || 'language: ' || case when th > 0 and la > 0 then 'mixed' when th > 0 then 'th' else 'en' end || chr(10)
      || 'source_pdf: ' || source || '.pdf' || chr(10) || 'processed_date: 2024-01-01T00:00:00Z' || chr(10) || '---' || chr(10) || chr(10) || content end as o from b)
    select doc_id, md5(o) as digest, length(o)::int as n from o""",
)
sql("html_markdown", "with @pages@ select doc_id as page_id, md5(content) as digest, length(content)::int as n from docs")
sql("sections", "with @talks@, @sections@ select * from sec")
sql("titles", "with @pages@, @titled@ select * from titled")
sql("links", r"with @pages@, l as (select doc_id, regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 1) as t, regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 2) as u from docs), x as (select doc_id, unnest(range(len(t)))::int as idx, unnest(t) as text, unnest(u) as url from l) select doc_id, idx, doc_id || '_link_' || idx as id, text, url from x")
sql(
    "code_blocks",
    r"""with docs as (select conv_id as doc_id, string_agg('```' || case when turn % 2 = 0 then role else '' end || chr(10) || coalesce(text, '') || chr(10) || '```', chr(10) order by turn) as content from conversations group by 1),
    l as (select doc_id, regexp_extract_all(content, '(?s)```(\w*)\s*\n(.*?)```', 1) as k, regexp_extract_all(content, '(?s)```(\w*)\s*\n(.*?)```', 2) as c from docs),
    x as (select doc_id, unnest(range(len(k))) as idx, unnest(k) as k, unnest(c) as c from l)
    select doc_id, doc_id || '_code_' || idx as id, case when k = '' then 'unknown' else k end as language, md5(regexp_replace(c, '^\s+|\s+$', '', 'g')) as digest from x""",
)
sql("key_terms", "with @docs@, @terms@ select doc_id, pos::int as pos, term from kt")
sql("term_graph", "with @docs@, @terms@ select term as name, count(*) as count from mentions group by 1")
sql(
    "graph_edges",
    """with @pages@, @sections@, @terms@, held as (select distinct doc_id, term from mentions),
    lk as (select doc_id, unnest(range(len(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)]+)\\)')))) as i from docs),
    e as (select doc_id::varchar as src, section_id as dst, 'HAS_SECTION' as type from sec union all select parent_id, section_id, 'CONTAINS_SECTION' from sec where parent_id <> '' union all select doc_id::varchar, term, 'MENTIONS_TERM' from held
      union all select doc_id::varchar, doc_id || '_link_' || i, 'REFERENCES_URL' from lk union all select a.doc_id::varchar, b.doc_id::varchar, 'RELATED_TO' from held a join held b using (term) where a.doc_id <> b.doc_id)
    select type, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from e group by 1""",
)
sql("related_edges", "with @docs@, @terms@, held as (select distinct doc_id, term from mentions) select term as via_term, doc_id, count(*) over (partition by term) as n_docs from held qualify n_docs > 1")
sql("related_pairs", "with docs as (select item_id as doc_id, text as content from benchmark), @terms@, held as (select distinct doc_id, term from mentions) select a.doc_id as src, b.doc_id as dst, a.term as via_term from held a join held b using (term) where a.doc_id <> b.doc_id")
sql(
    "graph_search",
    """with @pages@, @sections@, @terms@, @titled@,
    nodes as (select doc_id, section_id as node, title as name from sec union all select doc_id, term, term from mentions),
    m as (select w, n.doc_id, t.title, count(distinct node) as c from nodes n join titled t using (doc_id), (select unnest(['the', 'and', 'ation']) as w) where contains(lower(n.name), w) or contains(lower(t.title), w) group by w, n.doc_id, t.title qualify row_number() over (partition by w order by count(distinct node) desc, n.doc_id) <= 10)
    select doc_id, title, sum(c)::bigint as related_count from m group by all order by related_count desc, doc_id limit 10""",
)
PATHS = "held as (select distinct doc_id, term from mentions), c as (select a.doc_id as x, b.doc_id as y, count(*) as n from held a join held b using (term) where a.doc_id <> b.doc_id group by all)"
sql(
    "related_docs",
    f"with @docs@, @terms@, {PATHS}, p as (select y, n from c where x = 0 union all select b.y, a.n * b.n from c a join c b on a.x = 0 and a.y = b.x) select y as doc_id, sum(n)::bigint as strength from p group by 1 order by strength desc, doc_id limit 20",
)
sql(
    "related_paths",
    f"with docs as (select item_id as doc_id, text as content from benchmark), @terms@, {PATHS}, p as (select y, n from c where x = 0 union all select b.y, a.n * b.n from c a join c b on a.x = 0 and a.y = b.x "
    "union all select d.y, a.n * b.n * d.n - case when a.y = d.y and b.y = 0 then a.n * b.n else 0 end from c a join c b on a.x = 0 and a.y = b.x join c d on b.y = d.x) select y as doc_id, sum(n)::bigint as strength from p group by 1 having sum(n) > 0 order by strength desc, doc_id limit 20",
)
HOP = "h{k} as (select nxt as id, {k} as hops, min({chain}) as chain from {front} join step using (id) where {known} group by 1)"


def _hops(seeds: str, n: int) -> str:
    parts = [f"h0 as (select unnest([{seeds}]) as id, 0 as hops, '' as chain)"]
    for k in range(1, n + 1):
        known = " and ".join(f"nxt not in (select id from h{j})" for j in range(k))
        parts.append(HOP.format(k=k, chain="step" if k == 1 else "chain || '>' || step", front=f"h{k - 1}", known=known))
    return ", ".join(parts) + ", found as (" + " union all ".join(f"select * from h{k}" for k in range(1, n + 1)) + ")"


sql("expand_hops", f"with @star@, {_hops("'nation:3', 'region:1'", 2)} select * from found")
sql("expand_limit", f"with @star@, {_hops("'nation:3'", 3)} select * from found order by hops, id limit 50")
sql("expand_labels", f"with @star@, {_hops("'nation:3', 'region:1'", 2)} select * from found where starts_with(id, 'customer:') or starts_with(id, 'region:')")
sql("vector_topk", f"with q as (select embedding as e from embeddings where vec_id = 0), s as (select vec_id as id, {_cosine('embedding', 'e')} as s from embeddings, q) select id, round(s, 6) as score from s order by s desc, id limit 10")
sql("vector_topk_many", f"with q as (select vec_id as query, embedding as e from embeddings where vec_id % 20 = 0), s as (select query, vec_id as id, (1 + {_cosine('embedding', 'e')}) / 2 as s from embeddings, q), r as (select *, row_number() over (partition by query order by s desc, id)::int as rank from s) select query, id, round(s, 6) as score, rank from r where rank <= 10")
sql("semantic_groups", f"with l as (select vec_id as id, label, embedding as a, lag(embedding) over (partition by label order by vec_id) as b from embeddings), k as (select id, label, case when b is null then 0 when {_cosine('a', 'b')} >= 0.1 then 0 else 1 end as br from l) select id, label, sum(br) over (partition by label order by id)::bigint as \"group\" from k")
sql(
    "hybrid_fusion",
    f"""with @docs@, @terms@, {PATHS}, q as (select embedding as e from embeddings where vec_id = 0), h as (select vec_id as id, {_cosine("embedding", "e")} as s from embeddings, q order by s desc, id limit 20),
    v as (select id // 2 as doc_id, max(s) as vs, arg_max('v' || id, s) as content from h group by 1), g as (select y as doc_id, n::double as gs from c where x = 0 order by n desc, y limit 20),
    b as (select coalesce(v.doc_id, g.doc_id) as doc_id, coalesce(content, '') as content, coalesce(vs, 0) as vs, coalesce(gs, 0) as gs, (select max(gs) from g) as top from v full join g on v.doc_id = g.doc_id)
    select doc_id, content, round(vs, 6) as vector_score, round(gs, 6) as graph_score, round(0.5 * gs / top + 0.5 * vs, 6) as score from b order by 0.5 * gs / top + 0.5 * vs desc, doc_id limit 10""",
)
sql(
    "hybrid_search",
    f"""with star as (select 'doc:' || doc_id as src, 'source:' || source as dst, 'FROM_SOURCE' as type from documents union all select 'doc:' || vec_id, 'label:' || label, 'HAS_LABEL' from embeddings),
    step as (select src as id, dst as nxt, type || ':outgoing' as step from star union all select dst, src, type || ':incoming' from star),
    q as (select embedding as e from embeddings where vec_id = 0), top as (select 'doc:' || vec_id as id, {_cosine("embedding", "e")} as s from embeddings, q order by s desc, id limit 3),
    h0 as (select id, 0 as hops, '' as chain from top), {", ".join(HOP.format(k=k, chain="step" if k == 1 else "chain || '>' || step", front=f"h{k - 1}", known=" and ".join(f"nxt not in (select id from h{j})" for j in range(k))) for k in (1, 2))},
    near as (select * from (select * from h1 union all select * from h2) order by hops, id limit 50),
    r as (select id, s as score, 0 as hops, '' as chain from top union all select id, 0, hops, chain from near)
    select r.id, round(score, 6) as score, hops, chain, case when d.doc_id is not null then 'ContentAsset' end as label, upper(lang) || ' ' || source as name_en from r left join documents d on r.id = 'doc:' || d.doc_id""",
)
sql("dedupe_rank", "with r as (select vec_id % 100 as id, embedding[1]::double as s, vec_id as pos from embeddings) select id, pos, round(s, 6) as score from r qualify row_number() over (partition by id order by s desc, pos) = 1")
sql("dual_merge", "with @stores@, u as (select *, 0 as backend from fs union all select *, 1 from ss) select query, id, round(score, 6) as score, backend from u qualify row_number() over (partition by query, id order by score desc, backend) = 1")
sql("parity_report", "with @stores@ select query, id, round(abs(fs.score - ss.score), 6) as delta from fs join ss using (query, id)")
sql("parity_counts", "with @stores@, f as (select query, count(*) as n from fs group by 1), s as (select query, count(*) as n from ss group by 1), o as (select query, count(*) as n from fs join ss using (query, id) group by 1) select f.query, f.n as first_count, s.n as second_count, coalesce(o.n, 0) as overlap from f join s using (query) left join o using (query)")
CHANGES = "ch as (select o_orderkey as seq, case when o_orderkey % 10 = 0 then 'Unknown' else 'ContentAsset' end as label, 'c' || o_custkey as id, case when o_orderkey % 2 = 1 then o_orderpriority end as name_en, o_orderstatus as domain from orders)"
sql("node_upsert", f"with {CHANGES}, u as (select -1 as seq, 'ContentAsset' as label, 'c' || c_custkey as id, c_name as name_en, c_mktsegment as domain from customer union all select * from ch where label <> 'Unknown') select label, id, arg_max(domain, seq) filter (domain is not null) as domain, arg_max(name_en, seq) filter (name_en is not null) as name_en from u group by all")
sql("node_rejects", f"with {CHANGES} select 'unknown label' as reason, count(*) as n from ch where label = 'Unknown' having count(*) > 0")
EDGES = "ch as (select l_linenumber * 100 + l_quantity::bigint as seq, 'o' || l_orderkey as src, 'p' || l_partkey as dst, case when l_linenumber = 7 then 'OTHER' else 'APPLIES_TO' end as type, l_quantity as weight, l_orderkey as o, l_partkey as p from lineitem), ok as (select * from ch where o in (select o_orderkey from orders where o_orderkey % 2 = 0) and p in (select p_partkey from part where p_partkey % 5 < 4))"
sql("edge_upsert", f"with {EDGES} select src, dst, type, arg_max(weight, seq) as weight from ok where type = 'APPLIES_TO' group by all")
sql("edge_unmatched", f"with {EDGES} select type, count(*) as n from (select * from ch except all select * from ok) group by 1")
sql("embedding_set_delete", "select vec_id as id, vec_id % 3 = 0 as was_set, vec_id % 5 = 0 as was_deleted, (vec_id % 2 = 0 or vec_id % 3 = 0) and vec_id % 5 <> 0 as has from embeddings")
sql("point_upsert", "with u as (select c_custkey as point_id, c_name as content from customer where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey, s_name from supplier) select * from u where point_id not in (select n_nationkey from nation)")
sql("dual_write_outcome", "with o as (select event_id % 2 = 0 as a, event_id % 3 = 0 as b from events) select a or b as ok, a <> b as partial, count(*) as n from o group by all")
sql(
    "migrate_nodes",
    """with @pages@, @sections@, @terms@, @titled@, n as (
      select doc_id::varchar as id, 'ContentAsset' as label, 'document' as domain, title as name, '' as t, 'Document' as type_legacy from titled
      union all select section_id, 'KnowledgeConcept', 'section', title, 'Level ' || level || ' section: ' || title, 'Section' from sec
      union all select 'term_' || replace(term, ' ', '_'), 'KnowledgeConcept', 'term', term, 'Extracted term (frequency: ' || count(*) || ')', 'Term' from mentions group by term)
    select id, label, domain, name as name_th, name as name_en, t as technical_desc_th, t as technical_desc_en, type_legacy from n where id not in (select doc_id::varchar from docs where doc_id % 7 = 0)""",
)
sql("migrate_edges", "with @talks@, @sections@, @terms@ select doc_id::varchar as src, section_id as dst, 'HAS_CHAPTER' as type from sec union all select parent_id, section_id, 'NEXT_CHAPTER' from sec where parent_id <> '' union all select distinct doc_id::varchar, 'term_' || replace(term, ' ', '_'), 'REFERENCES_CONCEPT' from mentions")
sql("schema_check", "select n_name as name, n_nationkey % 4 <> 0 as found from nation")
sql("schema_duplicates", "select c_mktsegment as label, c_custkey % 1000 as id, count(*) as n from customer group by all having count(*) > 1")
sql(
    "context_block",
    """with @cards@, u as (select *, null::int as hops, 0 as src from cards where pos % 3 < 2 union all select * replace (0 as score), (pos % 2 + 1)::int, 1 from cards where pos % 3 > 0),
    f as (select * from u qualify row_number() over (partition by id order by src, pos) = 1),
    i as (select *, row_number() over (order by score > 0 desc, case when score > 0 then score end desc nulls last, src, pos, id) as idx from f),
    b as (select idx, concat_ws(chr(10), '## ' || idx || '. ' || case when name_th is not null and name_en is not null then name_th || ' (' || name_en || ')' else coalesce(name_th, name_en, id) end, '*Type: ' || label || '*' || chr(10),
      '📊 ' || nullif(concat_ws(' | ', case when score > 0 then 'Relevance: ' || printf('%.4f', score) end, 'Hops: ' || hops), '') || chr(10), '**Simple Explanation:** ' || layman_explanation || chr(10), '**Analogy:** ' || analogy || chr(10), '---' || chr(10)) as b from i),
    c as (select '# Search Results' || chr(10) || chr(10) || string_agg(b, chr(10) order by idx) as c, count(*) as n from b)
    select 0 as query, md5(c) as digest, n as total_nodes, length(c)::int as n from c""",
)
_HEADS = " ".join(f"when '{k}' then {_quoted(v)}" for k, v in HEADS.items())
_RANKS = " ".join(f"when '{k}' then {i}" for i, k in enumerate(HEADS))
sql(
    "assemble_context",
    f"""with @cards@, f as (select * from cards qualify row_number() over (partition by id order by pos) = 1),
    b as (select label, score, pos, '## ' || coalesce(name_en, name_th, id) || chr(10) || {" || chr(10) || ".join(f"'{k} ' || coalesce({c}, 'N/A')" for k, c in CARD)} || chr(10) as b from f),
    s as (select label, case label {_HEADS} else {_quoted(OTHER_HEAD)} end || chr(10) || chr(10) || string_agg(b, chr(10) order by score > 0 desc, case when score > 0 then -score end nulls first, pos) as s from b group by label),
    c as (select string_agg(s, chr(10) || chr(10) order by case label {_RANKS} else 4 end, label) as c from s) select 0 as query, md5(c) as digest, length(c)::int as n from c""",
)
sql(
    "relationships_block",
    f"""with r as (select n_nationkey as pos, case n_regionkey when 0 then 'depends on' when 1 then 'causes' else 'near' end as name, '- ' || n_name || ' → ' || case when n_nationkey % 2 = 0 then n_regionkey::varchar else '…' end as line from nation),
    g as (select name, min(pos) as pos, '**' || name || ':**' || chr(10) || chr(10) || string_agg(line, chr(10) order by pos) || chr(10) as t from r group by 1) select {_quoted("### " + RELATIONSHIPS_HEAD)} || chr(10) || chr(10) || string_agg(t, chr(10) order by pos) as block from g""",
)
sql(
    "tool_response",
    """select o_orderkey, md5(case when o_orderkey % 10 = 0 then '# Search Results' || chr(10) || chr(10) || '> **Empty query provided.** Please provide a search term.' else '# Search Results for: "' || o_orderpriority || '"' || chr(10) || chr(10) || '**Found ' || (o_orderkey % 4) || ' related nodes**' || chr(10) || chr(10)
      || case when o_orderkey % 4 = 0 then '> No results matched your query. Try rephrasing or using different keywords.' || chr(10) else o_orderstatus end end) as digest from orders""",
)
sql(
    "rate_limit_log",
    """with @requests@, l as (select user_id, list({'t': epoch_us(ts), 'id': id, 'held': []::bigint[], 'out': []::struct(id bigint, ok boolean, n bigint)[]} order by ts, id) as l from r where user_id is not null and ts is not null group by 1),
    f as (select user_id, list_reduce(l, lambda a, x: {'t': x.t, 'id': x.id, 'held': case when len(list_filter(a.held, lambda h: h > x.t - 86400000000)) < 3 then list_append(list_filter(a.held, lambda h: h > x.t - 86400000000), x.t) else list_filter(a.held, lambda h: h > x.t - 86400000000) end,
      'out': list_append(a.out, {'id': x.id, 'ok': len(list_filter(a.held, lambda h: h > x.t - 86400000000)) < 3, 'n': least(3, len(list_filter(a.held, lambda h: h > x.t - 86400000000)) + 1)})}, {'t': 0::bigint, 'id': 0::bigint, 'held': []::bigint[], 'out': []::struct(id bigint, ok boolean, n bigint)[]}).out as o from l),
    u as (select user_id, unnest(o) as o from f) select user_id, o.id as id, o.ok as allowed, o.n as count, 3 - o.n as remaining from u""",
)
sql(
    "rate_limit_counter",
    """with @requests@, l as (select user_id, list({'t': epoch_us(ts), 'id': id, 'ix': 0::bigint, 'now': 0::bigint, 'last': 0::bigint, 'out': []::struct(id bigint, ok boolean, c double)[]} order by ts, id) as l from r where user_id is not null and ts is not null group by 1),
    f as (select user_id, list_reduce(l, lambda a, x: {'t': x.t, 'id': x.id, 'ix': x.t // 86400000000,
      'now': case when x.t // 86400000000 = a.ix then a.now else 0 end + case when (case when x.t // 86400000000 = a.ix then a.last when x.t // 86400000000 = a.ix + 1 then a.now else 0 end) * (1 - (x.t % 86400000000) / 86400000000::double) + case when x.t // 86400000000 = a.ix then a.now else 0 end < 3 then 1 else 0 end,
      'last': case when x.t // 86400000000 = a.ix then a.last when x.t // 86400000000 = a.ix + 1 then a.now else 0 end,
      'out': list_append(a.out, {'id': x.id, 'ok': (case when x.t // 86400000000 = a.ix then a.last when x.t // 86400000000 = a.ix + 1 then a.now else 0 end) * (1 - (x.t % 86400000000) / 86400000000::double) + case when x.t // 86400000000 = a.ix then a.now else 0 end < 3,
        'c': (case when x.t // 86400000000 = a.ix then a.last when x.t // 86400000000 = a.ix + 1 then a.now else 0 end) * (1 - (x.t % 86400000000) / 86400000000::double) + case when x.t // 86400000000 = a.ix then a.now else 0 end})},
      {'t': 0::bigint, 'id': 0::bigint, 'ix': 0::bigint, 'now': 0::bigint, 'last': 0::bigint, 'out': []::struct(id bigint, ok boolean, c double)[]}).out as o from l),
    u as (select user_id, unnest(o) as o from f) select user_id, o.id as id, o.ok as allowed, round(o.c, 4) as count from u""",
)
sql("metrics_requests", "with @requests@ select endpoint, status, count(*) as requests from r group by all")
TOTALS = "t as (select count(*) as total, count(*) filter (status >= 200 and status < 400) as success, count(*) filter (not (status >= 200 and status < 400)) as failed from r)"
sql("metrics_totals", f"with @requests@, {TOTALS} select total, success, failed, round(coalesce(failed / nullif(total, 0)::double, 0), 6) as error_rate from t")
_BOUNDS = "(values " + ", ".join(f"({k}, '{b}', {b})" for k, b in enumerate(BUCKETS)) + f", ({len(BUCKETS)}, '+Inf', 1e300)) as b(ord, le, bound)"
sql("metrics_histogram", f"with @requests@ select endpoint, ord::int as ord, le, count(*) filter (duration <= bound) as bucket, count(duration) as count, round(sum(duration), 2) as sum from r, {_BOUNDS} group by endpoint, ord, le")
_HEAD: list[str] = []
for (_n, _t), _v in zip(GAUGES.items(), ("1", "0"), strict=True):
    _HEAD += [_quoted(f"# HELP {_n} {_t}"), _quoted(f"# TYPE {_n} gauge"), _quoted(f"{_n} {_v}")]
for (_n, _t), _c in zip(COUNTERS.items(), ("total", "success", "failed"), strict=True):
    _HEAD += [_quoted(f"# HELP {_n} {_t}"), _quoted(f"# TYPE {_n} counter"), f"'{_n} ' || {_c}"]
_HEAD += [_quoted(f"# HELP error_rate {ERROR_RATE}"), "'# TYPE error_rate gauge'", "'error_rate ' || printf('%.6f', failed / total::double)"]
sql(
    "prometheus_text",
    f"""with @requests@, {TOTALS}, d as (select round(duration) as duration from r), h as (select unnest(range({len(_HEAD)}))::int as pos, unnest([{", ".join(_HEAD)}]) as line from t)
    select * from h union all select (100 + ord)::int, '{DURATION}_bucket{{le="' || le || '"}} ' || count(*) filter (duration <= bound) from d, {_BOUNDS} group by ord, le
    union all select 200, '{DURATION}_count ' || count(duration) from d union all select 201, '{DURATION}_sum ' || printf('%.6f', sum(duration)) from d""",
)
sql("latency_stats", "with @requests@, s as (select endpoint, list_sort(list(duration) filter (duration is not null)) as l from r group by 1) select endpoint, round(list_avg(l), 4) as mean, round(l[1], 4) as least, round(l[-1], 4) as most, round(l[floor(len(l) * 0.95)::int + 1], 4) as p95 from s")
sql("history_ring", "with @requests@ select id, user_id from r order by ts desc, id desc limit 1000")
sql("batch_result", "with t as (select count(*) as total, count(*) filter (not ends_with(c_name, '7')) as successful from customer) select total, successful, total - successful as failed, round(successful / total::double, 6) as success_rate from t")
sql("json_repair", "select event_id, props as json from events")
sql(
    "extraction_validate",
    """with x as (select n_nationkey, n_name, n_nationkey % 5 <> 0 as good from nation),
    y as (select *, case pos when 0 then sha256(n_name || '|concepts|0') else 'x' end as made from x, (values (0), (1)) as p(pos) where good or pos = 0)
    select n_nationkey, false as complete, case when good then 0 end::int as hardware, case when good then pos end::int as pos, case when good then made end as id,
    case when good then 'unknown' end as domain, case when good then '' end as name_th, case when good then case pos when 0 then n_name else '' end end as name_en,
    case when good then case pos when 0 then '{"name_en":"' || n_name || '","tags":[1,2],"id":"' || made || '","domain":"unknown","name_th":""}' else '{"id":"x","domain":"unknown","name_th":"","name_en":""}' end end as json,
    case when good then '{"source":"' || n_name || '","target":"x","type":"USES","id":"' || sha256(n_name || '|relationships|0') || '","domain":"unknown","name_th":"","name_en":""}' end as link from y""",
)
_MADE = ", ".join(f"replace({_quoted(v)}, '{{term}}', term) as {k}" for k, v in SENTENCES_OF_A_TERM.items())
sql(
    "heuristic_extract",
    f"""with @docs@, @terms@, b as (select doc_id, {_domain("substr(content, 1, 2000)")} as b from docs)
    select doc_id, pos::int as pos, sha256(doc_id || '|concepts|' || pos) as id, case when b.n = 0 then 'general' else b.domain end as domain, term as name_en, '' as name_th, '' as technical_desc_th, {_MADE} from kt join b using (doc_id)""",
)
sql("script_names", "select o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9_ -]', '', 'g').replace(' ', '_') || '__plan_en_' || strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') || '.txt' as name from orders")
sql("visual_prompts", "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority || ' x' else 'Illustration of ' || o_orderstatus end as prompt, case when o_orderkey % 2 <> 0 then 'default' when o_orderkey % 4 = 0 then 'e2' else 'e1' end as voice from orders")
sql("empty_search", """select 'what is there' as query, '> **No results found** for query: "what is there"' || chr(10) || '> Vector search returned zero matching nodes.' || chr(10) as context_block, 0::bigint as total_nodes""")
sql("assemble_nothing", "select o_orderkey as query, case when o_orderkey % 3 = 0 then '## Additional Information' || chr(10) || chr(10) || '## ' || o_orderpriority || chr(10) || '**Domain:** N/A' || chr(10) || '**Technical Description:** N/A' || chr(10) || '**Simple Explanation:** N/A' || chr(10) when o_orderkey % 3 = 1 then '### ## Relationships' || chr(10) || chr(10) || '**supports:**' || chr(10) || chr(10) || '- a → ' || o_orderstatus || chr(10) else '> **No results** — nothing to display' end as context from orders")
sql(
    "reingest",
    """with old as (select doc_id, 'old ' || lang as content from documents), new as (select doc_id, 'new ' || source as content from documents where doc_id % 4 = 1 union all select doc_id + 1000000000, 'more ' || lang from documents where doc_id % 10 = 0)
    select doc_id || '_chunk_0' as point_id, doc_id, content from (select * from old where doc_id not in (select doc_id from new) union all select * from new)""",
)
sql("thai_terms", "with t as (select conv_id, string_split(regexp_replace(text, '^ +| +$', '', 'g'), ' ') as l from conversations where text is not null), u as (select conv_id, unnest(l) as w from t), c as (select conv_id, w from u where length(w) > 2 group by all having count(*) >= 2) select conv_id, count(*) as n, md5(string_agg(w, ' ' order by w)) as digest from c group by 1")
sql("edge_properties", "with e as (select 'o' || l_orderkey as src, 'p' || l_partkey as dst, datediff('day', date '1970-01-01', l_shipdate::date) * 10 + l_linenumber as seq, case when l_linenumber % 2 = 0 then l_shipdate end as since, 'f' || (l_linenumber % 3) as flag from lineitem) select src, dst, 'APPLIES_TO' as type, arg_max(since, seq) filter (since is not null) as since, arg_max(flag, seq) as flag from e group by src, dst")
sql("failing_embedder", "select p_partkey, case when p_partkey % 5 = 0 then 0 else 64 end::int as size from part")
sql("document_routing", "select s_suppkey, case s_suppkey % 4 when 3 then false else true end as success, case s_suppkey % 4 when 0 then s_name when 1 then '' when 2 then 'from pub' else '' end as text, case when s_suppkey % 4 in (0, 2) then 1 else 0 end::bigint as pages from supplier")
sql("vector_index_recall", "select 10 * count(*) as asked, true as good from embeddings where vec_id % 20 = 0")
sql(
    "vector_index_catalogue",
    """with p as (select vec_id as id, label::varchar as label from embeddings)
    select 'all' as name, 'VECTOR' as type, '' as labels, 'embedding' as properties, 64::int as dimensions, count(*) filter (id % 10 <> 1) + count(*) filter (id % 100 = 7) as vectors, true as ok from p
    union all select 'some', 'VECTOR', '1,2,3', 'embedding', 64::int, count(*), true from p where label in ('1', '2', '3')""",
)
ORACLE_SQL["stream_reingest"] = ORACLE_SQL["reingest"]
sql(
    "point_changes",
    """with c as (select case when o_orderkey % 3 = 0 then -o_custkey else o_custkey end as point_id, arg_max(o_orderpriority, o_orderkey) as content, arg_max(o_totalprice, o_orderkey) as total from orders group by 1)
    select * from c union all select c_custkey, c_name, 0.0 from customer where c_custkey not in (select point_id from c)""",
)
sql(
    "embedding_changes",
    """with c as (select vec_id // 2 as id, arg_max(embedding, vec_id) as e from embeddings where vec_id % 6 < 3 group by 1), g as (select distinct vec_id % 40 as id from embeddings where vec_id % 5 = 0)
    select vec_id as id, c.id is not null as was_set, g.id is not null as was_deleted,
           round(case when g.id is null then coalesce(c.e, case when vec_id % 2 = 0 then embedding end)[1]::double end, 6) as first
    from embeddings left join c on c.id = vec_id left join g on g.id = vec_id""",
)
sql("offered_load", "select user_id as client_id, event_id as request_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as offered from events where user_id is not null and ts is not null")
sql(
    "legacy_labels",
    """with l as (select c_custkey as id, case c_custkey % 4 when 0 then ['Document', c_mktsegment] when 1 then ['Term'] when 2 then ['Section', 'Term'] else [c_mktsegment] end as l, c_custkey % 5 < 3 as migrated from customer)
    select id, array_to_string(case when migrated and id % 4 < 3 then list_filter(l, lambda x: x not in ('Document', 'Section', 'Term')) else l end, ',') as labels,
           case when migrated then case id % 4 when 0 then 'Document' when 1 then 'Term' when 2 then 'Term' end end as type_legacy from l""",
)
sql("store_hits", f"with q as (select embedding as e from embeddings where vec_id = 0), h as (select vec_id as id, label, {_cosine('embedding', 'e')} as s from embeddings, q order by s desc, id limit 25) select id, '' as content, round(s, 6) as score, label::varchar as doc_id, (id % 7)::int as chunk_id from h")
sql(
    "domain_by_model",
    """with d as (select doc_id, case when doc_id % 11 = 0 then ' ' else text || ' the market plot' end as text from documents),
    k as (select unnest([0, 1, 2, 3]) as k, unnest(['finance', 'hardware', 'engineering', 'fiction']) as domain,
      unnest([['trading', 'strategy', 'alpha', 'quant', 'portfolio', 'risk', 'market', 'stock', 'bond', 'derivative'], ['server', 'ic', 'latency', 'fpga', 'network', 'cpu', 'gpu', 'memory', 'cache'],
              ['architecture', 'system', 'design', 'pattern', 'algorithm', 'optimization'], ['character', 'plot', 'story', 'narrative', 'chapter', 'scene']]) as words),
    h as (select doc_id, domain, len(list_filter(words, lambda w: contains(lower(text), w))) as n, len(words) as t, k from d, k),
    b as (select doc_id, arg_max(struct_pack(domain := domain, n := n, t := t), n * 10 - k) as b from h group by doc_id)
    select doc_id, case when doc_id % 11 = 0 then 'general' when doc_id % 9 = 0 then 'law' when doc_id % 9 = 3 then 'general' when doc_id % 9 = 6 then 'fiction' else b.domain end as domain,
           case when doc_id % 11 = 0 then 0.0 when doc_id % 3 = 0 then 0.8 else format('{:.2f}', b.n / b.t)::double end as confidence from b""",
)
sql(
    "upload_pieces",
    """with f as (select page_id // 50 as file, 4 + sum(octet_length(encode(coalesce(html, '')))) as n from pages where page_id is not null group by 1),
    s as (select file, n, case when file % 3 = 0 then 400 when n > 400000 then 413 else 200 end as status from f)
    select file, status::int as status, case when status = 200 then n end::bigint as bytes, case when status = 200 then ceil(n / 4096) end::bigint as pieces from s""",
)
sql(
    "expand_compat",
    """with @star@, steps as (select src as id, dst as nxt, type || ':outgoing' as step from star union all select dst, src, type || ':incoming' from star),
    one as (select nxt as id, min(step) as chain from steps where id in ('nation:3', 'region:1') and nxt not in ('nation:3', 'region:1') group by 1),
    two as (select nxt as id, min(chain || '>' || regexp_replace(step, ':outgoing$', ':incoming')) as chain from steps join one using (id) where nxt not in ('nation:3', 'region:1') and nxt not in (select id from one) group by 1)
    select id, 1 as hops, chain from one union all select id, 2, chain from two""",
)
sql("related_before", "with docs as (select item_id as doc_id, text as content from benchmark), @terms@, held as (select distinct doc_id, term from mentions) select a.doc_id as src, b.doc_id as dst, a.term as via_term from held a join held b using (term) where a.doc_id < b.doc_id")
sql(
    "keyword_fields",
    """with m as (select w, n_nationkey as doc_id, n_name as title, count(distinct c_custkey) as c from customer join nation on c_nationkey = n_nationkey, (select unnest(['000001', 'build', 'nation_1']) as w)
      where contains(lower(c_mktsegment), w) or contains(lower(c_name), w) or contains(lower(n_name), w) group by w, n_nationkey, n_name qualify row_number() over (partition by w order by count(distinct c_custkey) desc, n_nationkey) <= 10)
    select doc_id::bigint as doc_id, title, sum(c)::bigint as related_count from m group by all order by related_count desc, doc_id limit 10""",
)
sql("stage_resume", "select o_orderkey % 10 as x, count(*) as n, 2 * max(o_orderkey) as most from orders group by 1")
sql("entity_extraction", "select item_id as key, length(text) % 2 = 0 as answered, case when length(text) % 2 = 0 then 'c' || length(text) else '' end as names from benchmark")
sql(
    "folder_conversion",
    """with f as (select page_id, trim(case when page_id % 3 = 1 then 'from pub: ' else '' end || coalesce(html, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t
      from pages where page_id % 3 < 2 and page_id % 5 <> 0)
    select page_id, length(t) as n, md5(t) as digest from f where t <> ''""",
)
sql("instruction_dataset", "select 'Summarise the document.' as instruction, '' as input, md5(text) as digest, count(*) as n from documents where doc_id % 7 <> 0 group by text")
sql(
    "stored_documents",
    """with o as (select doc_id as id, text from documents where doc_id % 4 <> 0 and text <> ''), n as (select doc_id as id from documents union all select -1 - doc_id from documents)
    select id, o.id is not null as matched, length(text) as n_chars, length(text) - length(replace(text, ' ', '')) as n_spaces from n left join o using (id)""",
)
sql("classify_both", f"select doc_id, d.domain, l.language, d.confidence as domain_confidence, l.confidence as language_confidence from ({ORACLE_SQL['detect_domain']}) d join ({ORACLE_SQL['detect_language']}) l using (doc_id)")
