"""DuckDB SQL for the contract queries (the correctness oracle).

Each query is the SQL form of the matching Spark query in
``gacetilla.plans.contract``; both read the same parquet tables
(``documents``, ``pages``, ``labels`` views).  The CTEs below mirror the test
views of ``gacetilla.sources.testdata`` and the operators, rule for rule.
"""

from __future__ import annotations

from ..functions.text import WS_ONE, WS_RUN
from ..sources.lexicon import BUILTIN_ROOTS
from ..sources.testdata import (BASE_EPOCH, CONTRACT_EXTRA_ROOTS, CONTRACT_NOW, NESTED, STEP_SECONDS,
                                TEST_CHANNELS)
from ..operators import content as C
from ..operators.similarity import DICE_THRESHOLD
from ..operators.summary import SENTENCE_PATTERN, TOKEN_BUDGET
from ..sources.feeds import URL_PATTERN
from ..sources.testdata import OTHER_PAGE_CHANNEL

TH = repr(float(DICE_THRESHOLD))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _channel_case(id_col: str, other: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(TEST_CHANNELS))
    return f"CASE {id_col} % 5 {whens} ELSE {other} END"


def _lexicon_values() -> str:
    words = list(BUILTIN_ROOTS) + list(CONTRACT_EXTRA_ROOTS)
    return "SELECT DISTINCT root FROM (VALUES " + ", ".join(f"({_q(w)})" for w in words) + ") AS lex(root)"


def _split_ws(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{WS_RUN}'), lambda x: x <> '')"


RAW_ITEMS = f"""
raw_items AS (
  SELECT doc_id AS item_id,
    {_channel_case('doc_id', 'source')} AS channel,
    split_part(text, chr(10), 1) AS title,
    'https://example.org/doc/' || CAST(doc_id AS VARCHAR) AS link,
    CASE WHEN contains(text, chr(10)) THEN substr(text, length(split_part(text, chr(10), 1)) + 2) END AS description,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Redacción ' || source END AS creators,
    strftime(make_timestamp(CAST(({BASE_EPOCH} + doc_id * {STEP_SECONDS}) * 1000000 AS BIGINT)),
             '%a, %d %b %Y %H:%M:%S') || ' +0000' AS pub_date,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lower(upper(lang) || ',' || 'Sección ' || source) END AS categories,
    CASE WHEN doc_id % 11 = 0 THEN NULL
         ELSE lower(array_to_string(list_slice({_split_ws('text')}, 1, 3), ', ')) END AS keywords,
    text
  FROM documents
)"""

# metadata-only items (after the required-field filter)
ITEMS = RAW_ITEMS + """,
items AS (
  SELECT item_id, channel, title, link, description, creators, pub_date, categories, keywords
  FROM raw_items WHERE title <> '' AND link <> '' AND description <> ''
)"""

# items with content filled in, every 13th one carrying NoContent
FILLED = ITEMS + """,
filled AS (
  SELECT i.*, CASE WHEN i.item_id % 13 = 0 THEN NULL ELSE r.text END AS clean_content,
         CASE WHEN i.item_id % 13 = 0 THEN 'NoContent' END AS error_kind
  FROM items i JOIN raw_items r USING (item_id)
)"""


def occurrences(src: str, with_content: bool = True, name: str = "occ") -> str:
    content = f"""
  UNION ALL SELECT item_id, 'content' AS field, unnest({_split_ws('clean_content')}) AS token
    FROM {src} WHERE error_kind IS NULL AND clean_content IS NOT NULL""" if with_content else ""
    return f"""
{name} AS (
  SELECT item_id, 'categories' AS field, unnest(string_split(categories, ',')) AS token
    FROM {src} WHERE error_kind IS NULL AND categories IS NOT NULL
  UNION ALL SELECT item_id, 'keywords' AS field, unnest(string_split(keywords, ',')) AS token
    FROM {src} WHERE error_kind IS NULL AND keywords IS NOT NULL
  UNION ALL SELECT item_id, 'title' AS field, unnest({_split_ws('title')}) AS token
    FROM {src} WHERE error_kind IS NULL AND title IS NOT NULL
  UNION ALL SELECT item_id, 'description' AS field, unnest({_split_ws('description')}) AS token
    FROM {src} WHERE error_kind IS NULL AND description IS NOT NULL{content}
)"""


def _grams(name: str, word: str, src: str) -> str:
    return f"""
{name}_n AS (
  SELECT {word}, regexp_replace({word}, '{WS_ONE}', '', 'g') AS n FROM {src}
),
{name}_b AS (
  SELECT {word}, n, strlen(n) AS ul, length(n) AS cl, length(n) = 1 AS single
  FROM {name}_n WHERE length(n) >= 1
),
{name}_g AS (
  SELECT {word}, n, ul, cl, single, substr(n, i, 2) AS g, count(*) AS c
  FROM (SELECT *, unnest(generate_series(1, greatest(cl - 1, 1))) AS i FROM {name}_b)
  GROUP BY ALL
)"""


def dice(occ_src: str = "occ") -> str:
    """CTEs ``pairs`` (token, root, inter, denom, dice) and ``matched`` (token)."""
    return f""",
lexicon AS ({_lexicon_values()}),
toks AS (SELECT DISTINCT token FROM {occ_src} WHERE token IS NOT NULL),
{_grams('t', 'token', 'toks')},
{_grams('r', 'root', 'lexicon')},
joined AS (
  SELECT t.token, r.root, t.n AS t_norm, r.n AS r_norm, t.ul AS t_ul, r.ul AS r_ul, t.single,
         least(t.c, r.c) AS m
  FROM t_g t JOIN r_g r ON t.g = r.g AND t.single = r.single
   AND (t.n = r.n OR (NOT t.single AND 2 * (least(t.cl, r.cl) - 1) >= {TH} * (t.ul + r.ul - 2)))
),
pair_sums AS (
  SELECT token, root, t_norm, r_norm, t_ul, r_ul, single, sum(m) AS inter FROM joined GROUP BY ALL
),
pairs AS (
  SELECT token, root,
         CAST(CASE WHEN single THEN 0 ELSE inter END AS BIGINT) AS inter,
         CAST(t_ul + r_ul - 2 AS BIGINT) AS denom,
         CASE WHEN t_norm = r_norm THEN 1.0::DOUBLE
              WHEN t_ul < 2 OR r_ul < 2 THEN 0.0::DOUBLE
              ELSE CAST(2 * inter AS DOUBLE) / CAST(t_ul + r_ul - 2 AS DOUBLE) END AS dice
  FROM pair_sums
),
matched AS (SELECT DISTINCT token FROM pairs WHERE dice >= {TH})"""


def scores(src: str, with_content: bool = True, occ: str = "occ", prefix: str = "") -> str:
    """CTE ``{prefix}scores`` over an item CTE with item_id, creators, error_kind."""
    def part(field, w):
        return f"CAST(sum(CASE WHEN field = '{field}' THEN {w} ELSE 0 END) AS BIGINT) AS by_{field}"
    return f""",
{prefix}hits AS (
  SELECT item_id, {part('categories', 5)}, {part('keywords', 5)}, {part('title', 10)},
         {part('description', 1)}, {part('content', 1)}
  FROM {occ} WHERE token IN (SELECT token FROM matched) GROUP BY item_id
),
{prefix}parts AS (
  SELECT s.*, s.error_kind IS NOT NULL AS error,
    CAST(CASE WHEN s.error_kind IS NOT NULL THEN 0 WHEN coalesce(s.creators, '') <> '' THEN 10 ELSE 0 END AS BIGINT) AS by_creator,
    CAST(CASE WHEN s.error_kind IS NOT NULL THEN 0 ELSE coalesce(h.by_categories, 0) END AS BIGINT) AS by_categories,
    CAST(CASE WHEN s.error_kind IS NOT NULL THEN 0 ELSE coalesce(h.by_keywords, 0) END AS BIGINT) AS by_keywords,
    CAST(CASE WHEN s.error_kind IS NOT NULL THEN 0 ELSE coalesce(h.by_title, 0) END AS BIGINT) AS by_title,
    CAST(CASE WHEN s.error_kind IS NOT NULL THEN 0 ELSE coalesce(h.by_description, 0) END AS BIGINT) AS by_description,
    CAST(CASE WHEN s.error_kind IS NOT NULL THEN 0 ELSE coalesce(h.by_content, 0) END AS BIGINT) AS relevance_content
  FROM {src} s LEFT JOIN {prefix}hits h USING (item_id)
),
{prefix}scores AS (
  SELECT *, by_creator + by_categories + by_keywords + by_title + by_description AS relevance_core,
         by_creator + by_categories + by_keywords + by_title + by_description + relevance_content AS net_relevance,
         'breakdown [creator: ' || CAST(by_creator AS VARCHAR) || ', categories: ' || CAST(by_categories AS VARCHAR)
           || ', keywords: ' || CAST(by_keywords AS VARCHAR) || ', title: ' || CAST(by_title AS VARCHAR)
           || ', content: ' || CAST(by_description AS VARCHAR) || ']' AS explanation
  FROM {prefix}parts
)"""


def scored_filled() -> str:
    return "WITH " + FILLED + "," + occurrences("filled") + dice() + scores("filled")


ANCHOR = ("'#' || regexp_replace(regexp_replace(lower({t}), '[^a-z0-9]+', '-', 'g'), "
          "'^-+|-+$', '', 'g')")


def contract_sql() -> dict[str, str]:
    from .landed import landed_sql
    s = landed_sql()
    s["q_items_normalised"] = "WITH " + ITEMS + """
SELECT item_id, channel, title, link, description, creators, pub_date, categories, keywords FROM items"""

    s["q_rejected_items"] = "WITH " + RAW_ITEMS + """
SELECT item_id, channel, CASE WHEN coalesce(title, '') = '' THEN 'No title' WHEN coalesce(link, '') = '' THEN 'No link'
       ELSE 'No description' END AS reason
FROM raw_items WHERE coalesce(title, '') = '' OR coalesce(link, '') = '' OR coalesce(description, '') = ''"""

    s["q_channel_type"] = "WITH " + ITEMS + """
SELECT item_id, channel,
  CASE WHEN contains(upper(channel), 'EL PAÍS') THEN 'ElPais'
       WHEN contains(upper(channel), '20MINUTOS') THEN 'VeinteMinutos'
       WHEN contains(upper(channel), 'ELDIARIO.ES') THEN 'ElDiario'
       WHEN contains(upper(channel), 'ELMUNDO') THEN 'ElMundo' ELSE 'Other' END AS channel_type
FROM items"""

    def opt_in(terms, op):
        conds = [f"(contains(coalesce(categories, ''), {_q(t)}) OR contains(coalesce(keywords, ''), {_q(t)}))"
                 for t in terms]
        where = f" {op} ".join(conds) if conds else "TRUE"
        return "WITH " + ITEMS + f"\nSELECT item_id, link FROM items WHERE {where}"
    s["q_opt_in_or"] = opt_in(OPT_IN_OR, "OR")
    s["q_opt_in_and"] = opt_in(OPT_IN_AND, "AND")
    s["q_opt_in_empty"] = opt_in([], "OR")

    base = "WITH " + FILLED + "," + occurrences("filled") + dice()
    s["q_dice_pairs"] = base + "\nSELECT token, root, inter, denom, dice FROM pairs WHERE dice >= " + TH
    s["q_fuzzy_tokens"] = base + """
SELECT token, CAST(count(*) AS BIGINT) AS occurrences FROM occ WHERE token IN (SELECT token FROM matched)
GROUP BY token"""

    # words share one of their rarest bigrams, as many as the score leaves room for; what stands
    # behind the first shared one, and 64 bits of both sets, leave few pairs to be made distinct
    s["q_similar_words"] = f"""
WITH w0 AS (SELECT DISTINCT token FROM (SELECT unnest({_split_ws('text')}) AS token FROM documents)),
w AS (SELECT token, strlen(token) AS ul, length(token) - 1 AS n FROM w0 WHERE length(token) > 1),
g AS (SELECT token, ul, n, substr(token, i, 2) AS g, count(*) AS times
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM w) GROUP BY ALL),
held AS (SELECT g, count(*) AS held FROM g GROUP BY g),
e AS (SELECT token, ul, n, g || CASE WHEN k = 0 THEN '' ELSE '#' || k END AS e, held
      FROM (SELECT *, unnest(range(times)) AS k FROM g) JOIN held USING (g)),
o AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY held, e) AS pos FROM e),
bits AS (SELECT token, bit_or(CAST(1 AS UBIGINT) << CAST(hash(e) % 64 AS INTEGER)) AS bits FROM e GROUP BY token),
pre AS (SELECT * FROM o JOIN bits USING (token) WHERE pos <= n - greatest(ceil({SIMILAR_WORDS} / (2 - {SIMILAR_WORDS}) * (ul - 1) - 1e-9), 1) + 1),
cand AS (SELECT DISTINCT a.token, b.token AS root, a.ul + b.ul - 2 AS denom FROM pre a JOIN pre b USING (e)
         WHERE a.token <> b.token AND 2 * least(a.n, b.n) >= {SIMILAR_WORDS} * (a.ul + b.ul - 2)
           AND 2 * (1 + least(a.n - a.pos, b.n - b.pos)) >= {SIMILAR_WORDS} * (a.ul + b.ul - 2) - 1e-9
           AND bit_count(xor(a.bits, b.bits)) <= a.n + b.n - {SIMILAR_WORDS} * (a.ul + b.ul - 2) + 1e-9),
pairs AS (SELECT c.token, c.root, CAST(2 * count(*) AS DOUBLE) / c.denom AS dice
          FROM cand c JOIN e a ON a.token = c.token JOIN e b ON b.token = c.root AND b.e = a.e GROUP BY c.token, c.root, c.denom)
SELECT token, count(*) AS similar, max(dice) AS closest FROM pairs WHERE dice >= {SIMILAR_WORDS} GROUP BY token"""

    sc = scored_filled()
    s["q_score_breakdown"] = sc + """
SELECT item_id, error, by_creator, by_categories, by_keywords, by_title, by_description,
  relevance_core, relevance_content, net_relevance, explanation,
  'Relevance[core: ' || CAST(relevance_core AS VARCHAR) || ', content: ' || CAST(relevance_content AS VARCHAR)
    || ', explanation: ''' || explanation || ''']' AS score_text
FROM scores"""

    s["q_top_k"] = sc + f"""
SELECT CAST(row_number() OVER (ORDER BY net_relevance DESC, link, item_id) AS BIGINT) AS rank,
       item_id, link, net_relevance AS relevance
FROM scores ORDER BY net_relevance DESC, link, item_id LIMIT {TOP_K}"""

    s["q_top_k_composite"] = sc + f"""
SELECT CAST(row_number() OVER (ORDER BY error DESC, relevance_core DESC, relevance_content DESC, link, item_id) AS BIGINT) AS rank,
       item_id, link
FROM scores ORDER BY error DESC, relevance_core DESC, relevance_content DESC, link, item_id LIMIT {TOP_K}"""

    s["q_relevance_by_channel"] = sc + """
SELECT channel, CAST(count(*) AS BIGINT) AS items, CAST(sum(net_relevance) AS DOUBLE) AS total,
       CAST(sum(net_relevance) AS DOUBLE) / count(*) AS average
FROM scores GROUP BY channel"""

    s["q_relevance_list"] = sc + """
SELECT CAST(row_number() OVER (ORDER BY net_relevance DESC, link, item_id) - 1 AS BIGINT) AS ord,
       item_id, net_relevance AS relevance, channel, title
FROM scores"""

    s["q_contents_list"] = sc + f"""
, top AS (SELECT * FROM scores ORDER BY net_relevance DESC, link, item_id LIMIT {TOP_K})
SELECT CAST(row_number() OVER (ORDER BY net_relevance DESC, link, item_id) AS BIGINT) AS ord,
       title, {ANCHOR.format(t='title')} AS anchor
FROM top"""
    s.update(more_sql())
    return s


def _page_channel(id_col: str) -> str:
    return _channel_case(id_col, _q(OTHER_PAGE_CHANNEL))


def _outlet(col: str) -> str:
    return (f"CASE WHEN contains(upper({col}), 'EL PAÍS') THEN 'ElPais' "
            f"WHEN contains(upper({col}), '20MINUTOS') THEN 'VeinteMinutos' "
            f"WHEN contains(upper({col}), 'ELDIARIO.ES') THEN 'ElDiario' "
            f"WHEN contains(upper({col}), 'ELMUNDO') THEN 'ElMundo' ELSE 'Other' END")


def _steps(x: str, steps) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, {_q(C.sql_pattern(pattern))}, {_q(by)}, 'g')"
    return x


def _matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(C.sql_pattern(pattern))})"


def _decoded(x: str) -> str:
    """Text with its references decoded, part by part."""
    named = "MAP {" + ", ".join(f"{_q(n)}: {_q(c)}" for n, c in C.REFERENCES.items()) + "}"
    hexed = "lower(r[3:3]) = 'x'"
    code = f"CASE WHEN {hexed} THEN CAST('0x' || r[4:-2] AS BIGINT) ELSE CAST(r[3:-2] AS BIGINT) END"
    special = " ".join(f"WHEN {n} THEN {_q(c)}" for n, c in C.NUMBERED.items())
    number = (f"CASE {code} {special} ELSE CASE WHEN {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 "
              f"THEN chr(65533) ELSE chr(CAST({code} AS INTEGER)) END END")
    char = f"CASE WHEN r IS NULL THEN '' WHEN r[2:2] = '#' THEN {number} ELSE coalesce({named}[r[2:-2]], r) END"
    chars = f"list_transform(regexp_extract_all({x}, {_q(C.REFERENCE)}), lambda r: {char})"
    return (f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(list_zip("
            f"string_split_regex({x}, {_q(C.REFERENCE)}), {chars}), lambda z: z[1] || coalesce(z[2], '')), '') ELSE {x} END")


def _page_region(pages: str = "pages") -> str:
    """CTEs up to ``page_region`` (page_id, channel_type, region, error_kind,
    clean_content): the tag table, its windows and the outlets' rules."""
    marks = {"bold": (C.BOLD, C.BOLD_END), "em": (C.EM, C.EM_END)}
    kinds = sorted(set(C.KINDS.values()))
    step = {k: f"CASE WHEN kind = '{k}' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END" for k in kinds} | {
        k: f"length(replace(body, {_q(e)}, '')) - length(replace(body, {_q(o)}, ''))" for k, (o, e) in marks.items()}
    upto, before = "ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    over = lambda frame: f"OVER (PARTITION BY page_id ORDER BY pos {frame})"
    sums = ", ".join([f"sum({x}) {over(upto)} AS s_{k}" for k, x in step.items()]
                     + [f"coalesce(sum({step[k]}) {over(before)}, 0) AS p_{k}" for k in marks])
    lows = ", ".join([f"least(0, min(s_{k}) {over(upto)}) AS l_{k}" for k in step]
                     + [f"least(0, coalesce(min(s_{k}) {over(before)}, 0)) AS q_{k}" for k in marks])
    kind = "CASE name " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in C.KINDS.items()) + " END"
    level = "CASE grp " + " ".join(f"WHEN '{k}' THEN s_{k} - l_{k}" for k in kinds) + " END"
    flags = ", ".join(f"p_{k} - q_{k} > 0 AS {k}_before, s_{k} - l_{k} > 0 AS {k}_after" for k in marks)
    emphasised = _steps("(CASE WHEN em_before THEN {} ELSE '' END || CASE WHEN bold_before THEN {} ELSE '' END || body || "
                        "CASE WHEN bold_after THEN {} ELSE '' END || CASE WHEN em_after THEN {} ELSE '' END)".format(
                            *map(_q, (C.EM, C.BOLD, C.BOLD_END, C.EM_END))), C.EMPHASIS)
    sign = (f"CASE WHEN name = 'li' AND NOT closing THEN {_q(C.LINE)} || coalesce(CAST(number AS VARCHAR) || '. ', '* ') "
            f"WHEN name = 'li' THEN {_q(C.LINE)} "
            f"WHEN regexp_matches(name, '^h[1-6]$') AND NOT closing THEN {_q(C.BLOCK)} || repeat('#', CAST(name[2:2] AS INTEGER)) || ' ' "
            f"WHEN regexp_matches(name, {_q('^(' + C.BLOCK_TAGS + ')$')}) THEN {_q(C.BLOCK)} ELSE '' END")
    short = "trim(regexp_replace(l, ' +', ' ', 'g'), ' ')"
    line = (f"CASE WHEN length(l) <= {C.WRAP_WIDTH} THEN {short} ELSE regexp_replace(regexp_replace({short}, "
            f"'(.{{1,{C.WRAP_WIDTH}}})( |$)', '\\1' || chr(10), 'g'), chr(10) || '$', '') END")
    block = (f"array_to_string(list_filter(list_transform(string_split(b, chr(6)), lambda l: {line}), "
             f"lambda l: l <> ''), chr(10))")
    return f"""
pg0 AS (SELECT page_id, html, {_outlet('channel')} AS channel_type, {_steps("coalesce(html, '')", C.PREPARE)} AS doc
        FROM (SELECT *, {_page_channel('page_id')} AS channel FROM {pages})),
pg1 AS (SELECT page_id, string_split({_steps('doc', [C.SEGMENT])}, chr(1)) AS segs FROM pg0),
pg2 AS (SELECT page_id, unnest(segs) AS seg, unnest(range(len(segs))) AS pos FROM pg1),
pg3 AS (SELECT page_id, pos, lower(regexp_extract(seg, {_q(C.NAME)}, 1)) AS name, starts_with(seg, '</') AS closing,
          {_matches('seg', C.MARKED)} AS marked, {_matches('seg', C.CLASSED)} AS classed,
          TRY_CAST(regexp_extract(seg, {_q(C.START)}, 1) AS BIGINT) AS start, {_steps('seg', C.INLINE)} AS body FROM pg2),
pg4 AS (SELECT *, {kind} AS kind FROM pg3),
pg5 AS (SELECT *, {sums} FROM pg4),
pg6 AS (SELECT *, CASE WHEN name = 'li' THEN 'list' ELSE kind END AS grp, {lows} FROM pg5),
pg7 AS (SELECT *, {level} + CASE WHEN closing AND name <> 'li' THEN 1 ELSE 0 END AS level, {flags} FROM pg6),
pg8 AS (SELECT *, lead(pos) OVER peers AS ends,
          sum(CASE WHEN grp = 'list' AND name <> 'li' AND NOT closing THEN 1 ELSE 0 END) OVER peers AS nth
        FROM pg7 WINDOW peers AS (PARTITION BY page_id, grp, level ORDER BY pos)),
pg9 AS (SELECT *, CASE WHEN name = 'li' AND NOT closing AND first(name) OVER items = 'ol' THEN
          CAST(sum(CASE WHEN name = 'li' AND NOT closing THEN 1 ELSE 0 END) OVER items
               + coalesce(first(start) OVER items, 1) - 1 AS BIGINT) END AS number
        FROM pg8 WINDOW items AS (PARTITION BY page_id, grp, level, nth ORDER BY pos ROWS UNBOUNDED PRECEDING)),
em AS (SELECT *, {emphasised} AS y FROM pg9),
seg AS (SELECT page_id, pos, name = 'p' AND NOT closing AS paragraph, classed, marked, name, closing,
          coalesce(ends, 2147483647) AS ends, {sign} || CASE WHEN {_matches('body', C.SOLID)} THEN {_decoded('y')} ELSE '' END AS txt FROM em),
art AS (SELECT page_id, min(pos) AS a0, arg_min(ends, pos) AS a1 FROM seg WHERE name = 'article' AND NOT closing GROUP BY page_id),
mai AS (SELECT page_id, min(pos) AS m0, arg_min(ends, pos) AS m1 FROM seg WHERE name = 'main' AND NOT closing GROUP BY page_id),
rg AS (SELECT page_id, html, channel_type, a0, a1, m0, m1, CASE WHEN html IS NULL OR html = '' THEN 'none'
    WHEN channel_type = 'ElPais' THEN CASE WHEN a0 IS NULL THEN 'none' ELSE 'article-region' END
    WHEN channel_type = 'VeinteMinutos' THEN CASE WHEN a0 IS NULL THEN 'none' ELSE 'article-p' END
    WHEN channel_type = 'ElDiario' AND m0 IS NOT NULL THEN 'main-p'
    WHEN channel_type = 'ElMundo' AND a0 IS NOT NULL THEN 'article-p' ELSE 'body' END AS region
  FROM pg0 LEFT JOIN art USING (page_id) LEFT JOIN mai USING (page_id)),
taken AS (
  SELECT page_id, 0 AS k, pos, txt FROM rg JOIN seg USING (page_id)
    WHERE CASE region WHEN 'article-p' THEN paragraph AND pos > a0 AND pos < a1
          WHEN 'main-p' THEN classed AND pos > m0 AND pos < m1 WHEN 'body' THEN TRUE ELSE FALSE END
  UNION ALL SELECT page_id, m.pos, p.pos, p.txt FROM rg JOIN seg m USING (page_id) JOIN seg p USING (page_id)
    WHERE region = 'article-region' AND m.marked AND m.pos > a0 AND m.pos < a1 AND p.paragraph AND p.pos > m.pos AND p.pos < m.ends),
whole AS (SELECT page_id, string_agg(txt, '' ORDER BY k, pos) AS x FROM taken GROUP BY page_id),
blk AS (SELECT page_id, list_filter(list_transform(string_split({_steps('x', [C.JOINED])}, chr(1)), lambda b: {block}), lambda b: b <> '') AS b FROM whole),
page_region AS (SELECT page_id, channel_type, region,
    CASE WHEN html IS NULL OR html = '' THEN NULL WHEN coalesce(len(b), 0) = 0 THEN ''
         ELSE array_to_string(b, chr(10) || chr(10)) || chr(10) END AS clean_content,
    CASE WHEN html IS NULL THEN 'ParsingError' WHEN html = '' THEN 'EmptyString'
         WHEN coalesce(len(b), 0) = 0 THEN 'NoContent' END AS error_kind FROM rg LEFT JOIN blk USING (page_id))"""


def _nested_pages() -> str:
    """CTE ``nested``: every page inside containers of its own kind, see ``nested_pages``."""
    before, after = (f"replace({_q(x)}, '@', CAST(page_id AS VARCHAR))" for x in NESTED)
    return f"nested AS (SELECT page_id, {before} || html || {after} AS html FROM pages)"


def _num(x: str) -> str:
    return (f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


def _esc(x: str) -> str:
    """SQL form of ``debug_escape``."""
    out = x
    for raw, escaped in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"),
                         ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        out = f"replace({out}, {raw}, {escaped})"
    return out


def _dbg(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'None' ELSE 'Some(\"' || {_esc(x)} || '\")' END"


def _err_dbg(kind: str, msg: str) -> str:
    return (f"CASE WHEN {kind} IS NULL THEN 'None' "
            f"WHEN {kind} IN ('ParsingError', 'NetworkError') THEN 'Some(' || {kind} || '(\"' || "
            f"{_esc(f'coalesce({msg}, {chr(39)}{chr(39)})')} || '\"))' "
            f"ELSE 'Some(' || {kind} || ')' END")


def p1_scores_sql() -> str:
    """CTEs down to ``p1_scores``: every item scored on its metadata."""
    return ("WITH " + ITEMS + """,
allsrc AS (
  SELECT i.*, r.text AS clean_content, CAST(NULL AS VARCHAR) AS error_kind
  FROM items i JOIN raw_items r USING (item_id)
),""" + occurrences("allsrc") + dice() + """,
p1src AS (SELECT *, CAST(NULL AS VARCHAR) AS clean_content, CAST(NULL AS VARCHAR) AS error_kind FROM items),"""
            + occurrences("p1src", name="p1occ") + scores("p1src", occ="p1occ", prefix="p1_"))


def _two_phase_sql() -> str:
    """CTEs down to ``p2_scores`` (phase 2) and ``p2src`` (phase-1 top, filled)."""
    return (p1_scores_sql() + f""",
top1 AS (SELECT * FROM p1_scores ORDER BY net_relevance DESC, link, item_id LIMIT {FIRST_K}),
store AS (SELECT 'https://example.org/doc/' || CAST(doc_id AS VARCHAR) AS url, text AS body FROM documents),
p2src AS (
  SELECT t.item_id, t.channel, t.title, t.link, t.description, t.creators, t.pub_date, t.categories,
         t.keywords, t.net_relevance AS relevance,
         CASE WHEN s.url IS NULL OR s.body IS NULL OR s.body = '' THEN NULL ELSE s.body END AS clean_content,
         CASE WHEN s.url IS NULL THEN 'NetworkError' WHEN s.body IS NULL THEN 'ParsingError'
              WHEN s.body = '' THEN 'EmptyString' END AS error_kind,
         CASE WHEN s.url IS NULL THEN 'no landed page for ' || t.link
              WHEN s.body IS NULL THEN 'page body could not be decoded' END AS error_message
  FROM top1 t LEFT JOIN store s ON s.url = t.link
),""" + occurrences("p2src", name="p2occ") + scores("p2src", occ="p2occ", prefix="p2_") + f""",
top2 AS (
  SELECT *, CAST(row_number() OVER (ORDER BY net_relevance DESC, link, item_id) AS BIGINT) AS rank
  FROM p2_scores ORDER BY net_relevance DESC, link, item_id LIMIT {TOP_K}
)""")


def more_sql() -> dict[str, str]:
    s = {}
    s["q_feed_lines"] = f"""
WITH lines AS (
  SELECT url AS line FROM pages
  UNION ALL SELECT unnest(string_split(text, chr(10))) AS line FROM documents
)
SELECT line, CAST(count(*) AS BIGINT) AS copies FROM lines
WHERE line <> '' AND NOT starts_with(line, '#') AND regexp_matches(line, {_q(URL_PATTERN)})
GROUP BY line"""

    s["q_rss_scan"] = contract_items_sql()

    s["q_union_feeds"] = "WITH " + ITEMS + f"""
SELECT 'doc:' || CAST(item_id AS VARCHAR) AS item_id, channel, title, link, description, creators,
       pub_date, categories, keywords FROM items
UNION ALL
SELECT 'page:' || CAST(page_id AS VARCHAR) AS item_id, {_page_channel('page_id')} AS channel,
       regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS link, 'Landed page' AS description,
       '' AS creators, CAST(NULL AS VARCHAR) AS pub_date, CAST(NULL AS VARCHAR) AS categories,
       CAST(NULL AS VARCHAR) AS keywords
FROM pages"""

    s["q_clean_region"] = "WITH " + _page_region() + """
SELECT page_id, channel_type, region, error_kind FROM page_region"""

    s["q_clean_text"] = "WITH " + _page_region() + """
SELECT page_id, clean_content, CASE WHEN error_kind <> 'NoContent' THEN error_kind END AS error_kind FROM page_region"""

    s["q_clean_nested"] = "WITH " + _nested_pages() + "," + _page_region("nested") + """
SELECT page_id, region, clean_content, CASE WHEN error_kind <> 'NoContent' THEN error_kind END AS error_kind FROM page_region"""

    s["q_fill_content"] = "WITH " + ITEMS + "," + _page_region() + """
SELECT 'page:' || CAST(page_id AS VARCHAR) AS item_id, error_kind, error_kind AS error_text,
       CASE WHEN error_kind IS NULL THEN clean_content END AS clean_content
FROM page_region
UNION ALL
SELECT 'doc:' || CAST(item_id AS VARCHAR) AS item_id, 'NetworkError' AS error_kind,
       'NetworkError(no landed page for ' || link || ')' AS error_text, CAST(NULL AS VARCHAR) AS clean_content
FROM items"""

    tp = _two_phase_sql()
    s["q_two_phase"] = tp + "\nSELECT rank, item_id, link, net_relevance AS relevance FROM top2"

    ca = "WITH " + ITEMS + """,
ca AS (SELECT i.item_id, 'https://example.org/' || md5(r.text) AS link FROM items i JOIN raw_items r USING (item_id)),
firsts AS (SELECT link, min(item_id) AS item_id FROM ca GROUP BY link)"""
    s["q_dedup_link"] = ca + "\nSELECT link, item_id FROM firsts"
    s["q_insert_new"] = ca + """,
existing AS (SELECT DISTINCT 'https://example.org/' || md5(text) AS link FROM documents
             WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT item_id, link FROM firsts WHERE link NOT IN (SELECT link FROM existing)"""

    s["q_insert_batches"] = "WITH " + ITEMS + """,
ca AS (SELECT i.item_id, i.title, 'https://example.org/' || md5(r.text) AS link FROM items i JOIN raw_items r USING (item_id)),
firsts AS (SELECT link, min(item_id % 3) AS n, arg_min(title, (item_id % 3) * 1000000000000 + item_id) AS title FROM ca GROUP BY link)
SELECT 'id-third-' || n AS batch, link, title, count(*) OVER (PARTITION BY n) AS reported FROM firsts"""

    s["q_page_store"] = "WITH " + _page_region() + """
SELECT 'page:' || p.page_id AS item_id, url AS link, error_kind AS error_text,
       CASE WHEN error_kind IS NULL THEN clean_content END AS clean_content
FROM page_region r JOIN pages p USING (page_id) WHERE p.page_id % 10 = 0
UNION ALL SELECT 'no-page:' || page_id, url || '#none', 'NetworkError(no landed page for ' || url || '#none)', NULL
FROM pages WHERE page_id % 10 = 0"""

    s["q_store_round_trip"] = "WITH " + FILLED + """
SELECT channel, title, link, description, creators, pub_date, categories, keywords, clean_content,
       error_kind, CAST(NULL AS VARCHAR) AS error_message
FROM filled"""

    fb = "WITH " + ITEMS + f""",
first_items AS (SELECT * FROM items ORDER BY item_id LIMIT {FEEDBACK_N}),
ratings AS (
  SELECT 'https://example.org/doc/' || CAST(doc_id AS VARCHAR) AS link,
         CAST((doc_id + 2 * quality + 3 * toxic) % 7 AS VARCHAR) AS rating
  FROM labels
),
valid AS (
  SELECT link, min(CAST(trim(rating) AS BIGINT)) AS r FROM ratings
  WHERE regexp_matches(trim(rating), '^[+]?[0-9]+$') AND CAST(trim(rating) AS BIGINT) BETWEEN 1 AND 5
  GROUP BY link
),
fb AS (
  SELECT f.*, v.r AS relevance,
    CAST(trunc((epoch(TIMESTAMP '{CONTRACT_NOW}') - ({BASE_EPOCH} + f.item_id * {STEP_SECONDS})) / 86400.0) AS BIGINT)
      AS days_since_publication
  FROM first_items f JOIN valid v USING (link)
)"""
    s["q_feedback"] = fb + "\nSELECT item_id, link, relevance, days_since_publication FROM fb"
    s["q_csv_round_trip"] = fb + f"""
SELECT channel, title, link, description, creators, coalesce(pub_date, '') AS publication_date,
       coalesce(categories, '') AS categories, coalesce(keywords, '') AS keywords,
       '' AS clean_content, 'None' AS error, {_q(FEEDBACK_DATE)} AS feedback_date,
       CAST(relevance AS VARCHAR) AS relevance
FROM fb"""

    s["q_report_lines"] = scored_filled() + f""",
ch AS (
  SELECT channel, count(*) AS items, CAST(sum(net_relevance) AS DOUBLE) AS total,
         CAST(sum(net_relevance) AS DOUBLE) / count(*) AS average
  FROM scores GROUP BY channel
),
chn AS (SELECT *, row_number() OVER (ORDER BY average DESC, channel) - 1 AS ord FROM ch)
SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, '# Relevance Report' AS line
UNION ALL SELECT 0, 1, ''
UNION ALL SELECT 1, 0, '## Relevance per Channel'
UNION ALL SELECT 1, 1, ''
UNION ALL SELECT 2, ord, '- **' || channel || ':** Items: ' || CAST(items AS VARCHAR) || ' Total: '
  || {_num('total')} || ' Average: ' || {_num('average')} FROM chn
UNION ALL SELECT 3, 0, ''
UNION ALL SELECT 3, 1, '## Relevance list'
UNION ALL SELECT 4, row_number() OVER (ORDER BY net_relevance DESC, link, item_id) - 1,
  CAST(row_number() OVER (ORDER BY net_relevance DESC, link, item_id) - 1 AS VARCHAR) || '. ('
  || CAST(net_relevance AS VARCHAR) || ') [' || channel || '] ' || title FROM scores
UNION ALL SELECT 5, 0, ''"""

    nl = "chr(10)"
    block = (f"'---' || {nl} || '### ' || title || {nl} || {nl} || '#### Data' || {nl} "
             f"|| '- **Channel:** ' || channel || {nl} "
             f"|| '- **Relevance:** ' || CAST(net_relevance AS VARCHAR) || {nl} "
             f"|| '- **Link:** ' || link || {nl} "
             f"|| '- **Publish Date:** ' || {_dbg('pub_date')} || {nl} "
             f"|| '- **Categories:** ' || {_dbg('categories')} || {nl} "
             f"|| '- **Keywords:** ' || {_dbg('keywords')} || {nl} "
             f"|| '- **Error:** ' || {_err_dbg('error_kind', 'error_message')} || {nl} || {nl} "
             f"|| '#### Clean Content ' || {nl} || coalesce(clean_content, 'N/A')")
    s["q_dossier_lines"] = tp.replace(
        "p2_parts AS (\n  SELECT s.*,", "p2_parts AS (\n  SELECT s.*,") + f"""
SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, '# Dossier' AS line
UNION ALL SELECT 0, 1, ''
UNION ALL SELECT 1, 0, '## Table of Contents'
UNION ALL SELECT 2, rank, CAST(rank AS VARCHAR) || '. [' || title || '](' || {ANCHOR.format(t='title')} || ')' FROM top2
UNION ALL SELECT 3, 0, ''
UNION ALL SELECT 3, 1, '## Metadata'
UNION ALL SELECT 4, 1, '- **Number of items:** ' || CAST(count(*) AS VARCHAR) FROM top2
UNION ALL SELECT 5, 0, {_q('- **Date:** ' + RUN_TIME)}
UNION ALL SELECT 5, 1, ''
UNION ALL SELECT 5, 2, '## News Items'
UNION ALL SELECT 6, rank, {block} FROM top2
UNION ALL SELECT 7, 0, ''"""

    log_block = (f"concat_ws({nl}, '---', '# ' || title, '## Data', '- **Channel:** ' || channel, "
                 f"'- **Relevance:** ' || CAST(relevance AS VARCHAR), '- **Link:** ' || link, "
                 f"'- **Publish Date:** ' || {_dbg('pub_date')}, '- **Categories:** ' || {_dbg('categories')}, "
                 f"'- **Keywords:** ' || {_dbg('keywords')}, "
                 f"'- **Error:** ' || {_err_dbg('error_kind', 'error_message')}, "
                 f"'## Description' || {nl} || substr(description, 1, 50), "
                 f"'## Clean Content ' || {nl} || coalesce(clean_content, 'N/A'), '')")
    s["q_item_log_lines"] = tp + f""",
logged AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, link, item_id) AS ord FROM p2src)
SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, '# Table of Contents' AS line
UNION ALL SELECT 1, ord, CAST(ord AS VARCHAR) || '. [' || title || '](' || {ANCHOR.format(t='title')} || ')' FROM logged
UNION ALL SELECT 2, 0, ''
UNION ALL SELECT 3, ord, {log_block} FROM logged"""

    s["q_extractive_summary"] = f"""
WITH sent0 AS (SELECT doc_id, regexp_extract_all(text, {_q(SENTENCE_PATTERN)}) AS arr FROM documents),
sent1 AS (SELECT doc_id, unnest(range(1, len(arr) + 1)) AS pos, unnest(arr) AS raw FROM sent0),
sent AS (SELECT doc_id, pos, trim(raw) AS sentence FROM sent1 WHERE trim(raw) <> ''),
sentn AS (SELECT *, CAST(len({_split_ws('sentence')}) AS BIGINT) AS n_tokens FROM sent),
occ AS (SELECT doc_id, pos, unnest({_split_ws('sentence')}) AS token FROM sent)""" + dice() + f""",
hits AS (SELECT doc_id, pos, count(*) AS hits FROM occ WHERE token IN (SELECT token FROM matched) GROUP BY ALL),
scored AS (SELECT s.*, coalesce(h.hits, 0) AS hits FROM sentn s LEFT JOIN hits h USING (doc_id, pos)),
ranked AS (
  SELECT *, row_number() OVER w AS rnk,
         sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY hits DESC, pos
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY hits DESC, pos)
)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary, CAST(count(*) AS BIGINT) AS n_sentences,
       CAST(sum(n_tokens) AS BIGINT) AS n_tokens
FROM ranked WHERE rnk = 1 OR running <= {TOKEN_BUDGET} GROUP BY doc_id"""
    return s


def contract_items_sql() -> str:
    return "WITH " + ITEMS + """
SELECT item_id, channel, title, link, description, creators, pub_date, categories, keywords FROM items"""


# Parameters shared with the Spark side.
OPT_IN_OR = ["en", "sección src1"]
OPT_IN_AND = ["en", "src1"]
SIMILAR_WORDS = DICE_THRESHOLD
TOP_K = 20
FIRST_K = 100
FEEDBACK_N = 50
FEEDBACK_DATE = "Wed, 01 Jan 2025 00:00:00 +0000"
RUN_TIME = "2025-01-01T00:00:00+00:00"
