"""Parents and children of the markdown books; the SQL does the folds by recursion over sections, parts and units."""

from __future__ import annotations

from spanforge.config import EngineConfig
from spanforge.operators import chunking
from spanforge.plans.markdown_queries import _SECTIONS, _STRIP, book_markdown

_LIMITS = EngineConfig()


def _chunked(spark, sf_dir):
    return chunking.chunk_books(book_markdown(spark, sf_dir))


def chunk_parents(spark, sf_dir):
    """Parents of every book, by the folds."""
    return chunking.parents_of(_chunked(spark, sf_dir))


def chunk_children(spark, sf_dir):
    """Children of every book, by the folds."""
    return chunking.children_table(_chunked(spark, sf_dir))


QUERIES = {f.__name__: f for f in (chunk_parents, chunk_children)}

_FENCE = "regexp_matches({0}, '^\\s*```')"
_GAP = "chr(10) || chr(10)"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def _sentences(text: str) -> str:
    return f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _tail(text: str) -> str:
    """The last two sentences of over 20 characters outside fences."""
    lines = f"string_split({text}, chr(10))"
    fence = _FENCE.format("y")
    prose = f"list_filter({lines}, lambda x, i: NOT {_FENCE.format('x')} AND len(list_filter({lines}[1:i], lambda y: {fence})) % 2 = 0)"
    joined = _STRIP.format(f"array_to_string({prose}, ' ')")
    return f"array_to_string(list_filter({_sentences(joined)}, lambda z: length(z) > 20)[-2:], ' ')"


def _blocks(src: str, name: str, key: str) -> str:
    """(key, b, block) of the texts of ``src``: fenced blocks whole, prose by paragraphs."""
    return f"""{name}_l AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS ln FROM {src}),
{name}_f AS (SELECT *, {_FENCE.format('line')} AS fence, count(*) FILTER ({_FENCE.format('line')}) OVER (PARTITION BY {key} ORDER BY ln) AS c, count(*) FILTER ({_FENCE.format('line')}) OVER (PARTITION BY {key}) AS fences FROM {name}_l),
{name}_s AS (SELECT {key}, CASE WHEN fence AND c % 2 = 0 THEN c - 1 ELSE c END AS seg, max(fences) AS fences, string_agg(line, chr(10) ORDER BY ln) AS t FROM {name}_f GROUP BY {key}, seg),
{name}_u AS (SELECT {key}, seg, CASE WHEN seg % 2 = 1 AND seg < fences THEN [t] ELSE list_filter(string_split({_STRIP.format('t')}, {_GAP}), lambda x: {_STRIP.format('x')} <> '') END AS units FROM {name}_s),
{name}_e AS (SELECT {key}, seg, unnest(units) AS block, unnest(generate_series(1, len(units))) AS i FROM {name}_u WHERE len(units) > 0),
{name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY seg, i) AS b, block FROM {name}_e)"""


def _greedy(src: str, name: str, key: str, at: str, unit: str, weight: str, limit: int) -> str:
    """The units of ``src`` with the pack ``p`` that each falls into, in order of ``at`` (from 1)."""
    on = " AND ".join(f"s.{k} = r.{k}" for k in key.split(", "))
    cols = ", ".join(f"s.{k}" for k in key.split(", "))
    return f"""{name}_w AS (SELECT {key}, {at} AS pos, {unit} AS unit, {weight} AS w FROM {src}),
{name} AS (SELECT {key}, pos, unit, w, 1 AS p, w AS total FROM {name}_w WHERE pos = 1 UNION ALL
  SELECT {cols}, s.pos, s.unit, s.w, CASE WHEN r.total + s.w > {limit} THEN r.p + 1 ELSE r.p END, CASE WHEN r.total + s.w > {limit} THEN s.w ELSE r.total + s.w END FROM {name} r JOIN {name}_w s ON {on} AND s.pos = r.pos + 1)"""


_JOINS = f"r.grows AND r.chapter = s.chapter AND r.total + s.w <= {_LIMITS.parent_max}"

_PARTS = f"""WITH RECURSIVE {_SECTIONS}, sw AS (SELECT *, {_words('text')} AS w FROM sec),
mg AS (SELECT slug, ord, 0 AS g, w AS total, w < {_LIMITS.parent_min} AS grows, chapter FROM sw WHERE ord = 0 UNION ALL
  SELECT s.slug, s.ord, CASE WHEN {_JOINS} THEN r.g ELSE r.g + 1 END, CASE WHEN {_JOINS} THEN r.total + s.w ELSE s.w END, CASE WHEN {_JOINS} THEN r.grows ELSE s.w < {_LIMITS.parent_min} END, s.chapter
  FROM mg r JOIN sw s ON s.slug = r.slug AND s.ord = r.ord + 1),
mo AS (SELECT sec.*, mg.g, min(ord) OVER (PARTITION BY slug, g) AS o FROM sec JOIN mg USING (slug, ord)),
mp AS (SELECT slug, g, string_agg(text, {_GAP} ORDER BY ord) AS text, max(chapter) AS chapter, arg_max(section, ord) FILTER (section <> '' OR ord = o) AS section,
  arg_max(heading_path, ord) FILTER (section <> '' OR ord = o) AS path FROM mo GROUP BY slug, g),
big AS (SELECT * FROM mp WHERE {_words('text')} > {_LIMITS.parent_max}),
hl AS (SELECT slug, g, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS ln FROM big),
hf AS (SELECT *, count(*) FILTER ({_FENCE.format('line')}) OVER (PARTITION BY slug, g ORDER BY ln) % 2 = 1 AS inside FROM hl),
hh AS (SELECT *, CASE WHEN NOT inside AND NOT {_FENCE.format('line')} THEN nullif({_STRIP.format("regexp_extract(line, '^###\\s+(.+)', 1)")}, '') END AS h3 FROM hf),
hk AS (SELECT *, count(h3) OVER (PARTITION BY slug, g ORDER BY ln) AS k FROM hh),
hp AS (SELECT slug, g, k, {_STRIP.format('string_agg(line, chr(10) ORDER BY ln)')} AS text, max(h3) AS title FROM hk GROUP BY slug, g, k),
sub AS (SELECT hp.slug, hp.g, k, hp.text, path || CASE WHEN title IS NULL THEN '' ELSE ' > ' || title END AS path FROM hp JOIN big USING (slug, g) WHERE hp.text <> ''),
over AS (SELECT * FROM sub WHERE {_words('text')} > {_LIMITS.parent_max}),
{_blocks('over', 'ob', 'slug, g, k')}, {_greedy('ob', 'og', 'slug, g, k', 'b', 'block', _words('block'), _LIMITS.parent_max)},
pieces AS (SELECT slug, g, 0 AS k, 0 AS p, text, path FROM mp WHERE {_words('text')} <= {_LIMITS.parent_max} UNION ALL SELECT slug, g, k, 0, text, path FROM sub WHERE {_words('text')} <= {_LIMITS.parent_max}
  UNION ALL SELECT slug, g, k, p, string_agg(unit, {_GAP} ORDER BY pos), any_value(path) || ' (part ' || p || ')' FROM og JOIN over USING (slug, g, k) GROUP BY slug, g, k, p),
parts AS (SELECT pieces.*, chapter, section, row_number() OVER (PARTITION BY slug ORDER BY g, k, p) - 1 AS n FROM pieces JOIN (SELECT slug, g, chapter, section FROM mp) USING (slug, g)),
lapped AS (SELECT slug, n, chapter, section, path, text FROM parts WHERE n = 0 UNION ALL
  SELECT s.slug, s.n, s.chapter, s.section, s.path, CASE WHEN s.chapter <> '' AND s.chapter = r.chapter AND {_tail('r.text')} <> '' THEN {_tail('r.text')} || {_GAP} || s.text ELSE s.text END
  FROM lapped r JOIN parts s ON s.slug = r.slug AND s.n = r.n + 1),
cc AS (SELECT *, CASE WHEN chapter <> '' AND chapter <> coalesce(lag(chapter) OVER (PARTITION BY slug ORDER BY n), '') THEN 1 ELSE 0 END AS c FROM lapped),
parent AS (SELECT slug || '-p' || n AS parent_id, n::INT AS ord, text, slug AS book, slug AS book_title, (sum(c) OVER (PARTITION BY slug ORDER BY n))::BIGINT::VARCHAR AS chapter, chapter AS chapter_title, section, path AS heading_path FROM cc)"""

# a fenced block above the limit would be cut by lines; the books hold none
_CHILDREN = f"""{_PARTS}, {_blocks('parent', 'cb', 'parent_id')},
wide AS (SELECT parent_id, b, unnest({_sentences('block')}) AS s, unnest(generate_series(1, len({_sentences('block')}))) AS i FROM cb WHERE {_words('block')} > {_LIMITS.child_max}),
{_greedy('wide', 'sg', 'parent_id, b', 'i', 's', f"greatest({_words('s')}, 1)", _LIMITS.child_max)},
sp AS (SELECT parent_id, b, p, string_agg(unit, ' ' ORDER BY pos) AS t, max(w) AS w FROM sg GROUP BY parent_id, b, p),
mw AS (SELECT parent_id, b, p, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS ws FROM sp WHERE w > {_LIMITS.child_max}),
mc AS (SELECT parent_id, b, p, unnest(generate_series(0, (len(ws) - 1) // {_LIMITS.child_max})) AS q, ws FROM mw),
un AS (SELECT parent_id, b, 0 AS p, 0 AS q, block AS t FROM cb WHERE {_words('block')} <= {_LIMITS.child_max} UNION ALL SELECT parent_id, b, p, 0, t FROM sp WHERE w <= {_LIMITS.child_max}
  UNION ALL SELECT parent_id, b, p, q, array_to_string(ws[q * {_LIMITS.child_max} + 1 : (q + 1) * {_LIMITS.child_max}], ' ') FROM mc),
uo AS (SELECT parent_id, t, row_number() OVER (PARTITION BY parent_id ORDER BY b, p, q) AS i FROM un),
{_greedy('uo', 'ug', 'parent_id', 'i', 't', _words('t'), _LIMITS.child_max)},
packed AS (SELECT parent_id, p, {_STRIP.format(f'string_agg(unit, {_GAP} ORDER BY pos)')} AS t FROM ug GROUP BY parent_id, p),
kept AS (SELECT parent_id, p, t, CASE WHEN {_FENCE.format('t')} THEN 'code' ELSE 'prose' END AS chunk_type FROM packed WHERE {_words('t')} >= {_LIMITS.child_min}),
every AS (SELECT * FROM kept UNION ALL SELECT parent_id, 0, {_STRIP.format('text')}, 'prose' FROM parent WHERE parent_id NOT IN (SELECT parent_id FROM kept) AND {_STRIP.format('text')} <> ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY p) - 1 AS m FROM every)"""

ORACLE = {
    "chunk_parents": f"{_PARTS} SELECT * FROM parent",
    "chunk_children": f"""{_CHILDREN} SELECT parent_id || '-c' || m AS child_id, parent_id, m::INT AS ord, t AS text, '' AS context_text, chunk_type, book, book_title, chapter, chapter_title, section, heading_path
FROM placed JOIN (SELECT * EXCLUDE (text, ord) FROM parent) USING (parent_id)""",
}
