"""The registered queries as SQL over the same tables, for comparison.

Written with plain windows, correlated lookups and joins, independent of how
the DataFrame operators reach the same result.
"""

from __future__ import annotations

from termindex import rules as r
from termindex.plans import bindings as b


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


IDENT = "[A-Za-z_][A-Za-z0-9_]*"
TILE = "[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+"
NON_ASCII = r"[^\x00-\x7F]"
DQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"?'
SQ = r"'[^'\\]*(?:\\[\s\S][^'\\]*)*'"
LINE = r"//[^\\\n]*(?:\\[\s\S][^\\\n]*)*"
BLOCK = r"/\*[\s\S]*?\*/"
CLIKE = "|".join([DQ, SQ, LINE, BLOCK])
PY = "|".join([r'"{3}[\s\S]*?"{3}', r"'{3}[\s\S]*?'{3}",
               r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'", r"#[^\n]*"])
MARKUP = r'<!--[\s\S]*?-->|"[^"]*"'


def rep(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, 'g')"


def fold(text: str) -> str:
    return rep(text, NON_ASCII, "?")


def found(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, 0)"


def squeezed(text: str) -> str:
    return rep(rep(text, r"\n[ \t\n]+", "\n"), r"([ \t])[ \t]+", r"\1")


def no_includes(text: str) -> str:
    return rep(text, r"\n[ \t]*#[ \t]*include[^\n]*")


def family(column: str) -> str:
    names = ", ".join(lit(x) for x in r.C_FAMILY)
    return f"CASE WHEN lower({column}) IN ({names}) THEN 'c_family' ELSE lower({column}) END"


NL = "chr(10)"
W0 = f"coalesce(nullif(regexp_extract(text, {lit(IDENT)}, 0), ''), 'w0')"
FLAT = rep("text", r'[\n"\\]', " ")



def joined(*pieces: str) -> str:
    """Pieces that start with ``=`` are expressions, all others literal text."""
    return "concat(" + ", ".join(p[1:] if p.startswith("=") else lit(p) for p in pieces) + ")"


C_CODE = joined(
    "int x;\n#include <", "=source", ">\nstruct ", "=" + W0, "; enum ", "=" + W0, "; a.", "=" + W0, " = p->", "=" + W0,
    ";\nf(", "=" + W0, ");  // ", "=" + FLAT, " \\\n cont ", "=" + W0, "\n\n  /* ", "=text", ' */ s = "', "=" + FLAT,
    '\\"";\n#  include "y.h"\n', "=text")
PY_CODE = joined(
    "import os\ndef ", "=" + W0, '(a):\n    """', "=text", '"""\n    return x.', "=" + W0, "  # ", "=" + FLAT,
    "\n    s = '", "=" + FLAT, "\\''\n", "=text")

MAPPED = {ft: lang for lang, ft in r.LANGUAGE_FILETYPE}
ORDER_ROWS = [(ft, order) for ft, order in r.KIND_ORDER.items()]
EQUIV_ROWS = [(ft, a, c) for ft, pairs in r.KIND_EQUIVALENT.items() for a, c in pairs.items()]
RULE_ROWS = [(ft, k, g, p or r.DEFAULT_PREFIX, s or r.DEFAULT_SUFFIX, "", 1 if a is None else a)
             for ft, k, g, p, s, a in r.GROUP_RULES]


def overlaid() -> list[tuple]:
    rows = {(x[0], x[1]): x for x in RULE_ROWS}
    for ft, k, g, p, s, notin, a in b.USER_RULES:
        names = list(notin or [])
        names += [x for x in r.GLOBAL_NOTIN if names and x not in names]
        rows[ft, k] = (ft, k, g, p or r.DEFAULT_PREFIX, s or r.DEFAULT_SUFFIX, ",".join(names),
                       1 if a is None else a)
    return list(rows.values())


RULE_COLUMNS = "filetype, kind, grp, prefix, suffix, notin, allow_keyword"


def usable_cte(name: str, source: str, orders: str = "orders", equiv: str = "equiv") -> str:
    """(filetype, kind, name, file, prio) of the tags each filetype may use."""
    return f"""{name} AS (
      SELECT o.filetype, coalesce(e.kind_to, t.kind) AS kind, t.name, t.file,
             instr(o.ord, coalesce(e.kind_to, t.kind)) - 1 AS prio
      FROM {source} t JOIN {orders} o ON o.fam = {family('t.lang')}
      LEFT JOIN {equiv} e ON e.filetype = o.filetype AND e.kind_from = t.kind
      WHERE instr(o.ord, coalesce(e.kind_to, t.kind)) > 0)"""


def orders_cte(rows) -> str:
    with_family = [(ft, o, MAPPED.get(ft, ft)) for ft, o in rows]
    return f"(SELECT filetype, ord, {family('lang')} AS fam FROM {values(with_family, 'filetype, ord, lang')})"


ANCESTORS = ("list_distinct(list_concat(['/'], list_transform(range(1, len({p}) + 1), "
             "lambda n: '/' || array_to_string({p}[1:n], '/'))))")


def parts(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda q: q <> '')"


# Named subqueries; each may use the ones before it.
CTES: dict[str, str] = {
    "corpus": f"""corpus AS (
      SELECT doc_id, '/' || source || '/' || lang || '/doc' || doc_id || '.' ||
             CASE WHEN doc_id % 3 = 1
                  THEN CASE lang WHEN 'en' THEN 'h' WHEN 'de' THEN 'hpp' WHEN 'fr' THEN 'pyi' ELSE 'mod' END
                  ELSE CASE lang WHEN 'en' THEN 'c' WHEN 'de' THEN 'cpp' WHEN 'fr' THEN 'py' ELSE 'go' END END AS path,
             CASE lang WHEN 'en' THEN 'c' WHEN 'de' THEN 'cpp' WHEN 'fr' THEN 'python' ELSE 'go' END AS filetype,
             CASE lang WHEN 'en' THEN 'C' WHEN 'de' THEN 'C++' WHEN 'fr' THEN 'Python' ELSE 'Go' END AS lang,
             source, text
      FROM documents)""",
    "ccode": f"ccode AS (SELECT doc_id, filetype, path, {fold(C_CODE)} AS text FROM corpus)",
    "pycode": f"pycode AS (SELECT doc_id, filetype, path, {fold(PY_CODE)} AS text FROM corpus)",
    "code": """code AS (
      SELECT c.doc_id, c.filetype, CASE WHEN c.filetype = 'python' THEN p.text ELSE c.text END AS text
      FROM ccode c JOIN pycode p USING (doc_id))""",
    "page": f"""page AS (
      SELECT page_id AS doc_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS filetype,
             {fold('html')} AS text FROM pages)""",
    "cat": f"""cat AS (
      SELECT unnest({found(fold('text'), IDENT)}) AS name, 'bench' || item_id AS file,
             substr('guesmfdtvp', ((item_id // 4) % 10 + 1)::INT, 1) AS kind,
             CASE item_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'c++' WHEN 2 THEN 'Python' ELSE 'Go' END AS lang
      FROM benchmark)""",
    "special": """special AS (
      SELECT * FROM cat UNION ALL
      SELECT name || '.' || kind, file, kind, lang FROM cat WHERE kind IN ('v', 'm'))""",
    "lines": """lines AS (
      SELECT concat_ws(chr(9), name, file, '/^' || name || '$/;"', kind, 'language:' || lang) AS value FROM cat
      UNION ALL SELECT unnest([
        concat_ws(chr(9), '!_TAG_FILE_FORMAT', '2', '/extended format/'),
        concat_ws(chr(9), '!_TAG_ITEM', item_id::VARCHAR, '/x/;"', 'f', 'language:C'),
        '',
        concat_ws(chr(9), 'short' || item_id, 'bench' || item_id),
        concat_ws(chr(9), 'nokind' || item_id, 'bench' || item_id, '/^x$/;"', 'language:C'),
        concat_ws(chr(9), 'tabbed' || item_id, 'bench' || item_id, '/^a', 'b', 'cd$/;"', 'v', 'language:Go', 'line:1')
      ]) FROM benchmark)""",
    "parsed": """parsed AS (
      SELECT f[1] AS name, f[2] AS file, f[3] AS pattern,
             list_filter(f[4:], lambda x: length(x) = 1)[-1] AS kind,
             substr(list_filter(f[4:], lambda x: starts_with(x, 'language:'))[-1], 10) AS lang
      FROM (SELECT string_split(value, chr(9)) AS f FROM lines))""",
    "orders_": f"orders_ AS {orders_cte(ORDER_ROWS)}",
    "prios": """prios AS (
      SELECT filetype, substr(ord, i::INT, 1) AS kind, (i - 1)::INT AS prio
      FROM (SELECT filetype, ord, unnest(range(1, length(ord) + 1)) AS i FROM orders_))""",
    "equiv": f"equiv AS {values(EQUIV_ROWS, 'filetype, kind_from, kind_to')}",
    "rules": f"rules AS {values(RULE_ROWS, RULE_COLUMNS)}",
    "userrules": f"userrules AS {values(overlaid(), RULE_COLUMNS)}",
    "usable": usable_cte("usable", "cat", "orders_"),
    "susable": usable_cte("susable", "special", "orders_"),
    "tok": f"""tok AS (
      SELECT DISTINCT doc_id, filetype, unnest({found(fold('text'), IDENT)}) AS name FROM corpus)""",
    "words": "words AS (SELECT DISTINCT filetype, name FROM tok)",
    "hits": """hits AS (
      SELECT DISTINCT u.filetype, u.kind, u.name, u.prio FROM usable u JOIN words USING (filetype, name))""",
    "best": """best AS (
      SELECT filetype, kind, name, prio FROM (
        SELECT *, row_number() OVER (PARTITION BY filetype, name ORDER BY prio) AS rn FROM hits) WHERE rn = 1)""",
    "grouped": "grouped AS (SELECT b.filetype, b.kind, b.name, r.grp FROM best b JOIN rules r USING (filetype, kind))",
    "ignorednames": """ignorednames AS (
      SELECT DISTINCT ft.filetype, c.name FROM cat c, (VALUES ('c'), ('python')) AS ft(filetype)
      WHERE length(c.name) <= 2)""",
    "restored": """restored AS (
      SELECT DISTINCT g.filetype, g.grp, c.name
      FROM cat c, (VALUES ('c', 'cType'), ('cpp', 'cppType')) AS g(filetype, grp) WHERE length(c.name) = 3)""",
    "log": """log AS (
      SELECT event_id AS seq,
             CASE event_type WHEN 'click' THEN 'add_project' WHEN 'purchase' THEN 'remove_project'
                             WHEN 'view' THEN 'add_dir' ELSE 'remove_dir' END AS op,
             '/src' || (user_id % 20) || CASE WHEN event_id % 3 = 0 THEN '/en' ELSE '' END AS path,
             CASE event_type WHEN 'click' THEN (event_id % 2)::VARCHAR ELSE '/ext' || (event_id % 4) END AS arg
      FROM events WHERE event_type <> 'error')""",
    "gens": """gens AS (
      SELECT base, seq AS g_from, arg AS run,
             (SELECT min(x.seq) FROM log x WHERE x.op = 'remove_project' AND x.path = s.base AND x.seq > s.seq) AS g_to
      FROM (SELECT path AS base, seq, op, arg, lag(op) OVER (PARTITION BY path ORDER BY seq) AS prev
            FROM log WHERE op IN ('add_project', 'remove_project')) s
      WHERE op = 'add_project' AND (prev IS NULL OR prev = 'remove_project'))""",
    "owned": f"""owned AS (
      SELECT d.seq, d.op, d.arg, arg_min(g.base, g.g_from) AS base, min(g.g_from) AS g_from
      FROM (SELECT seq, op, arg, unnest({ANCESTORS.format(p='pp')}) AS base
            FROM (SELECT *, {parts('path')} AS pp FROM log WHERE op IN ('add_dir', 'remove_dir'))) d
      JOIN gens g ON g.base = d.base AND g.g_from < d.seq AND (g.g_to IS NULL OR d.seq < g.g_to)
      GROUP BY d.seq, d.op, d.arg)""",
    "reg": """reg AS (
      SELECT g.base AS path, g.g_from AS reg_seq, g.run::INT AS run, d.dir
      FROM gens g LEFT JOIN (
        SELECT base, g_from, arg AS dir FROM owned GROUP BY base, g_from, arg
        HAVING arg_max(op, seq) = 'add_dir') d ON d.base = g.base AND d.g_from = g.g_from
      WHERE g.g_to IS NULL)""",
    "proj": f"""proj AS (
      SELECT p.path, arg_min(g.path, g.reg_seq) AS project
      FROM (SELECT path, unnest({ANCESTORS.format(p='pp')}) AS base
            FROM (SELECT DISTINCT path, {parts('path')} AS pp FROM corpus)) p
      LEFT JOIN (SELECT DISTINCT path, reg_seq FROM reg) g ON g.path = p.base GROUP BY p.path)""",
    "units": f"""units AS (
      SELECT c.doc_id, c.path, CASE WHEN regexp_replace(c.path, '/[^/]*$', '') IN ({', '.join(lit(x) for x in b.NORECURSE)})
             THEN c.path ELSE coalesce(p.project, regexp_replace(c.path, '/[^/]*$', '')) END AS unit
      FROM corpus c JOIN dirproj p ON p.dir = regexp_replace(c.path, '/[^/]*$', ''))""",
    "dirproj": f"""dirproj AS (
      SELECT p.path AS dir, arg_min(g.path, g.reg_seq) AS project
      FROM (SELECT path, unnest({ANCESTORS.format(p='pp')}) AS base
            FROM (SELECT DISTINCT dir AS path, {parts('dir')} AS pp
                  FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM corpus))) p
      LEFT JOIN (SELECT DISTINCT path, reg_seq FROM reg) g ON g.path = p.base GROUP BY p.path)""",
    "acts": f"acts AS {values(b.TOGGLE, 'event, action, forced')}",
    "ev": """ev AS (
      SELECT e.event_id, e.ts, e.user_id AS instance_id,
             (regexp_extract(e.props, '[0-9]+', 0)::INT % 8)::INT AS buffer_id,
             a.action, a.forced, floor(e.value / 5)::BIGINT AS fp
      FROM (SELECT *, CASE event_type WHEN 'click' THEN 'BufReadPre' WHEN 'view' THEN 'BufEnter'
                   WHEN 'purchase' THEN 'BufWritePost' WHEN 'signup' THEN 'FileType' ELSE 'Toggle' END AS event
            FROM events) e JOIN acts a USING (event))""",
}
DEPENDS = {
    "ccode": ["corpus"], "pycode": ["corpus"], "code": ["ccode", "pycode"], "special": ["cat"],
    "lines": ["cat"], "parsed": ["lines"], "prios": ["orders_"], "usable": ["cat", "orders_", "equiv"],
    "susable": ["special", "orders_", "equiv"], "tok": ["corpus"], "words": ["tok"],
    "hits": ["usable", "words"], "best": ["hits"], "grouped": ["best", "rules"],
    "ignorednames": ["cat"], "restored": ["cat"], "gens": ["log"], "owned": ["log", "gens"],
    "reg": ["gens", "owned"], "proj": ["corpus", "reg"], "dirproj": ["corpus", "reg"],
    "units": ["corpus", "dirproj"], "ev": ["acts"],
}


def sql(needs: str, select: str, *extra: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in DEPENDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    ctes = [CTES[n] for n in ordered] + list(extra)
    return (f"WITH {', '.join(ctes)} " if ctes else "") + select


def extraction(source: str, rules) -> str:
    """One branch per line rule over (file, lang, line, line_no) rows."""
    branches = [
        f"SELECT regexp_extract(line, {lit(regex)}, {group}) AS name, file, {lit(kind)} AS kind, lang, line_no "
        f"FROM {source} WHERE lower(lang) = {lit(lang.lower())} AND regexp_extract(line, {lit(regex)}, {group}) <> ''"
        for lang, regex, group, kind in rules]
    return " UNION ALL ".join(branches)


DOCLINES = """doclines AS (
  SELECT file, lang, source, l[i] AS line, i AS line_no FROM (
    SELECT path AS file, lang, source, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT *, string_split(text, chr(10)) AS l FROM corpus)))"""
CONVLINES = """convlines AS (
  SELECT file, lang, l[i] AS line, i AS line_no FROM (
    SELECT file, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT '/conv' || conv_id || '/' || turn AS file,
             CASE WHEN role = 'user' THEN 'C' ELSE 'Python' END AS lang,
             string_split(text, chr(10)) AS l FROM conversations)))"""


def placed(source: str, pattern: str, name: str, extra: str = "") -> str:
    """Pieces of each text with running offsets."""
    return f"""{name} AS (
      SELECT doc_id{extra}, piece, pos,
             (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) - length(piece))::BIGINT AS start,
             (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS "end"
      FROM (SELECT doc_id{extra}, p[pos] AS piece, pos FROM (
        SELECT *, unnest(range(1, len(p) + 1)) AS pos FROM (
          SELECT *, {found('text', pattern)} AS p FROM {source}))))"""


def regions(source: str, kind: str) -> tuple[str, str]:
    pattern, starts = {"markup": (MARKUP, '<"'), "clike": (CLIKE, "\"'/"), "python": (PY, "\"'#")}[kind]
    tiles = placed(source, f"{pattern}|[^{starts}]+|[\\s\\S]", f"t_{kind}")
    if kind == "markup":
        region = """CASE WHEN starts_with(piece, '<!--') AND length(piece) >= 7 THEN 'Comment'
                    WHEN starts_with(piece, '"') AND length(piece) >= 2 THEN 'String' END"""
    elif kind == "clike":
        region = """CASE WHEN starts_with(piece, '"') THEN 'String'
                    WHEN starts_with(piece, '''') AND length(piece) >= 2 THEN 'String'
                    WHEN starts_with(piece, '//') OR starts_with(piece, '/*') THEN 'Comment' END"""
    else:
        region = """CASE WHEN starts_with(piece, '#') THEN 'Comment'
                    WHEN (starts_with(piece, '"') OR starts_with(piece, '''')) AND length(piece) >= 2 THEN 'String' END"""
    return tiles, (f"SELECT doc_id, {region} AS region, start, \"end\", {lit(kind)} AS family "
                   f"FROM t_{kind} WHERE {region} IS NOT NULL")


def chunked(source: str, by: str) -> str:
    return (f"SELECT *, ((row_number() OVER (PARTITION BY {by} ORDER BY name) - 1) // {b.CHUNK})::BIGINT AS chunk "
            f"FROM {source}")


def fingerprints(levels: int = 8) -> tuple[str, str]:
    """The hash tree of each group and its roots: plain ordered aggregates, level by level."""
    parts = [f"""t0 AS (SELECT filetype, kind, node, count(*) AS n, md5(string_agg(name, chr(10) ORDER BY name)) AS digest
      FROM (SELECT *, (row_number() OVER (PARTITION BY filetype, kind ORDER BY name) - 1) // {b.CHUNK} AS node
        FROM (SELECT DISTINCT filetype, kind, name FROM best)) GROUP BY ALL)"""]
    for k in range(1, levels):
        parts.append(f"""t{k} AS (SELECT filetype, kind, node // {b.CHUNK} AS node, sum(n)::BIGINT AS n,
        md5(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM t{k - 1}
      WHERE (filetype, kind) IN (SELECT (filetype, kind) FROM t{k - 1} WHERE node > 0) GROUP BY ALL)""")
    tree = "(" + " UNION ALL ".join(f"SELECT filetype, kind, {k} AS level, node::BIGINT AS node, n, digest FROM t{k}"
                                    for k in range(levels)) + ")"
    roots = f"SELECT filetype, kind, arg_max(n, level) AS n, arg_max(digest, level) AS fingerprint FROM {tree} GROUP BY ALL"
    return sql("best", roots, *parts), sql("best", f"SELECT * FROM {tree}", *parts)


GROUP_FINGERPRINT, FINGERPRINT_TREE = fingerprints()
DEF_P, DEF_S = lit(r.DEFAULT_PREFIX), lit(r.DEFAULT_SUFFIX)


def rendered(escape: bool) -> list[str]:
    shown = rep("name", r"([.*^$/\\~\[\]])", r"\\\1") if escape else "name"
    return [
        """sbest AS (SELECT filetype, kind, name FROM (
             SELECT *, row_number() OVER (PARTITION BY filetype, name ORDER BY prio) AS rn FROM (
               SELECT DISTINCT u.filetype, u.kind, u.name, u.prio FROM susable u
               LEFT JOIN words w ON w.filetype = u.filetype AND w.name = u.name
               WHERE w.name IS NOT NULL OR (regexp_matches(u.name, '[$.]')
                     AND u.filetype IN (SELECT filetype FROM corpus)))) WHERE rn = 1)""",
        f"sch AS ({chunked('(SELECT s.filetype, s.kind, s.name, x.grp FROM sbest s JOIN userrules x USING (filetype, kind))', 'filetype, kind, grp')})",
        f"""srow AS (SELECT filetype, kind, grp, chunk, count(*) AS n, bool_or(contains(name, '.')) AS dotted,
               string_agg({shown}, '|' ORDER BY name) AS bars, string_agg({shown}, ' ' ORDER BY name) AS blanks,
               md5(string_agg(name, chr(10) ORDER BY name)) AS fingerprint FROM sch GROUP BY ALL)""",
        f"""sout AS (SELECT s.*, x.prefix, x.suffix,
               CASE WHEN x.notin <> '' THEN x.notin WHEN x.prefix = {DEF_P} AND x.suffix = {DEF_S} AND x.allow_keyword = 1
                    AND NOT dotted THEN '' ELSE {lit(','.join(r.GLOBAL_NOTIN))} END AS excluded,
               CASE WHEN x.notin <> '' THEN 'excluding'
                    WHEN x.prefix = {DEF_P} AND x.suffix = {DEF_S} AND x.allow_keyword = 1 AND NOT dotted
                    THEN 'keyword' ELSE 'match' END AS form
               FROM srow s JOIN userrules x USING (filetype, kind, grp))""",
        "sfin AS (SELECT *, CASE WHEN form = 'keyword' THEN blanks ELSE prefix || bars || suffix END AS text FROM sout)",
    ]


def changed(by: str) -> str:
    return f"lag(fp) OVER (PARTITION BY {by} ORDER BY ts, event_id)"


NEIGHBOURS = f"""nb AS (
  SELECT doc_id, filetype, piece AS name, start, "end",
         lag(piece) OVER w AS gb, lag(piece, 2) OVER w AS wb, lead(piece) OVER w AS ga, lead(piece, 2) OVER w AS wa
  FROM tiles WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


def keyword_before(word: str) -> str:
    return rf"coalesce(wb = '{word}' AND regexp_matches(gb, '^\s$'), false)"


AFTER_DEF = r"coalesce(wb = 'def' AND regexp_matches(gb, '^\s+$'), false)"
CALL = r"coalesce(regexp_matches(ga, '^\s*\('), false)"
CONTEXT = f"""CASE
  WHEN filetype = 'c' AND kind = 'g' THEN {keyword_before('enum')}
  WHEN filetype = 'c' AND kind = 's' THEN {keyword_before('struct')}
  WHEN filetype = 'c' AND kind = 'u' THEN {keyword_before('union')}
  WHEN filetype IN ('c', 'cpp') AND kind = 'm' THEN
    coalesce(regexp_matches(gb, '[\\])0-9](?:\\.|->)$') OR (gb IN ('.', '->') AND wb IS NOT NULL), false)
  WHEN filetype = 'c' AND kind = 't' THEN NOT coalesce(regexp_matches(ga, '^(?:\\.|->)'), false)
  WHEN filetype = 'cpp' AND kind = 'f' THEN {CALL}
  WHEN filetype = 'go' AND kind = 'm' THEN
    coalesce(regexp_matches(gb, '[\\])0-9]\\.$') OR (gb = '.' AND wb IS NOT NULL), false)
  WHEN filetype = 'go' AND kind = 'f' THEN
    {CALL} OR coalesce(regexp_matches(ga, '^\\s*:?=\\s*$') AND starts_with(wa, 'func'), false)
  WHEN filetype = 'python' AND kind = 'm' THEN coalesce(regexp_matches(gb, '\\.$'), false) OR {AFTER_DEF}
  WHEN filetype = 'python' AND kind = 'f' THEN NOT {AFTER_DEF}
  ELSE true END"""

CLEAN_C = squeezed(no_includes(rep("text", CLIKE)))
CLEAN_PY = squeezed(rep("text", PY))
USER_ORDER_ROWS = list({**r.KIND_ORDER, **b.USER_ORDERS}.items())
EMITTED = "event_id, instance_id, buffer_id, fp"
PAGE_TILES = placed("page", TILE, "tiles")


def counted(source: str, tokens: str, keep: str = "true") -> str:
    return (f"SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest({tokens}) AS name FROM {source}) "
            f"WHERE {keep} GROUP BY ALL")


SCOPED_LIST = ("flatten(list_transform(" + found("text", "[A-Za-z_][A-Za-z0-9_:]*") +
               ", lambda w: CASE WHEN contains(w, ':') THEN [w, regexp_replace(w, '^[^:]*:', '')] ELSE [w] END))")

emit_sql = sql("ev", f"SELECT {EMITTED} FROM (SELECT *, {changed('instance_id, buffer_id')} AS prev FROM ev "
               "WHERE action <> 'toggle') WHERE forced OR prev IS NULL OR prev <> fp")
gate_sql = sql(
    "ev", f"SELECT {EMITTED}, epoch FROM (SELECT *, {changed('instance_id, buffer_id, epoch')} AS prev FROM ("
    "SELECT *, (sum(CASE WHEN action = 'toggle' THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY instance_id ORDER BY ts, event_id))::BIGINT AS epoch FROM ev) "
    "WHERE action <> 'toggle' AND epoch % 2 = 0) WHERE forced OR prev IS NULL OR prev <> fp")
seen_sql = sql("ev", "SELECT DISTINCT instance_id, buffer_id FROM ev WHERE NOT forced AND action <> 'toggle'")
latest_sql = sql(
    "ev", f"SELECT slice, {EMITTED} FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, slice "
    "ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, strftime(ts, '%Y-%m-%d %H') AS slice FROM ev "
    "WHERE action <> 'toggle')) WHERE rn = 1")
route_sql = sql("ev", "SELECT event_id, action, forced FROM ev")
scan_sql = sql("lines", "SELECT value FROM lines WHERE value <> ''")

masked_sql = sql(
    "page", "SELECT o.doc_id, piece AS name, start, \"end\" FROM tiles o WHERE regexp_matches(piece, '^[A-Za-z_]') "
    "AND NOT EXISTS (SELECT 1 FROM regs s WHERE s.doc_id = o.doc_id AND s.start <= o.start AND o.\"end\" <= s.\"end\")",
    PAGE_TILES, regions("page", "markup")[0], f"regs AS ({regions('page', 'markup')[1]})")

SQL: dict[str, str] = {
    "scan_tags_plain": scan_sql,
    "scan_tags_gzip": scan_sql,
    "scan_tags_xz": scan_sql,
    "scan_tags_manifest": sql("lines", "SELECT value FROM lines, range(3) WHERE value <> ''"),
    "scan_corpus": "SELECT doc_id, 'txt' AS ext, text || chr(10) AS text FROM documents",
    "scan_registry_json": sql("reg", "SELECT path, run, coalesce(string_agg(dir, ',' ORDER BY dir), '') AS dirs "
                              "FROM reg GROUP BY path, run"),
    "sink_tags_partitioned": sql(
        "cat", "SELECT '__src__' || file AS root_key, lower(lang) AS filetype, "
        "concat_ws(chr(9), name, file, '/^' || name || '$/;\"', kind, 'language:' || lang) AS value FROM cat"),
    "extract_symbols": sql("corpus", extraction("doclines", [*r.LINE_RULES, *b.LINE_RULES]), DOCLINES),
    "select_sources_by_ext": sql(
        "corpus", "SELECT doc_id, path, filetype FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext "
        "FROM corpus) c WHERE EXISTS (SELECT 1 FROM exts e WHERE e.filetype = c.filetype AND e.ext = c.ext) "
        "OR (ext = filetype AND filetype NOT IN (SELECT filetype FROM exts))",
        f"exts AS {values([(ft, e) for ft, es in r.FILETYPE_EXTENSIONS.items() for e in es], 'filetype, ext')}"),
    "exclude_sources_glob": f"""SELECT doc_id, path FROM (
        SELECT doc_id, '/' || source || '/' || lang || '/' || CASE doc_id % 8
          WHEN 0 THEN 'doc' || doc_id || '/Makefile' WHEN 1 THEN 'a' || doc_id || 'config.log'
          WHEN 2 THEN '.mypy_cache/' || doc_id || '.json' WHEN 3 THEN 'configure' || doc_id
          ELSE 'doc' || doc_id || '.c' END AS path FROM documents)
        WHERE len(list_filter(string_split(path, '/'), lambda part: {" OR ".join(f"part GLOB {lit(g)}" for g in r.EXCLUDED_GLOBS)})) = 0""",
    "scan_unit": sql("units", "SELECT doc_id, path, unit FROM units"),
    "stale_units": sql(
        "units reg", """SELECT u.unit, g.run FROM (SELECT DISTINCT unit FROM units) u
        LEFT JOIN (SELECT DISTINCT path, run FROM reg) g ON g.path = u.unit
        WHERE coalesce(g.run, 1) <> 0 AND u.unit NOT IN (
          SELECT '/' || source || '/' || lang FROM documents GROUP BY source, lang
          HAVING count(*) >= 8 AND sum(n_chars) > 0)"""),
    "parse_tag_lines": sql("parsed", "SELECT name, file, pattern, kind, lang FROM parsed"),
    "ascii_fold": f"SELECT doc_id, {fold('text')} AS text FROM documents",
    "strip_clike": sql("ccode", f"SELECT doc_id, {rep('text', CLIKE)} AS text FROM ccode"),
    "strip_python": sql("pycode", f"SELECT doc_id, {rep('text', PY)} AS text FROM pycode"),
    "strip_includes": sql("ccode", f"SELECT doc_id, {no_includes(rep('text', CLIKE))} AS text FROM ccode"),
    "squeeze_blank": sql("pycode", f"SELECT doc_id, {squeezed('text')} AS text FROM pycode"),
    "strip_dispatch": sql("code", f"SELECT doc_id, filetype, CASE filetype WHEN 'c' THEN {CLEAN_C} WHEN 'cpp' THEN "
                          f"{CLEAN_C} WHEN 'python' THEN {CLEAN_PY} ELSE text END AS text FROM code"),
    "normalize_language": sql(
        "corpus cat", "SELECT filetype, CASE filetype WHEN 'cpp' THEN 'C++' ELSE filetype END AS language, count(*) AS n "
        "FROM corpus GROUP BY ALL UNION ALL "
        "SELECT lower(lang), lang, 1 FROM (SELECT DISTINCT lang FROM cat)"),
    "identify_language": sql(
        "corpus page", f"SELECT d.doc_id, d.filetype, coalesce(l.language, 'unknown') AS language FROM ("
        f"SELECT doc_id, upper(filetype) AS filetype FROM corpus UNION ALL SELECT doc_id, upper(filetype) FROM page) d "
        f"LEFT JOIN {values(r.LANGUAGES, 'filetype, language')} l ON l.filetype = lower(d.filetype)"),
    "split_filetype": sql(
        "corpus", "SELECT doc_id, ft AS filetype, (i - 1)::INT AS part_no, string_split(lower(ft), '.')[i] AS part FROM ("
        "SELECT doc_id, upper(filetype) || '.' || source AS ft, unnest([1, 2]) AS i FROM corpus)"),
    "remap_kind": sql(
        "cat orders_ equiv", f"SELECT o.filetype, coalesce(e.kind_to, t.kind) AS kind, t.name, t.file FROM cat t "
        f"JOIN orders_ o ON o.fam = {family('t.lang')} LEFT JOIN equiv e ON e.filetype = o.filetype AND e.kind_from = t.kind"),
    "kind_priority": sql(
        "cat orders_ prios", f"SELECT o.filetype, t.kind, p.prio, count(*) AS n FROM cat t "
        f"JOIN orders_ o ON o.fam = {family('t.lang')} JOIN prios p ON p.filetype = o.filetype AND p.kind = t.kind GROUP BY ALL"),
    "root_key": sql(
        "corpus", "SELECT doc_id, replace(dir, '/', '__') AS root_key, replace(dir, '/', '__') || '_' || filetype AS typed_key "
        "FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM corpus)"),
    "scope_local_name": sql(
        "cat", "SELECT file, kind, scoped, CASE WHEN kind = 'f' THEN regexp_replace(scoped, '^[^:]*:', '') ELSE scoped END AS name "
        "FROM (SELECT file, kind, substr(lang, 1, 1) || ':' || name || ':' || kind AS scoped FROM cat)"),
    "group_key": sql(
        "usable rules", "SELECT DISTINCT u.filetype, u.kind, u.filetype || '#' || u.kind AS key, "
        "u.filetype || '_' || u.kind || '_' || r.grp AS out_key FROM usable u JOIN rules r USING (filetype, kind)"),
    "tokenize_ident": sql("corpus", counted("corpus", found(fold("text"), IDENT))),
    "tokenize_word": sql("page", counted("page", "regexp_split_to_array(text, '[^A-Za-z0-9_]')", "name <> ''")),
    "tokenize_scoped": sql("page", counted("page", SCOPED_LIST, "name <> ''")),
    "token_offsets": sql(
        "corpus", "SELECT doc_id, piece AS name, start, \"end\" FROM tiles WHERE regexp_matches(piece, '^[A-Za-z_]')",
        f"folded AS (SELECT doc_id, {fold('text')} AS text FROM corpus)", placed("folded", TILE, "tiles")),
    "filter_ignored_filetypes": sql(
        "corpus", "SELECT doc_id, filetype FROM (SELECT doc_id, CASE WHEN length(path) <= 17 THEN 'markdown' "
        "WHEN length(path) = 18 THEN '' ELSE filetype END AS filetype FROM corpus) "
        f"WHERE filetype <> '' AND filetype NOT IN ({', '.join(lit(x) for x in r.IGNORED_FILETYPES)})"),
    "filter_malformed_tags": sql(
        "parsed", "SELECT name, file, pattern, kind, lang FROM parsed WHERE NOT starts_with(name, '!') "
        "AND kind IS NOT NULL AND lang IS NOT NULL"),
    "filter_kind_in_order": sql(
        "cat orders_", f"SELECT o.filetype, t.kind, t.name, (instr(o.ord, t.kind) - 1)::INT AS prio FROM cat t "
        f"JOIN orders_ o ON o.fam = {family('t.lang')} WHERE instr(o.ord, t.kind) > 0"),
    "filter_language": sql(
        "cat orders_", f"SELECT o.filetype, t.lang, t.kind, t.name FROM cat t JOIN orders_ o ON o.fam = {family('t.lang')}"),
    "filter_ignored_tags": sql(
        "usable ignorednames", "SELECT filetype, kind, name FROM usable u WHERE NOT EXISTS ("
        "SELECT 1 FROM ignorednames i WHERE i.filetype = u.filetype AND i.name = u.name)"),
    "keep_special_names": sql(
        "susable words corpus", "SELECT DISTINCT u.filetype, u.kind, u.name FROM susable u LEFT JOIN words w "
        "ON w.filetype = u.filetype AND w.name = u.name WHERE w.name IS NOT NULL OR "
        "(regexp_matches(u.name, '[$.]') AND u.filetype IN (SELECT filetype FROM corpus))"),
    "present_tags": sql(
        "usable tok", "SELECT DISTINCT t.doc_id, t.filetype, u.kind, t.name FROM tok t JOIN usable u USING (filetype, name)"),
    "present_or_same_file": sql(
        "corpus tok orders_ equiv cat", "SELECT DISTINCT c.doc_id, c.filetype, u.kind, u.name FROM corpus c "
        "JOIN u USING (filetype) WHERE u.file = c.path UNION "
        "SELECT t.doc_id, t.filetype, u.kind, t.name FROM tok t JOIN u USING (filetype, name)",
        "both_ AS (SELECT * FROM cat UNION ALL SELECT 'sym_' || doc_id, path, 'f', lang FROM corpus)",
        usable_cte("u", "both_", "orders_")),
    "resolve_project": sql("proj", "SELECT path, project FROM proj"),
    "expand_roots": sql("reg", "SELECT DISTINCT path, path AS root FROM reg UNION ALL "
                        "SELECT path, dir FROM reg WHERE dir IS NOT NULL"),
    "apply_rules": sql("hits rules", "SELECT h.filetype, h.kind, h.name, r.grp, r.prefix, r.suffix, r.allow_keyword "
                       "FROM hits h JOIN rules r USING (filetype, kind)"),
    "resolve_group_links": sql(
        "grouped", "SELECT grp AS src, e.dst, count(*) AS n FROM grouped JOIN (SELECT src, dst FROM walk "
        "WHERE dst NOT IN (SELECT src FROM links)) e ON e.src = grp GROUP BY ALL",
        f"links AS {values(r.GROUP_LINKS, 'src, dst')}",
        "walk AS (SELECT src, dst FROM links UNION SELECT w.src, l.dst FROM walk w "
        "JOIN links l ON l.src = w.dst)").replace("WITH ", "WITH RECURSIVE ", 1),
    "restore_builtin_groups": sql(
        "grouped restored", "SELECT g.filetype, g.kind, g.name, coalesce(x.grp, g.grp) AS grp FROM grouped g "
        "LEFT JOIN restored x USING (filetype, name)"),
    "mask_regions": masked_sql,
    "mask_regions_inline": masked_sql,
    "region_spans": sql(
        "page ccode pycode", " UNION ALL ".join(regions(s, k)[1] for s, k in
                                                [("page", "markup"), ("ccode", "clike"), ("pycode", "python")]),
        *[regions(s, k)[0] for s, k in [("page", "markup"), ("ccode", "clike"), ("pycode", "python")]]),
    "context_match": sql(
        "code usable", f"SELECT doc_id, filetype, kind, name, count(*) AS n, min(start) AS first_start, "
        f"sum(\"end\")::BIGINT AS sum_end FROM (SELECT nb.*, k.kind FROM nb JOIN kinds k USING (filetype, name)) "
        f"WHERE {CONTEXT} GROUP BY ALL",
        placed("code", TILE, "tiles", ", filetype"), NEIGHBOURS,
        "kinds AS (SELECT filetype, name, arg_min(kind, prio) AS kind FROM usable GROUP BY ALL)"),
    "distinct_tokens": sql("tok", "SELECT doc_id, filetype, name FROM tok"),
    "distinct_tags": sql("usable", "SELECT DISTINCT filetype, kind, name FROM usable"),
    "group_members": sql(
        "best", f"SELECT filetype, kind, chunk, string_agg(name, ',' ORDER BY name) AS members FROM "
        f"({chunked('best', 'filetype, kind')}) GROUP BY ALL"),
    "group_counts": sql("hits", "SELECT filetype, kind, count(*) AS n FROM hits GROUP BY ROLLUP (filetype, kind)"),
    "empty_groups": sql(
        "hits prios", "SELECT p.filetype, p.kind, p.prio, count(h.name) AS n FROM prios p LEFT JOIN hits h "
        "ON h.filetype = p.filetype AND h.kind = p.kind GROUP BY ALL"),
    "group_fingerprint": GROUP_FINGERPRINT,
    "fingerprint_tree": FINGERPRINT_TREE,
    "priority_kind": sql("best", "SELECT filetype, kind, name, prio::INT AS prio FROM best"),
    "chunk_members": sql("best", f"SELECT filetype, kind, name, chunk FROM ({chunked('best', 'filetype, kind')})"),
    "sort_tags_by_name": sql("cat", "SELECT name, kind, file, row_number() OVER (ORDER BY name, kind, file) AS rank FROM cat"),
    "sort_tags_kind_len": sql("cat", "SELECT kind, name, row_number() OVER (ORDER BY kind, length(name), name) AS rank FROM cat"),
    "order_by_priority": sql(
        "hits", "SELECT filetype, kind, n, prio::INT AS prio, row_number() OVER (ORDER BY filetype, prio) AS rank FROM ("
        "SELECT filetype, kind, prio, count(*) AS n FROM hits GROUP BY ALL)"),
    "union_tag_sets": sql(
        "corpus cat", "SELECT name, file, kind, lang FROM cat UNION ALL SELECT name, file, kind, lang FROM ("
        + extraction("doclines", b.LINE_RULES) + ") UNION ALL SELECT name, file, kind, lang FROM cat", DOCLINES),
    "merge_exclusions": sql(
        "hits userrules", "SELECT h.filetype, h.kind, r.notin AS excluded, count(*) AS n FROM hits h "
        "JOIN userrules r USING (filetype, kind) GROUP BY ALL"),
    "registry_fold": sql("reg", "SELECT path, reg_seq, run, dir FROM reg"),
    "matcher_form": sql("susable words userrules", "SELECT filetype, kind, grp, chunk, form, n FROM sfin", *rendered(False)),
    "render_pattern": sql("susable words userrules",
                          "SELECT filetype, kind, chunk, text, excluded, fingerprint FROM sfin", *rendered(False)),
    "escape_names": sql("susable words userrules", "SELECT filetype, kind, chunk, text FROM sfin", *rendered(True)),
    "matcher_inventory": sql(
        "code usable ignorednames restored rules",
        f"SELECT m.filetype, m.kind, m.grp, m.chunk, CASE WHEN coalesce(r.prefix, {DEF_P}) = {DEF_P} "
        f"AND coalesce(r.suffix, {DEF_S}) = {DEF_S} AND coalesce(r.allow_keyword, 1) = 1 AND NOT dotted THEN 'keyword' "
        f"ELSE 'match' END AS form, n, CASE WHEN form = 'keyword' THEN blanks ELSE coalesce(r.prefix, {DEF_P}) || bars "
        f"|| coalesce(r.suffix, {DEF_S}) END AS text, "
        f"CASE WHEN form = 'keyword' THEN '' ELSE {lit(','.join(r.GLOBAL_NOTIN))} END AS excluded, fingerprint "
        "FROM mrow m LEFT JOIN rules r USING (filetype, kind, grp)",
        f"clean AS (SELECT doc_id, filetype, CASE filetype WHEN 'python' THEN {CLEAN_PY} ELSE {CLEAN_C} END AS text FROM code)",
        f"cwords AS (SELECT DISTINCT filetype, unnest({found('text', IDENT)}) AS name FROM clean)",
        "mbest AS (SELECT filetype, name, arg_min(kind, prio) AS kind FROM usable u WHERE NOT EXISTS ("
        "SELECT 1 FROM ignorednames i WHERE i.filetype = u.filetype AND i.name = u.name) GROUP BY ALL)",
        "mgrp AS (SELECT filetype, kind, name, coalesce(x.grp, r.grp) AS grp FROM mbest JOIN cwords USING (filetype, name) "
        "JOIN rules r USING (filetype, kind) LEFT JOIN restored x USING (filetype, name))",
        "mrow AS (SELECT filetype, kind, grp, chunk, count(*) AS n, bool_or(contains(name, '.')) AS dotted, "
        "string_agg(name, '|' ORDER BY name) AS bars, string_agg(name, ' ' ORDER BY name) AS blanks, "
        f"md5(string_agg(name, chr(10) ORDER BY name)) AS fingerprint FROM ({chunked('mgrp', 'filetype, kind, grp')}) GROUP BY ALL)"),
    "route_events": route_sql,
    "route_events_stream": route_sql,
    "first_seen": seen_sql,
    "first_seen_stream": seen_sql,
    "emit_on_change": emit_sql,
    "emit_on_change_stream": emit_sql,
    "emit_on_change_by_batch": emit_sql,
    "enabled_gate": gate_sql,
    "enabled_gate_by_batch": gate_sql,
    "enabled_gate_stream": gate_sql,
    "latest_wins": latest_sql,
    "latest_wins_stream": latest_sql,
    "incremental_index": sql(
        "corpus ev", "SELECT '__' || source AS root_key, name, file, kind, lang, line_no FROM ("
        + extraction("doclines", b.LINE_RULES) + ") JOIN (SELECT path AS file, source FROM corpus) USING (file) "
        "WHERE source IN (SELECT 'src' || (instance_id % 20) FROM ev WHERE forced)", DOCLINES),
    "custom_rules": sql(
        "cat userrules", "SELECT u.filetype, u.kind, x.grp, x.prefix, x.suffix, x.allow_keyword, u.prio::INT AS prio, "
        "count(*) AS n FROM u JOIN userrules x USING (filetype, kind) GROUP BY ALL",
        f"uorders AS {orders_cte(USER_ORDER_ROWS)}",
        f"uequiv AS {values([*EQUIV_ROWS, ('go', 'e', 'f')], 'filetype, kind_from, kind_to')}",
        usable_cte("u", "cat", "uorders", "uequiv")),
    "custom_extractors": sql(
        "", extraction("convlines", [*r.LINE_RULES, *b.LINE_RULES, *b.EXTRA_LINE_RULES]), CONVLINES),
}
