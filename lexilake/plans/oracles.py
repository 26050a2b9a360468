"""DuckDB SQL for the engine's queries, built from the catalogue by other means than the Spark plans:
no look-around, list functions instead of spans, and joins where Spark stays in a row."""

from __future__ import annotations

from ..functions import dialect
from ..functions.text import FOLD_FROM, FOLD_TO, WORD
from ..operators import wikitext
from ..operators.catalogue import BY_ID, CATEGORIES, STRUCTURAL, TIER_SEVERITY
from ..operators.extraction import CODE, HTML, PROSE
from ..operators.linting import expand_rules
from ..operators.matching import union_pattern
from ..sources.files import glob_regex
from . import planted
from .queries import GLOBS, SWEPT, USER_RULES

S = f"[{dialect.SPACE}]"


def q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def pick(values: list[str], n: str) -> str:
    return f"([{', '.join(map(q, values))}])[{n} % {len(values)} + 1]"


def extract(x: str, regex: str) -> str:
    return f"regexp_extract_all({x}, {q(regex)})"


def count(x: str, regex: str) -> str:
    return f"len({extract(x, regex)})"


def gaps(x: str, regex: str) -> str:
    return f"string_split_regex({x}, {q(regex)})"


def units(x: str) -> str:
    return f"(length({x}) + {count(x, r'[\x{10000}-\x{10FFFF}]')})"


def blank(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\x{{10000}}-\x{{10FFFF}}]', '  ', 'g'), '[^\n]', ' ', 'g')"


def steps(name: str, source: str, column: str, regexes: list[str], keep: bool = False) -> tuple[str, str]:
    """Common table expressions that blank each pattern's matches in turn; the last one's name."""
    out, last = [], source
    for i, r in enumerate(regexes):
        g, m = ("gap", f"coalesce({blank('hit[i]')}, '')") if not keep else ("gap", "coalesce(hit[i], '')")
        left = f"{g}[i]" if not keep else blank("gap[i]")
        now = f"{name}{i}"
        out.append(f"{now} AS (SELECT * EXCLUDE (gap, hit) REPLACE (array_to_string(list_transform(range(1, len(gap) + 1), lambda i: {left} || {m}), '') AS {column}) FROM (SELECT *, {gaps(column, r)} AS gap, {extract(column, r)} AS hit FROM {last}))")
        last = now
    return ", ".join(out), last


CODE_STEPS = [r"```[\s\S]*?(?:```|\z)", r"~~~[\s\S]*?(?:~~~|\z)", r"`[^`\n]*`"]
FRONT_STEPS = [r"\A---\r?\n[\s\S]*?\r?\n---(?:\n|\z)", r"\A\+\+\+\r?\n[\s\S]*?\r?\n\+\+\+(?:\n|\z)"]
_NOT_SPACE = S.replace("[", "[^", 1)
URL_STEPS = [rf'\]\({_NOT_SPACE[:-1]})]+(?:{S}+"[^"]*")?\)', rf"(?m)^{S}*\[[^\]]+\]:{S}*{_NOT_SPACE}+[^\n]*$", r"<https?://[^>]+>", rf"https?://{_NOT_SPACE}+"]
HTML_STEPS = [r"<!--[\s\S]*?-->", r"(?i)<script\b[\s\S]*?</script>", r"(?i)<style\b[\s\S]*?</style>", r"</?[a-zA-Z][^>]*>"]
TABLE_STEPS = [r"(?m)^\|[^\n]*\|[ \t]*$"]
COMMENTS = rf"(?m)/\*[\s\S]*?\*/|(?:^|[^:])//[^\n]*|^{S}*#[^\n]*"


def folded(x: str) -> str:
    composed = f"CASE WHEN {units(f'nfc_normalize({x})')} = {units(x)} THEN nfc_normalize({x}) ELSE {x} END"
    return f"translate({composed}, {q(FOLD_FROM)}, {q(FOLD_TO)})"


EXAMPLES_SQL = f"src AS (SELECT doc_id, lang, source, coalesce(text, '') || chr(10) || chr(10) || {pick(planted.EXAMPLES, 'doc_id')} || chr(10) AS text FROM documents)"


def before(values: list[str]) -> str:
    return f"src AS (SELECT doc_id, {pick(values, 'doc_id')} || chr(10) || coalesce(text, '') AS text FROM documents)"


def views(source: str = EXAMPLES_SQL, masking: bool = True) -> str:
    """Tables src (given), and v with raw, working, norm."""
    masks, last = steps("code", "src0", "working", CODE_STEPS if masking else [])
    return f"{source}, src0 AS (SELECT *, text AS raw, text AS working FROM src), {masks + ', ' if masks else ''}v AS (SELECT *, {folded('working')} AS norm FROM {last})"


def hit_list(c, p) -> str:
    return extract("working" if c.id in STRUCTURAL else "norm", dialect.re2(p.regex, p.flags))


def shown(x: str, cut: bool = True) -> str:
    t = f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"
    return f"left({t}, 120)" if cut else t


def category_tables(only: list[str] | None = None, cut: bool = True) -> str:
    """Table cat: one row for each document and category with hits: n, distinct count, points, surfaces."""
    parts = []
    for i, c in enumerate(CATEGORIES):
        if only is None or c.id in only:
            lists = ", ".join(f"({hit_list(c, p)})" for p in c.patterns)
            parts.append(f"SELECT doc_id, {i} AS ordinal, {q(c.id)} AS category, {q(c.tier)} AS tier, {c.weight} AS weight, {c.cap} AS cap, flatten([{lists}]) AS found FROM v")
    return f"cat0 AS ({' UNION ALL '.join(parts)}), cat AS (SELECT *, len(found) AS n, list_transform(found, lambda x: {shown('x', cut)}) AS surfaces, len(list_distinct(list_transform(found, lambda x: lower({shown('x', cut)})))) AS n_distinct, least(cap, len(list_distinct(list_transform(found, lambda x: lower({shown('x', cut)})))) * weight) AS points FROM cat0 WHERE len(found) > 0)"


def fixed(x: str, places: int) -> str:
    """Rounding by whole numbers: a double times 2^80 is one, as far as it matters, and the rest is their arithmetic."""
    return f"(((({x}) * {2**80}::DOUBLE)::HUGEINT * {2 * 10**places} + {2**80}) // {2**81})::DOUBLE / {10**places}::DOUBLE"


def counts(parts: str, least: int) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {count('s', WORD)}), lambda n: n > {least})"


SENTENCES = f"string_split(regexp_replace(regexp_replace(norm, '\\n+', ' ', 'g'), '([.!?]){S}+', '\\1' || chr(1), 'g'), chr(1))"
PARAGRAPHS = gaps("norm", rf"\n{S}*\n")
METRICS = f"""m0 AS (SELECT *, {count('raw', WORD)} AS raw_words, {count('norm', WORD)} AS words, {count('raw', '—')} AS dashes, {count('raw', f'{S}—{S}')} AS spaced,
  {count('raw', '[‘’“”]')} AS curly, {count('raw', '''["']''')} AS straight, {counts(SENTENCES, 2)} AS s, {counts(PARAGRAPHS, 15)} AS p FROM v),
m1 AS (SELECT *, list_sum(s)::DOUBLE / nullif(len(s), 0) AS s_mean, list_sum(p)::DOUBLE / nullif(len(p), 0) AS p_mean FROM m0),
m2 AS (SELECT *, sqrt(list_sum(list_transform(s, lambda x: (x - s_mean) * (x - s_mean))) / len(s)) / s_mean AS s_cv, sqrt(list_sum(list_transform(p, lambda x: (x - p_mean) * (x - p_mean))) / len(p)) / p_mean AS p_cv FROM m1),
m AS (SELECT *, dashes * 1000.0::DOUBLE / greatest(raw_words, 1) > 3 AS dash_flag, curly > 0 AND straight > 0 AS mixed, coalesce(len(s) >= 5 AND s_cv < 0.35, false) AS s_flag, coalesce(len(p) >= 3 AND p_cv < 0.25, false) AS p_flag FROM m2)"""
BONUS = "(CASE WHEN dash_flag THEN 6 ELSE 0 END + CASE WHEN s_flag THEN 6 ELSE 0 END + CASE WHEN p_flag THEN 4 ELSE 0 END + CASE WHEN mixed THEN 2 ELSE 0 END)"
BAND = "CASE WHEN score >= 65 THEN 'strong LLM register' WHEN score >= 35 THEN 'mixed signals' WHEN score >= 15 THEN 'faint traces' ELSE 'no meaningful signal' END"


def scores(source: str = EXAMPLES_SQL, only: list[str] | None = None, cut: bool = True, zero: float = 1.0) -> str:
    """Tables v, cat, m and sc (document columns, words, score, band)."""
    return f"""{views(source)}, {category_tables(only, cut)}, {METRICS}, pts AS (SELECT doc_id, sum(points) AS points FROM cat GROUP BY doc_id),
sc0 AS (SELECT m.*, greatest(0, least(100, floor((coalesce(points, 0) + {BONUS}) * CASE WHEN words > 0 THEN least(1.6::DOUBLE, greatest(0.6::DOUBLE, 500::DOUBLE / greatest(words, 120))) ELSE {zero}::DOUBLE END + 0.5::DOUBLE)))::INT AS score FROM m LEFT JOIN pts USING (doc_id)),
sc AS (SELECT *, {BAND} AS band FROM sc0)"""


CORPORA = scores() + ", co AS (SELECT *, CASE WHEN lang = 'en' THEN 'ai' WHEN lang = 'fr' THEN 'chat' ELSE 'human' END AS corpus FROM sc)"
LINT_RULES = {"ai_vocabulary": "warn", "copula_avoidance": "warn", "rule_of_three": "warn"}


def placed(most: int | None = None) -> str:
    """Table f: all findings with positions, severities on; k numbers a category's hits in order."""
    on = expand_rules(LINT_RULES)
    parts = []
    for i, c in enumerate(CATEGORIES):
        if on[c.id] == "off":
            continue
        for j, p in enumerate(c.patterns):
            view = "working" if c.id in STRUCTURAL else "norm"
            r = dialect.re2(p.regex, p.flags)
            parts.append(f"SELECT doc_id, raw, {i} AS c, {j} AS p, {q(c.id)} AS category, {q(c.label)} AS label, {q(c.tier)} AS tier, {q(c.why)} AS help, {q(f'{c.id}/{p.id}')} AS \"ruleId\", {q(on[c.id])} AS severity, {extract(view, r)} AS hit, {gaps(view, r)} AS gap FROM v")
    lead = f"regexp_extract(m, '^[.!?]?{S}*')"
    cap = f"WHERE rank <= {most}" if most else ""
    return f"""h0 AS ({' UNION ALL '.join(parts)}), h1 AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM h0 WHERE len(hit) > 0),
h2 AS (SELECT *, hit[i] AS m, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS off FROM h1),
h3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY p, i) AS rank, CASE WHEN length({lead}) < length(m) THEN length({lead}) ELSE 0 END AS lead FROM h2),
h4 AS (SELECT *, left(raw, (off + lead)::BIGINT) AS ahead, {shown('substr(m, lead + 1)', False)} AS match FROM h3 {cap}),
f AS (SELECT doc_id, raw, c, p, rank, category, label, tier, help, "ruleId", severity, match, {units('match')} AS size, length(ahead) - length(replace(ahead, chr(10), '')) + 1 AS line,
  {units("string_split(ahead, chr(10))[-1]")} + 1 AS "column", {units("string_split(ahead, chr(10))[-1]")} + 1 + {units("string_split(match, chr(10))[1]")} AS "endColumn", {units('ahead')} AS "offset" FROM h4)"""


DEDUPED = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY size DESC, line, "column", p, rank) AS o FROM f),
rec AS (SELECT doc_id, c, o, [{'s': "offset", 'e': "offset" + size, 'o': o}] AS kept FROM o WHERE o = 1
  UNION ALL SELECT o.doc_id, o.c, o.o, CASE WHEN len(list_filter(kept, lambda k: o."offset" < k.e AND o."offset" + o.size > k.s)) > 0 THEN kept ELSE list_append(kept, {'s': o."offset", 'e': o."offset" + o.size, 'o': o.o}) END
  FROM rec JOIN o ON o.doc_id = rec.doc_id AND o.c = rec.c AND o.o = rec.o + 1),
top AS (SELECT doc_id, c, arg_max(kept, o) AS kept FROM rec GROUP BY doc_id, c), keep AS (SELECT doc_id, c, unnest(kept).o AS o FROM top),
d AS (SELECT o.* FROM o JOIN keep USING (doc_id, c, o))"""
#: What a finding says beside its place; JSON text escapes the match.
MESSAGE = "label || ': ' || to_json(CASE WHEN size > 60 THEN left(match, 59) || '…' ELSE match END)::VARCHAR"
FINDING = f"""doc_id, line, "column", "endColumn", "offset", "ruleId", severity, match, {MESSAGE} AS message, coalesce(string_split(raw, chr(10))[line], '') AS text"""
LINTED = f"WITH RECURSIVE {scores(cut=False, zero=1.6)}, {placed()}, {DEDUPED}, lc AS (SELECT sc.doc_id, sc.score, sc.band, sc.words, count(d.doc_id) FILTER (severity = 'error') AS errors, count(d.doc_id) FILTER (severity = 'warn') AS warnings FROM sc LEFT JOIN d ON d.doc_id = sc.doc_id GROUP BY ALL)"


def masked(values: list[str], regexes: list[str], keep: bool = False) -> str:
    ctes, last = steps("t", "src", "text", regexes, keep)
    return f"WITH {before(values)}, {ctes} SELECT doc_id, sha256(text) AS sha, {units('text')} AS units FROM {last}"


def metric(select: str) -> str:
    return f"WITH {views(before(planted.TYPOGRAPHY))}, {METRICS} SELECT doc_id, {select} FROM m"


def hits(category: str) -> str:
    c = BY_ID[category]
    parts = []
    for p in c.patterns:
        view, r = "working" if category in STRUCTURAL else "norm", dialect.re2(p.regex, p.flags)
        parts.append(f"SELECT doc_id, {q(p.id)} AS pattern, {extract(view, r)} AS found, {gaps(view, r)} AS gap FROM v")
    return f"WITH {views()}, h AS ({' UNION ALL '.join(parts)}) SELECT doc_id, pattern, len(found) AS n, length(gap[1]) AS first_offset, found[1] AS first_match FROM h WHERE len(found) > 0"


def prose() -> str:
    ext = pick(planted.EXTENSIONS, "doc_id")
    kinds = {"markdown": ("= '.md'", FRONT_STEPS + HTML_STEPS + URL_STEPS + TABLE_STEPS, False), "html": ("IN ('.html', '.vue')", HTML_STEPS + URL_STEPS, False), "comments": ("= '.py'", [COMMENTS], True), "text": ("= '.txt'", FRONT_STEPS + URL_STEPS, False)}
    ctes, ends = [f"{before(planted.STRUCTURE)}"], []
    for k, (test, regexes, keep) in kinds.items():
        ctes.append(f"src_{k} AS (SELECT * FROM src WHERE {ext} {test})")
        more, last = steps(f"t_{k}", f"src_{k}", "text", regexes, keep)
        ctes.append(more)
        ends.append(f"SELECT doc_id, {q(k)} AS mode, sha256(text) AS sha FROM {last}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(ends)}"


def wiki() -> str:
    x = "text"
    for a, b in wikitext.HUMAN:
        x = f"regexp_replace({x}, {q(a)}, {q(b.replace('$1', chr(92) + '1'))}, 'g')"
    return f"WITH {before(planted.WIKITEXT)}, c AS (SELECT doc_id, regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '') AS m FROM src) SELECT doc_id, sha256(m) AS sha, length(m) AS chars FROM c"


def _lintable() -> str:
    names = [".MD", ".rst", ".exe", "", ".tar.gz", ".svelte", ".yml"]
    path = f"'a.b/' || page_id || {pick(names, 'page_id')}"
    return f"SELECT page_id, {path} AS path, lower(regexp_extract({path}, '[^/](\\.[^./]*)$', 1)) IN ({', '.join(map(q, (*PROSE, *HTML, *CODE)))}) AS lintable FROM pages"


def _globs() -> str:
    path = f"'site/' || (page_id % 7) || '/p' || page_id || {pick(['.html', '.md', '.min.js'], 'page_id')}"
    columns = ", ".join(f"({' OR '.join(f'regexp_matches({path}, {q(glob_regex(g))})' for g in gs)}) AS {k}" for k, gs in GLOBS.items())
    return f"SELECT page_id, {columns} FROM pages"


REQUEST = "CASE WHEN doc_id % 11 = 0 THEN 'method_not_allowed' WHEN doc_id % 13 = 0 THEN 'not_found' ELSE ([NULL, 'invalid_json', 'invalid_body', 'missing_text', 'empty_text', 'invalid_threshold', 'unknown_rule', NULL])[doc_id % 8 + 1] END"
_PER = f"""{CORPORA}, tot AS (SELECT corpus, count(*) AS docs, sum(words) AS words FROM co GROUP BY corpus),
names(ordinal, category) AS (VALUES {', '.join(f'({i}, {q(c.id)})' for i, c in enumerate(CATEGORIES))}),
ph AS (SELECT corpus, category, sum(n) AS hits, count(*) AS with_hit FROM cat JOIN co USING (doc_id) GROUP BY corpus, category),
per AS (SELECT tot.corpus, names.ordinal, names.category, coalesce(hits, 0)::BIGINT AS hits, coalesce(with_hit, 0) AS with_hit, floor(100.0::DOUBLE * coalesce(with_hit, 0) / docs + 0.5::DOUBLE)::INT AS doc_pct,
  coalesce({fixed('coalesce(hits, 0) * 1000::DOUBLE / nullif(words, 0)', 2)}, 0) AS per1k FROM tot CROSS JOIN names LEFT JOIN ph ON ph.corpus = tot.corpus AND ph.category = names.category)"""


def _lift() -> str:
    def side(name, column):
        return f"coalesce(max({column}) FILTER (corpus = '{name}'), 0)"

    ratio = fixed("ai_per1k / nullif(human_per1k, 0)", 1)
    return f"""WITH {_PER}, w AS (SELECT category, {side('ai', 'doc_pct')} AS ai_doc_pct, {side('chat', 'doc_pct')} AS chat_doc_pct, {side('human', 'doc_pct')} AS human_doc_pct, {side('ai', 'per1k')} AS ai_per1k, {side('chat', 'per1k')} AS chat_per1k, {side('human', 'per1k')} AS human_per1k FROM per GROUP BY category)
SELECT category, ai_doc_pct, chat_doc_pct, human_doc_pct, ai_per1k, human_per1k, CASE WHEN human_per1k > 0 THEN {ratio} WHEN ai_per1k > 0 OR chat_per1k > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS lift FROM w"""


def _quantile(p: float) -> str:
    return f"list_sort(list(score))[least(count(*) - 1, floor(count(*) * {p}::DOUBLE))::BIGINT + 1]"


TOP = "t AS (SELECT doc_id, points, ordinal, category, tier, '' AS label, unnest(range(1, least(3, n) + 1)) AS i, surfaces FROM cat), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, ordinal, i) - 1 AS rank, category, tier AS severity, surfaces[i] AS match, label FROM t)"
_SAID = "ec AS (SELECT doc_id, string_agg(category || ':' || n || ':' || left(surfaces[1], 70), '|' ORDER BY points DESC, ordinal) AS categories FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, ordinal) AS o FROM cat) WHERE o <= 3 GROUP BY doc_id)"


def _escaped(x: str, prop: bool = False) -> str:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")) + (((":", "%3A"), (",", "%2C")) if prop else ()):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def _github() -> str:
    of = f"""'::' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=' || {_escaped("'docs/a:' || doc_id || '.md'", True)} || ',line=' || line || ',col=' || "column" || ',endColumn=' || "endColumn" || ',title=' || {_escaped('label', True)} || '::' || {_escaped(f"{MESSAGE} || ' [' || " + '"ruleId"' + " || '] — ' || help")}"""
    over = "'::error file=docs/a%3A' || doc_id || '.md,line=1,title=Score threshold::Document score ' || score || ' (' || band || ') is at or above the configured threshold.'"
    return f"{LINTED} SELECT 'docs/a:' || doc_id || '.md' AS path, {of} AS value FROM d UNION ALL SELECT 'docs/a:' || doc_id || '.md', {over} FROM lc WHERE score >= 25"


def _admitted(ip: str, limit: int, seconds: int) -> str:
    """Table w: one row for each event and whether a sliding log admits it, event after event."""
    return f"""WITH RECURSIVE e AS (SELECT {ip} AS ip, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {ip} ORDER BY ts) AS k FROM events),
w AS (SELECT ip, k, t, true AS ok, [t] AS held FROM e WHERE k = 1
  UNION ALL SELECT e.ip, e.k, e.t, len(list_filter(held, lambda x: x > e.t - {seconds * 1_000_000})) < {limit},
    CASE WHEN len(list_filter(held, lambda x: x > e.t - {seconds * 1_000_000})) < {limit} THEN list_append(list_filter(held, lambda x: x > e.t - {seconds * 1_000_000}), e.t) ELSE held END FROM w JOIN e ON e.ip = w.ip AND e.k = w.k + 1)"""


_SELF = ", ".join(f"({q(c.id)}, {q(p.id)}, {n}, {q(e)}, {q(dialect.re2(p.regex, p.flags))})" for c in CATEGORIES for p in c.patterns for n, e in enumerate(p.examples))
_UNION, _FLAGS = union_pattern(BY_ID["negative_parallelism"])
_UNION = dialect.re2(_UNION, _FLAGS)
_RESOLVED = expand_rules(USER_RULES)

ORACLES: dict[str, str] = {
    "word_count": f"WITH {views()} SELECT doc_id, {count('norm', WORD)} AS words FROM v",
    "normalize": f"WITH {views(before(planted.TYPOGRAPHY), False)} SELECT doc_id, sha256(norm) AS sha, {units('norm')} AS units FROM v",
    "mask_code": masked(planted.STRUCTURE, CODE_STEPS),
    "mask_front_matter": masked(planted.STRUCTURE, FRONT_STEPS),
    "mask_urls": masked(planted.STRUCTURE, URL_STEPS),
    "mask_tables": masked(planted.STRUCTURE, TABLE_STEPS),
    "extract_comments": masked(planted.STRUCTURE, [COMMENTS], True),
    "mask_html": f"WITH src AS (SELECT page_id, coalesce(html, '') AS html FROM pages), {steps('t', 'src', 'html', HTML_STEPS)[0]} SELECT page_id, sha256(html) AS sha, {count('html', WORD)} AS words FROM t3",
    "extract_prose": prose(),
    "is_lintable": _lintable(),
    "em_dash": metric(f"dashes AS total, spaced, {fixed('dashes * 1000.0::DOUBLE / greatest(raw_words, 1)', 2)} AS \"perThousand\", CASE WHEN dashes > 0 THEN {fixed('spaced::DOUBLE / nullif(dashes, 0)', 2)} ELSE 0 END AS \"spacedShare\", dash_flag AS flag"),
    "quotes": metric("curly, straight, mixed, mixed AS flag"),
    "burstiness": metric(f"len(s) AS sentences, CASE WHEN len(s) >= 5 THEN {fixed('s_mean', 1)} END AS \"meanLength\", CASE WHEN len(s) >= 5 THEN {fixed('s_cv', 3)} END AS cv, s_flag AS flag, CASE WHEN len(s) < 5 THEN 'too few sentences' END AS note"),
    "paragraphs": metric(f"len(p) AS paragraphs, CASE WHEN len(p) >= 3 THEN {fixed('p_mean', 1)} END AS \"meanLength\", CASE WHEN len(p) >= 3 THEN {fixed('p_cv', 3)} END AS cv, p_flag AS flag"),
    **{f"hits_{c.id}": hits(c.id) for c in CATEGORIES},
    "match_category": f"WITH {views(masking=False)} SELECT doc_id, {count('norm', _UNION)} AS n, {extract('norm', _UNION)}[1] AS first_match, length({gaps('norm', _UNION)}[1]) AS first_offset FROM v WHERE {count('norm', _UNION)} > 0",
    "category_points": f"WITH {views()}, {category_tables()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, ordinal) - 1 AS rank, category, n AS \"count\", n_distinct AS \"distinct\", points, {fixed(f'n * coalesce(1000::DOUBLE / nullif({count("norm", WORD)}, 0), 0)', 2)} AS \"per1000Words\" FROM cat JOIN v USING (doc_id)",
    "score": f"WITH {scores()} SELECT doc_id, words AS word_count, score, band FROM sc",
    "stream_score": f"WITH {scores()} SELECT doc_id, words AS word_count, score, band FROM sc",
    "score_only": f"WITH {scores(only=['ai_vocabulary', 'rule_of_three'])} SELECT doc_id, score, band FROM sc",
    "band": f"WITH {scores()} SELECT band, count(*) AS docs FROM sc GROUP BY band",
    "top_hits": f"WITH {views()}, {category_tables()}, {TOP} SELECT * EXCLUDE (label) FROM r WHERE rank < 20",
    "reports": f"""WITH {scores()}, {TOP}, rc AS (SELECT doc_id, string_agg(category || ':' || n || ':' || n_distinct || ':' || points, ',' ORDER BY points DESC, ordinal) AS categories FROM cat GROUP BY doc_id),
rt AS (SELECT doc_id, string_agg(category || ':' || severity || ':' || match, '|' ORDER BY rank) AS top FROM r WHERE rank < 20 GROUP BY doc_id)
SELECT nullif(doc_id - doc_id % 3, 0) AS doc_id, score, band, words AS "wordCount", coalesce(categories, '') AS categories, sha256(coalesce(top, '')) AS top_sha FROM sc LEFT JOIN rc USING (doc_id) LEFT JOIN rt USING (doc_id)""",
    "severity_resolve": f"SELECT * FROM (VALUES {', '.join(f'({q(c.id)}, {q(c.tier)}, {q(_RESOLVED[c.id])})' for c in CATEGORIES)}) t(category, tier, severity)",
    "positions": f"WITH {views()}, {placed()} SELECT {FINDING} FROM f",
    "max_hits": f"WITH {views()}, {placed(1)} SELECT {FINDING} FROM f",
    "findings": f"WITH RECURSIVE {views()}, {placed()}, {DEDUPED} SELECT {FINDING} FROM d",
    "lint_counts": f'{LINTED} SELECT doc_id, score, errors AS "errorCount", warnings AS "warningCount", score >= 15 AS "thresholdExceeded" FROM lc',
    "summarize": f'{LINTED} SELECT count(*) AS "fileCount", sum(errors)::BIGINT AS "errorCount", sum(warnings)::BIGINT AS "warningCount", count(*) FILTER (score >= 25) AS over, 10 AS "maxWarnings", sum(errors) > 0 OR count(*) FILTER (score >= 25) > 0 OR sum(warnings) > 10 AS failed FROM lc',
    "quiet": f"{LINTED} SELECT sum(errors)::BIGINT AS findings, sum(errors)::BIGINT AS errors, 0 AS warnings FROM lc",
    "rules_list": f"SELECT * FROM (VALUES {', '.join(f'({q(c.id)}, {q(c.label)}, {q(c.tier)}, {q(TIER_SEVERITY[c.tier])}, {q(",".join(p.id for p in c.patterns))})' for c in CATEGORIES)}) t(id, label, tier, \"defaultSeverity\", patterns)",
    "pattern_index": f"SELECT * FROM (VALUES {', '.join(f'({q(c.id + "." + p.id)}, {q(p.flags)}, {q(p.vendor)}, {q(p.era)}, {len(p.examples)})' for c in CATEGORIES for p in c.patterns)}) t(key, flags, vendor, era, examples)",
    "health": "SELECT 'ok' AS status, 20 AS categories, 95 AS patterns",
    "self_test": f"SELECT category, pattern, n, example, regexp_matches(example, {'regex'}) AS matched FROM (VALUES {_SELF}) t(category, pattern, n, example, regex)",
    "quantiles": f"WITH {CORPORA} SELECT corpus, count(*) AS n, {fixed('sum(score)::DOUBLE / count(*)', 1)} AS mean, {_quantile(0.5)} AS median, min(score) AS min, max(score) AS max, {_quantile(0.25)} AS p25, {_quantile(0.75)} AS p75 FROM co GROUP BY corpus",
    "threshold_sweep": f"WITH {scores()}, l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id), t(threshold) AS (VALUES {', '.join(f'({t})' for t in SWEPT)}), r AS (SELECT threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0 AND score >= threshold) AS fp, count(*) FILTER (quality = 0) AS negatives FROM sc JOIN l USING (doc_id) CROSS JOIN t GROUP BY threshold) SELECT *, floor(100.0::DOUBLE * tp / nullif(positives, 0) + 0.5::DOUBLE)::INT AS recall, floor(100.0::DOUBLE * fp / nullif(negatives, 0) + 0.5::DOUBLE)::INT AS fpr, floor(100.0::DOUBLE * tp / nullif(tp + fp, 0) + 0.5::DOUBLE)::INT AS precision FROM r",
    "category_density": f"WITH {_PER} SELECT corpus, category, hits, with_hit, doc_pct, per1k FROM per",
    "category_lift": _lift(),
    "top_false_positives": f"WITH {CORPORA}, {_SAID} SELECT doc_id, score, words AS word_count, coalesce(categories, '') AS categories FROM co LEFT JOIN ec USING (doc_id) WHERE corpus = 'human' ORDER BY score DESC, doc_id LIMIT 5",
    "bottom_misses": f"WITH {CORPORA}, {_SAID} SELECT doc_id, score, words AS word_count, coalesce(categories, '') AS categories FROM co LEFT JOIN ec USING (doc_id) WHERE corpus = 'ai' ORDER BY score, doc_id LIMIT 5",
    "typography": f"WITH {views(before(planted.TYPOGRAPHY))}, {METRICS} SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS corpus, {fixed('sum(dashes) * 1000::DOUBLE / nullif(sum(words), 0)', 2)} AS em_dashes, round({fixed(f'avg(CASE WHEN len(s) >= 5 THEN {fixed("s_cv", 3)} END)', 3)}, 2) AS mean_cv FROM m GROUP BY 1",
    "glob_match": _globs(),
    "clean_wikitext": wiki(),
    "api_codes": f"SELECT doc_id AS request_id, {REQUEST} AS code, CASE {REQUEST} WHEN 'method_not_allowed' THEN 405 WHEN 'not_found' THEN 404 ELSE CASE WHEN {REQUEST} IS NULL THEN 200 ELSE 400 END END AS status FROM documents",
    "api_score": f"WITH {scores(cut=False, zero=1.6)} SELECT doc_id AS request_id, score, band, words FROM sc WHERE {REQUEST} IS NULL",
    "api_score_all": f"WITH {scores(cut=False, zero=1.6)} SELECT doc_id AS request_id, 200 AS status, score, band, words FROM sc",
    "report_json": f"""{LINTED}, one AS (SELECT doc_id, "ruleId" AS rule, line, {MESSAGE} AS message, row_number() OVER (PARTITION BY doc_id ORDER BY line, "column", "ruleId", rank) AS o FROM d)
SELECT 'docs/a:' || lc.doc_id || '.md' AS path, score, band, words, errors, warnings, score >= 25 AS over, errors + warnings AS findings, rule, line, message FROM lc LEFT JOIN one ON one.doc_id = lc.doc_id AND o = 1""",
    "report_github": _github(),
    "report_sarif": f"""{LINTED} SELECT 'docs/a:' || doc_id || '.md' AS path, category, CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END AS level, {MESSAGE} || ' — ' || help AS message, line, "column", "endColumn", match, tier, string_split("ruleId", '/')[2] AS pattern, score FROM d JOIN lc USING (doc_id)""",
    "rate_limit": f"{_admitted('user_id::VARCHAR', 3, 86_400)} SELECT ip, count(*) AS requests, count(*) FILTER (ok) AS admitted, max(t) FILTER (NOT ok) AS last_refused FROM w GROUP BY ip",
    "rate_limit_default": f"{_admitted('event_type', 120, 60)} SELECT ip, count(*) AS requests, count(*) FILTER (ok) AS admitted FROM w GROUP BY ip",
    "api_get": "SELECT * FROM (VALUES (0, 200, NULL, NULL, NULL, NULL), (1, 200, 'ok', 20, 95, NULL), (2, 200, 'ok', 20, 95, NULL), (3, 200, NULL, NULL, NULL, 20), (4, 200, NULL, NULL, NULL, NULL), (5, 404, NULL, NULL, NULL, NULL)) t(request_id, code, status, categories, patterns, rules)",
    "over_threshold": f"""{LINTED} SELECT doc_id::VARCHAR AS "filePath", score FROM lc WHERE score >= 25""",
    "report_pretty": f"{LINTED} SELECT 'docs/a:' || doc_id || '.md' AS path, 1 + errors + warnings + CASE WHEN score >= 25 THEN 1 ELSE 0 END AS lines FROM lc WHERE errors + warnings > 0 OR score >= 25",
}
