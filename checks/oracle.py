"""The registered queries in DuckDB SQL.

Written apart from the library: plain joins over all pairs, recursion-free
steps, no pruning.  Only fixed values (stop lists, stem tables, fixtures) and
the token pattern are shared.
"""

from __future__ import annotations

from newsloom.functions import lexicon, stems
from newsloom.functions.text import CHUNK_PATTERN, TOKEN_PATTERN

from . import fixtures


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def words_list(values) -> str:
    return "NULL::VARCHAR[]" if values is None else "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


TOKEN, CHUNK = q(TOKEN_PATTERN), q(CHUNK_PATTERN)


# --- stop lists ---------------------------------------------------------------------

def _base(language: str) -> list[str]:
    return list(lexicon.base_words(language))


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows)


def lists() -> str:
    base = [(q(n), q(w)) for n in lexicon.LANGUAGES for w in dict.fromkeys(_base(n))]
    french = set(_base("french")) | set(lexicon.FRENCH_EXTRA) | set(lexicon.PUNCTUATION)
    english = set(_base("english")) | set(lexicon.ENGLISH_EXTRA) | set(lexicon.PUNCTUATION)
    other = french | english | set(lexicon.MEASURES)
    stops = [(q(n), q(w)) for n, ws in (("french", french), ("english", english), ("other", other))
             for w in sorted(ws)]
    return (f"base(language, word) AS ({_values(base)}),\n"
            f"stops(language, word) AS ({_values(stops)})")


ARTICLES = """articles AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, lang, source AS service, text,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 30 MINUTE AS published,
         'https://' || source || '.example.com/' || lang || '/' || doc_id AS link
  FROM documents)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- text chain ----------------------------------------------------------------------

def detect(src: str, body: str, name: str = "lng") -> str:
    """(id, language) of every row of ``src``."""
    return f"""{name}_w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower({body}), {TOKEN}, 1)) AS token
  FROM {src}),
{name}_h AS (SELECT w.id, b.language, count(*) AS hits
  FROM {name}_w w JOIN base b ON b.word = w.token GROUP BY ALL),
{name} AS (SELECT s.id, h.language FROM {src} s LEFT JOIN (
  SELECT id, language FROM {name}_h
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, language) = 1) h ON h.id = s.id)"""


ROUTE = "CASE WHEN {l}.language IN ('french', 'english') THEN {l}.language ELSE 'other' END"


def kept_tokens(src: str, body: str, lng: str = "lng", name: str = "kept") -> str:
    """(id, language, pos, token) without stop words."""
    return f"""{name}_t AS (SELECT id, regexp_extract_all({body}, {TOKEN}, 1) AS toks FROM {src}),
{name}_u AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM {name}_t),
{name} AS (SELECT u.id, l.language, u.pos, u.token FROM {name}_u u JOIN {lng} l ON l.id = u.id
  ANTI JOIN stops s ON s.word = lower(u.token) AND s.language = {ROUTE.format(l='l')})"""


class DuckDialect:
    @staticmethod
    def like(value, pattern):
        return f"regexp_matches({value}, '{pattern}')"

    @staticmethod
    def sub(value, pattern, template):
        template = template.replace("$", "\\")
        return f"regexp_replace({value}, '{pattern}', '{template}', 'g')"

    @staticmethod
    def found(value, pattern):
        return f"regexp_extract({value}, '{pattern}', 1)"

    @staticmethod
    def table(key, rows):
        return "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rows.items()) + " END"


def stem_table(src: str, name: str = "stemmed") -> str:
    """(fr, token, stem) of the distinct (fr, token) of ``src``."""
    parts = [f"{name}_v AS (SELECT DISTINCT language IS NOT DISTINCT FROM 'french' AS fr, token FROM {src})"]
    for fr, stages in (("e", stems.english_stages(DuckDialect)), ("f", stems.french_stages(DuckDialect))):
        keep = "fr" if fr == "f" else "NOT fr"
        prev, fields = f"{name}_{fr}", ["raw"]
        parts.append(f"{prev} AS (SELECT fr, token, lower(token) AS raw FROM {name}_v WHERE {keep})")
        for i, stage in enumerate(stages):
            over = [f"({e}) AS {n}" for n, e in stage.items() if n in fields]
            new = [f"({e}) AS {n}" for n, e in stage.items() if n not in fields]
            cols = "*" + (f" REPLACE ({', '.join(over)})" if over else "")
            parts.append(f"{name}_{fr}{i} AS (SELECT {', '.join([cols] + new)} FROM {prev})")
            prev = f"{name}_{fr}{i}"
            fields = list(dict.fromkeys(fields + list(stage)))
        parts.append(f"{name}_{fr}z AS (SELECT fr, token, w AS stem FROM {prev})")
    parts.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_ez UNION ALL SELECT * FROM {name}_fz)")
    return ",\n".join(parts)


def terms(src: str, body: str, name: str = "tf") -> str:
    """(id, term, tf) as the vectoriser sees a text."""
    return ",\n".join([
        f"low AS (SELECT id, lower({body}) AS t FROM {src})",
        detect("low", "t"), kept_tokens("low", "t"), stem_table("kept"),
        f"""{name} AS MATERIALIZED (SELECT k.id, s.stem AS term, count(*) AS tf
  FROM kept k JOIN stemmed s ON s.token = k.token AND s.fr = (k.language IS NOT DISTINCT FROM 'french')
  ANTI JOIN stops x ON x.word = s.stem AND x.language = 'other'
  GROUP BY ALL)"""])


VECTORS = """n AS (SELECT count(*) AS n FROM articles),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT id, term, df, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w
  FROM tf JOIN df USING (term), n),
x AS MATERIALIZED (SELECT id, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""

BEST = """best AS (SELECT a.id, b.id AS match_id, sum(a.w * b.w) AS score
  FROM x a JOIN x b ON a.term = b.term AND b.id < a.id GROUP BY a.id, b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(sum(a.w * b.w), 9) DESC, b.id) = 1),
verdict AS (SELECT a.id, m.match_id, round(coalesce(m.score, 0.0), 2) AS similarity,
    coalesce(t.title, '') AS similarity_with, round(coalesce(m.score, 0.0), 2) >= 0.4 AS is_duplicate
  FROM articles a LEFT JOIN best m ON m.id = a.id LEFT JOIN articles t ON t.id = m.match_id)"""


def doc_rules() -> str:
    rows = [(q(r["service"]), q(r["lang"]), q(r["mention"]), words_list(r["tags"]),
             words_list(r["title_patterns"]), words_list(r["title_blocks"]), words_list(r["url_blocks"]))
            for r in fixtures.document_rules()]
    return ("rules(service, lang, mention, tags, title_patterns, title_blocks, url_blocks) AS ("
            + _values(rows) + ")")


CLEAN_TITLE = ("CASE WHEN r.title_patterns IS NULL THEN a.title ELSE list_reduce(r.title_patterns, "
               "lambda t, p: regexp_replace(t, p, '', 'g'), a.title) END")
RULED = f"""ruled AS (SELECT a.* REPLACE ({CLEAN_TITLE} AS title), a.title AS first_title,
    r.mention, r.tags AS rule_tags, r.title_patterns, r.title_blocks, r.url_blocks
  FROM articles a LEFT JOIN rules r ON r.service = a.service AND r.lang = a.lang)"""
BLOCKED = ("len(list_filter(coalesce(title_blocks, []::VARCHAR[]), "
           "lambda b: contains(lower({t}), lower(b)))) > 0")
URL_BLOCKED = "len(list_filter(coalesce(url_blocks, []::VARCHAR[]), lambda b: contains(link, b))) > 0"


def judged() -> str:
    """articles (with cleaned titles) and their verdict: the watcher run."""
    return ",\n".join([
        ARTICLES.replace("articles AS", "articles0 AS", 1), doc_rules(),
        RULED.replace("FROM articles a", "FROM articles0 a"),
        "articles AS MATERIALIZED (SELECT * FROM ruled)", lists(), terms("articles", "title"), VECTORS, BEST,
        f"""judged AS MATERIALIZED (SELECT a.*, v.match_id, v.similarity, v.similarity_with, v.is_duplicate,
    {BLOCKED.format(t='title')} AS by_title, {URL_BLOCKED} AS by_url
  FROM articles a JOIN verdict v USING (id))"""])


# --- pages -----------------------------------------------------------------------------

CANONICAL = r"regexp_replace(regexp_replace(url, '\?[^?]*$', ''), '#[^#]*$', '')"
HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PAGE_LANG = """regexp_extract(html, '<html lang="([a-z]*)"', 1)"""


def key_of(u: str) -> str:
    path = rf"regexp_replace({u}, '^[a-z]+://[^/?#]*/', '')"
    return f"trim(replace({path}, '/', '-'), '-') || '.txt'"


INLINE = ("a|abbr|b|bdi|bdo|big|br|cite|code|data|del|dfn|em|font|i|img|ins|kbd|label|mark|q|s|samp|"
          "small|span|strong|sub|sup|time|tt|u|var|wbr")
VISIBLE = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"


def decode(e: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                 ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"regexp_replace({e}, '&amp;?', '&', 'g')"


def strip_tags(e: str) -> str:
    return decode(f"regexp_replace({e}, '<[^>]*>', '', 'g')")


def inner(tag: str) -> str:
    return rf"regexp_extract({VISIBLE}, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1)"


def section_list(inside: str, section: str) -> str:
    inline = "|".join(t for t in INLINE.split("|") if t != section)
    found = rf"regexp_extract_all({inside}, '(?is)<{section}\b[^>]*>([^<]*(?:</?(?:{inline})\b[^>]*>[^<]*)*)', 1)"
    return f"list_transform({found}, lambda s: {strip_tags('s')})"


def _quoted(name: str) -> str:
    return decode(rf"regexp_extract(piece, '(?i)^<[^>]*\b{name}\s*=\s*[\x22'']([^\x22'']*)[\x22'']', 1)")


# Every tag of a page, the end tag of each start tag by counting along its name, and the closed elements around it.
ELEMENTS = (rf"""pieces AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS place
  FROM (SELECT page_id, regexp_extract_all({VISIBLE}, '<[^<]*|^[^<]+') AS ps FROM pages))""",
            r"""tags AS (SELECT *, lower(regexp_extract(piece, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag,
  CASE WHEN piece LIKE '</%' THEN -1 WHEN regexp_matches(piece, '^<[a-zA-Z]') AND NOT regexp_matches(piece,
    '(?i)^<(area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b') THEN 1 ELSE 0 END AS step FROM pieces)""",
            """levels AS (SELECT *, CASE WHEN step < 0 THEN 1 ELSE 0 END
    + sum(step) OVER (PARTITION BY page_id, tag ORDER BY place) AS level FROM tags WHERE step <> 0)""",
            """pairs AS (SELECT page_id, place, stop FROM (SELECT *,
    lead(place) OVER w AS stop, lead(step) OVER w AS next FROM levels
    WINDOW w AS (PARTITION BY page_id, tag, level ORDER BY place)) WHERE step > 0 AND next < 0)""",
            """bounds AS (SELECT page_id, place, 1 AS s FROM pairs UNION ALL SELECT page_id, stop, -1 FROM pairs)""",
            rf"""elements AS (SELECT t.page_id, t.place, coalesce(p.stop, -1) AS stop, tag,
    CAST(coalesce((SELECT sum(s) FROM bounds b WHERE b.page_id = t.page_id AND b.place < t.place), 0) AS BIGINT) AS depth,
    trim(regexp_replace({_quoted('class')}, '\s+', ' ', 'g')) AS classes,
    {_quoted('href')} AS href,
    regexp_matches(piece, '(?i)^<[^>]*href\s*=') AS linked, {strip_tags('piece')} AS text
    FROM tags t LEFT JOIN pairs p ON p.page_id = t.page_id AND p.place = t.place
    WHERE regexp_matches(piece, '^<[a-zA-Z][^>]*>'))""")


def sanitised(e: str, markers) -> str:
    hit = " OR ".join(f"contains({e}, {q(m)})" for m in markers)
    return rf"CASE WHEN {hit} THEN '' ELSE replace({e}, '\r', '') END"


PARAGRAPHS = (f"paras AS (SELECT page_id, list_transform({section_list(inner('article'), 'p')}, "
              f"lambda p: {sanitised('p', fixtures.PARAGRAPH_MARKERS)}) AS ps FROM pages)")
PAGE_TEXT = "coalesce(array_to_string(ps, ''), '')"
PAGE_RAW = ("coalesce(array_to_string(list_transform(list_filter(ps, lambda p: p <> ''), "
            "lambda p: '<p>' || p || '</p>'), ''), '')")
LINKS = f"links AS (SELECT page_id, url, html, {section_list(inner('nav'), 'a')} AS links FROM pages)"
CLEAN_TAG = "replace(replace(replace(lower(s), '-', ''), ' ', ''), '...', '')"
PAGE_TAGS = (f"array_to_string(list_filter(list_transform(links, lambda s: {CLEAN_TAG}), "
             "lambda s: s <> ''), ' ')")
HREF = rf"""{decode("regexp_extract(" + inner('nav') + r''', '(?is)<a\b[^>]*\bhref="([^"]*)"', 1)''')}"""
AD = rf"""regexp_extract({VISIBLE}, '(?is)<div class="ad"[^>]*>(.*?)</div>', 1)"""
HAS_AD = rf"""regexp_matches({VISIBLE}, '(?is)<div class="ad"[^>]*>.*?</div>')"""


def page_rules() -> str:
    rows = [(q(r["service"]), q(r["lang"]), words_list(r["url_selects"]), words_list(r["label_selects"]))
            for r in fixtures.page_rules()]
    return "prules(service, lang, url_selects, label_selects) AS (" + _values(rows) + ")"


def watched_rules() -> str:
    rows = [(q(r["service"]), q(r["lang"]), *[words_list(r[c]) for c in (
        "tags", "title_patterns", "title_blocks", "url_blocks", "url_selects", "label_selects")],
        words_list([t for _, _, t in r["content_blocks"][:1]]), str(bool(r["element_blocks"])))
        for r in fixtures.watched_rules()]
    return ("rules(service, lang, rule_tags, title_patterns, title_blocks, url_blocks, url_selects, "
            "label_selects, ad_words, no_ads) AS (" + _values(rows) + ")")


def watched(part: str = "true") -> str:
    """The run over pages: first unseen entries of watched sources, judged and read.

    ``part`` names the pages of the run by their id.
    """
    title = strip_tags("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")
    picture = HREF
    return ",\n".join([
        KEYED, watched_rules(), PARAGRAPHS, LINKS, lists(),
        f"""fresh AS (SELECT * FROM keyed ANTI JOIN seen USING (lang, feed_host, entry_key)
  WHERE {part.replace('id', 'page_id')}
  QUALIFY row_number() OVER (PARTITION BY lang, feed_host, entry_key ORDER BY page_id) = 1)""",
        f"""entries AS (SELECT f.page_id AS id, f.link, f.url, f.lang, f.feed_host, f.entry_key, regexp_extract({HOST.replace('url', 'f.url')},
    '([^.]+[.][^.]+)$', 1) AS service, {title} AS title, {PAGE_TEXT} AS text, {PAGE_RAW} AS raw, l.links,
    {picture} AS href, {HAS_AD} AS has_ad, lower({strip_tags(AD)}) AS ad
  FROM fresh f JOIN pages p ON p.page_id = f.page_id JOIN paras ON paras.page_id = f.page_id
  JOIN links l ON l.page_id = f.page_id)""".replace(VISIBLE, VISIBLE.replace("html", "p.html")).replace(
            "regexp_extract(html,", "regexp_extract(p.html,"),
        f"""articles AS MATERIALIZED (SELECT a.* REPLACE ({CLEAN_TITLE} AS title), r.* EXCLUDE (service, lang)
  FROM entries a JOIN rules r ON r.service = a.service AND r.lang = a.lang)""",
        terms("articles", "title"), VECTORS, BEST,
        f"""judged AS MATERIALIZED (SELECT a.*, v.match_id, v.similarity, list_filter([
    CASE WHEN len(url_selects) + len(label_selects) > 0
      AND NOT len(list_filter(url_selects, lambda u: contains(a.url, u))) > 0
      AND NOT list_has_any(links, label_selects) THEN 'selection' END,
    CASE WHEN has_ad AND len(list_filter(ad_words, lambda w: contains(ad, w))) > 0 THEN 'content' END,
    CASE WHEN has_ad AND no_ads THEN 'element' END,
    CASE WHEN {BLOCKED.format(t='a.title')} THEN 'title' END, CASE WHEN {URL_BLOCKED} THEN 'url' END,
    CASE WHEN is_duplicate THEN 'duplicate' END], lambda x: x IS NOT NULL) AS reasons
  FROM articles a JOIN verdict v USING (id))""",
        "good AS (SELECT id, text FROM judged WHERE len(reasons) = 0)", tags_of("good")])


KEYED = (f"keyed AS (SELECT page_id, url, {PAGE_LANG} AS lang, {HOST} AS feed_host, "
         f"{key_of(CANONICAL)} AS entry_key, {CANONICAL} AS link FROM pages),\n"
         "seen AS (SELECT DISTINCT lang, feed_host, entry_key FROM keyed WHERE url LIKE 'http://%')")


# --- inside one text ---------------------------------------------------------------------

def fold(e: str) -> str:
    e = rf"regexp_replace({e}, '[^\p{{L}}\p{{N}}]', '', 'g')"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"),
                 ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"lower(strip_accents({e}))"


def tags_of(src: str, fold_first: bool = True, name: str = "toptags") -> str:
    """(id, tags list) from (id, text) rows."""
    head = [detect(src, "text", "tlng"), kept_tokens(src, "text", "tlng", "tkept")]
    if fold_first:
        head.append(f"""{name}_c AS (SELECT id, tag, count(*) AS tf, min(pos) AS p
  FROM (SELECT id, {fold('token')} AS tag, pos FROM tkept) WHERE tag <> '' GROUP BY id, tag)""")
    else:
        head.append(f"""{name}_c AS (SELECT id, {fold('token')} AS tag, tf, p FROM (
  SELECT id, token, count(*) AS tf, min(pos) AS p FROM tkept GROUP BY ALL))""")
    head.append(f"""{name} AS (SELECT id, list(tag ORDER BY r) FILTER (tag <> '') AS tags FROM (
  SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY tf DESC, p) AS r FROM {name}_c)
  WHERE r <= 10 GROUP BY id HAVING count(*) FILTER (tag <> '') > 0)""")
    return ",\n".join(head)


DOCS = "docs AS (SELECT doc_id AS id, text, lang, source AS service FROM documents)"
SPACED = (r"""regexp_replace(regexp_replace(text, '([.,()''’?!:])', ' \1 ', 'g'), """
          r"""'([;@#$%&"\[\]{}<>])', ' \1 ', 'g')""")


def spaced_words(src: str) -> str:
    return ",\n".join([
        detect(src, "text"),
        f"""sp AS (SELECT d.id, l.language, regexp_extract_all({SPACED}, {CHUNK}, 1) AS toks
  FROM {src} d JOIN lng l ON l.id = d.id WHERE l.language IN ('french', 'english'))""",
        """spw AS (SELECT id, language, len(toks) AS n, lower(unnest(toks)) AS word,
    generate_subscripts(toks, 1) - 1 AS pos FROM sp)""",
        f"""spk AS (SELECT w.* FROM spw w ANTI JOIN stops s ON s.word = w.word AND s.language = w.language
  WHERE w.word NOT IN ({', '.join(q(m) for m in lexicon.MEASURES)}))""",
        """freq AS (SELECT id, language, n, word, count(*) AS tf, min(pos) AS p FROM spk GROUP BY ALL
  HAVING count(*) >= 1 + n / 100)"""])


MAIN_WORDS = ("mainwords AS (SELECT id, language, string_agg(word, ' ' ORDER BY p) AS words "
              "FROM freq GROUP BY id, language)")


def summaries(src: str, steps: int = 40) -> str:
    """(id, summary): sentence graph over all sentence pairs, ``steps`` frozen power steps."""
    parts = [
        detect(src, "text", "slng"),
        f"""cut AS (SELECT d.id, l.language, list_filter(list_transform(
    regexp_extract_all(d.text, '([^.!?\\n]+[.!?]*)', 1), lambda x: trim(x)), lambda x: x <> '') AS ss
  FROM {src} d JOIN slng l ON l.id = d.id)""",
        """sent AS MATERIALIZED (SELECT id, language, unnest(ss) AS sentence,
    generate_subscripts(ss, 1) - 1 AS s, len(ss) AS n FROM cut)""",
        f"""sw AS (SELECT id, s, language, n, unnest(regexp_extract_all(lower(sentence), {TOKEN}, 1)) AS token
  FROM sent)""",
        f"""skept AS MATERIALIZED (SELECT w.* FROM sw w ANTI JOIN stops x ON x.word = w.token
  AND x.language = {ROUTE.format(l='w')} WHERE regexp_matches(w.token, '^\\p{{L}}+$'))""",
        stem_table("skept", "sst"),
        """stf AS (SELECT k.id, k.s, k.n, t.stem AS term, count(*) AS c FROM skept k JOIN sst t
  ON t.token = k.token AND t.fr = (k.language IS NOT DISTINCT FROM 'french') GROUP BY ALL)""",
        """sx0 AS (SELECT id, s, term, c / max(c) OVER (PARTITION BY id, s)
    * ln(n / (1.0 + count(*) OVER (PARTITION BY id, term))) AS w FROM stf)""",
        """sx AS MATERIALIZED (SELECT id, s, term, w / sqrt(sum(w * w) OVER (PARTITION BY id, s)) AS w
  FROM sx0 QUALIFY sum(w * w) OVER (PARTITION BY id, s) > 0)""",
        """edge AS MATERIALIZED (SELECT id, a, b, count(*) OVER (PARTITION BY id, a) AS degree FROM (
  SELECT x.id, x.s AS a, y.s AS b FROM sx x JOIN sx y ON y.id = x.id AND y.term = x.term
  GROUP BY ALL HAVING round(sum(x.w * y.w), 9) > 0.1 OR x.s = y.s))""",
        "p0 AS MATERIALIZED (SELECT id, s, 1.0::DOUBLE / n AS p, false AS done FROM sent)",
    ]
    for k in range(1, steps + 1):
        parts.append(f"""p{k} AS MATERIALIZED (SELECT o.id, o.s,
    CASE WHEN o.done THEN o.p ELSE coalesce(m.p, 0.0) END AS p,
    o.done OR round(sqrt(sum((coalesce(m.p, 0.0) - o.p) ^ 2) OVER (PARTITION BY o.id)), 9) < 0.1 AS done
  FROM p{k - 1} o LEFT JOIN (SELECT e.id, e.b AS s, sum(p.p / e.degree) AS p
    FROM edge e JOIN p{k - 1} p ON p.id = e.id AND p.s = e.a GROUP BY ALL) m
  ON m.id = o.id AND m.s = o.s)""")
    parts.append(f"""summaries AS (SELECT id, string_agg(sentence, '' ORDER BY s) AS summary FROM (
  SELECT t.id, t.s, t.sentence FROM sent t JOIN p{steps} p ON p.id = t.id AND p.s = t.s
  QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY round(p.p, 6) DESC, t.s) <= 3) GROUP BY id)""")
    return ",\n".join(parts)


def asof(window: int) -> str:
    return f"""pos AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM articles),
tp AS MATERIALIZED (SELECT t.id, p.pos, t.term, t.tf,
    count(*) OVER (PARTITION BY t.term ORDER BY p.pos) AS df FROM tf t JOIN pos p USING (id)),
span AS (SELECT term, pos AS a, coalesce(lead(pos) OVER (PARTITION BY term ORDER BY pos), 9e15) AS z, df
  FROM tp),
pr AS (SELECT DISTINCT i.pos AS i, j.pos AS j FROM tp i JOIN tp j ON j.term = i.term
  AND j.pos BETWEEN i.pos - {window} AND i.pos - 1),
jw AS (SELECT p.i, p.j, t.term, t.tf * (ln((2.0 + p.i) / (1.0 + s.df)) + 1.0) AS w
  FROM pr p JOIN tp t ON t.pos = p.j JOIN span s ON s.term = t.term AND p.i >= s.a AND p.i < s.z),
iw AS (SELECT pos AS i, term, tf * (ln((2.0 + pos) / (1.0 + df)) + 1.0) AS w FROM tp),
inorm AS (SELECT i, sqrt(sum(w * w)) AS m FROM iw GROUP BY i),
cosine AS (SELECT jw.i, jw.j, sum(jw.w * coalesce(iw.w, 0.0)) / (sqrt(sum(jw.w * jw.w)) * any_value(m)) AS c
  FROM jw LEFT JOIN iw ON iw.i = jw.i AND iw.term = jw.term JOIN inorm ON inorm.i = jw.i GROUP BY jw.i, jw.j),
top AS (SELECT i, j, c FROM cosine
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(c, 9) DESC, j) = 1)
SELECT pi.id, coalesce(pj.id, -1) AS match_id, round(coalesce(c, 0.0), 6) AS score
FROM pos pi LEFT JOIN top ON top.i = pi.pos LEFT JOIN pos pj ON pj.pos = top.j"""


def buffer(size: int) -> str:
    return f"""pos AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM articles),
tp AS (SELECT t.*, p.pos FROM tf t JOIN pos p USING (id)),
held AS (SELECT w.pos AS win, t.id, t.pos, t.term, t.tf * (ln((1.0 + {size + 1}) / (1.0 + count(*) OVER (
    PARTITION BY w.pos, t.term))) + 1.0) AS w
  FROM pos w JOIN tp t ON t.pos BETWEEN w.pos - {size} AND w.pos),
unit AS (SELECT win, id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY win, pos)) AS w FROM held),
top AS (SELECT a.win, b.id AS match_id, sum(a.w * b.w) AS c FROM unit a JOIN unit b
  ON b.win = a.win AND b.term = a.term AND a.pos = a.win AND b.pos < a.win GROUP BY a.win, b.id
  QUALIFY row_number() OVER (PARTITION BY a.win ORDER BY round(sum(a.w * b.w), 9) DESC, b.id) = 1)
SELECT p.id, coalesce(match_id, -1) AS match_id, round(coalesce(c, 0.0), 6) AS score FROM pos p LEFT JOIN top ON top.win = p.pos"""


def batch(b: str, corpus: str) -> str:
    """Verdicts of the late rows of a batch; its corpus sets the document frequencies."""
    return f"""{b}_c AS MATERIALIZED (SELECT id, late, row_number() OVER (ORDER BY late, id) AS place FROM ({corpus})),
{b}_r AS (SELECT id, place, term, tf * (ln((1.0 + (SELECT count(*) FROM {b}_c))
    / (1.0 + count(*) OVER (PARTITION BY term))) + 1.0) AS w FROM {b}_c JOIN tf USING (id)),
{b}_x AS MATERIALIZED (SELECT id, place, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {b}_r),
{b}_m AS (SELECT p.id, q.id AS match_id, sum(p.w * q.w) AS score
  FROM {b}_x p JOIN {b}_x q ON q.term = p.term AND q.place < p.place GROUP BY p.id, q.id, q.place
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round(sum(p.w * q.w), 9) DESC, q.place) = 1),
{b}_told AS MATERIALIZED (SELECT c.id, coalesce(m.match_id, -1) AS match_id, round(coalesce(m.score, 0.0), 2) AS similarity,
    round(coalesce(m.score, 0.0), 2) >= 0.4 AS is_duplicate
  FROM {b}_c c LEFT JOIN {b}_m m ON m.id = c.id WHERE late = 1)"""


MLT = f"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), {TOKEN}, 1)) AS term FROM documents),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT id, sum(tf) AS len FROM tf GROUP BY id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) * 1.0
    / (SELECT count(*) FROM documents) AS avg),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id,
    unnest(regexp_extract_all(lower(text), {TOKEN}, 1)) AS term FROM benchmark) GROUP BY ALL),
qi AS (SELECT query_id, term, qtf, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf FROM qt JOIN df USING (term), st
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(qtf * idf, 9) DESC, term) <= 70),
qn AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY query_id) * 0.3 + 1e-9), 1) AS need FROM qi),
sc AS (SELECT q.query_id, t.id, count(*) AS hits, any_value(need) AS need,
    sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score
  FROM qn q JOIN tf t USING (term) JOIN len l ON l.id = t.id, st GROUP BY q.query_id, t.id),
top AS (SELECT query_id, id, score FROM sc WHERE hits >= need
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) = 1)
SELECT item_id AS query_id, t.id IS NOT NULL AS found, coalesce(t.id, -1) AS match_id,
  round(coalesce(t.score, 0.0), 6) AS score
FROM benchmark b LEFT JOIN top t ON t.query_id = b.item_id"""


DAY = "strftime(DATE '2024-01-01' + (id // 48)::INTEGER, '%Y-%m-%d')"


def all_sql() -> dict[str, str]:
    A, L, R = ARTICLES, lists(), doc_rules()
    sql: dict[str, str] = {}
    sql["titles"] = with_(A) + "SELECT id, title FROM articles"
    sql["titles_union"] = with_(A) + """SELECT id, title FROM articles WHERE published < '2024-01-10'
UNION ALL SELECT id, title FROM articles WHERE published >= '2024-01-10'"""
    sql["url_canonical"] = f"SELECT page_id, {CANONICAL} AS link FROM pages"
    sql["entry_key"] = (f"SELECT page_id, split_part(url, ':', 1) AS scheme, {HOST} AS feed_host, "
                        f"{key_of(CANONICAL)} AS entry_key, {key_of('url')} AS raw_key FROM pages")
    sql["title_sanitize"] = with_(A, R, RULED) + "SELECT id, title FROM ruled"
    sql["paragraph_sanitize"] = f"""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l)
SELECT id, pos, {sanitised('line', ('leaux', 'worthless', 'Read next:'))} AS paragraph FROM u"""
    sql["word_count"] = f"SELECT doc_id AS id, len(regexp_extract_all(text, {CHUNK}, 1)) AS words FROM documents"
    sql["punct_spacing"] = (r"SELECT doc_id AS id, regexp_replace(text, '([.,()''’?!:])', ' \1 ', 'g') AS spaced "
                            "FROM documents")
    sql["short_text"] = with_(A, R, RULED) + """, posts AS (SELECT id, coalesce(mention, '') AS m, link, first_title AS title,
  (CASE WHEN length(first_title) >= 116 THEN left(first_title, 115) ELSE first_title END) || ' ' || link AS body
  FROM ruled)
SELECT id, CASE WHEN length(body) + length(m) < 116 THEN body || ' ' || m ELSE body END AS short_post,
  title || ' ' || link || ' ' || m AS long_post FROM posts"""
    sql["url_absolutize"] = """WITH h AS (SELECT page_id, url, regexp_extract(html, 'href="([^"]*)"', 1) AS href FROM pages),
i AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'data:' || href WHEN 1 THEN '/' || href WHEN 2 THEN href
  WHEN 3 THEN 'http://img.example.com' || href ELSE '' END AS img FROM h)
SELECT page_id, CASE WHEN img = '' OR img LIKE 'data:%' THEN NULL WHEN img LIKE '//%' THEN 'https:' || img
  WHEN img LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || img ELSE img END AS image FROM i"""
    sql["page_text"] = with_(PARAGRAPHS) + f"SELECT page_id, {PAGE_TEXT} AS text FROM paras"
    sql["page_formatted"] = with_(PARAGRAPHS) + f"SELECT page_id, {PAGE_RAW} AS raw FROM paras"
    sql["page_attr"] = f"SELECT page_id, {HREF} AS href, {HREF} AS image FROM pages"
    sql["page_tags"] = with_(LINKS) + f"SELECT page_id, {PAGE_TAGS} AS tags FROM links"
    sql["page_parse"] = with_(PARAGRAPHS, LINKS) + f"""SELECT page_id, {PAGE_TEXT} AS text, {PAGE_RAW} AS raw,
{HREF} AS image, {PAGE_TAGS} AS tags, {HAS_AD} AS has_ad FROM paras JOIN links USING (page_id)"""
    hit = " OR ".join(f"contains(lower(ad), {q(w)})" for w in fixtures.AD_WORDS)
    sql["page_elements"] = with_(*ELEMENTS) + """SELECT page_id, place AS start, stop, depth, tag, classes, href, text
FROM elements"""
    # Pieces of an element are joined by their places; the article's own tags are no text.
    sql["page_blocks"] = with_(*ELEMENTS, rf"""whole AS (
  SELECT e.page_id, e.place, e.tag, any_value(e.href) AS href, string_agg(p.piece, '' ORDER BY p.place) AS markup
  FROM elements e JOIN pieces p ON p.page_id = e.page_id AND p.place BETWEEN e.place AND e.stop - 1
  WHERE e.stop >= 0 AND e.tag IN ('a', 'article') GROUP BY ALL),
texts AS (SELECT *, {strip_tags('markup')} AS text FROM whole)""") + """SELECT g.page_id,
  coalesce((SELECT string_agg(text, '|' ORDER BY place) FROM texts t WHERE t.page_id = g.page_id AND tag = 'article'), '') AS articles,
  coalesce((SELECT string_agg(e.href || ' ' || coalesce(t.text, ''), '|' ORDER BY e.place) FROM elements e
    LEFT JOIN texts t ON t.page_id = e.page_id AND t.place = e.place WHERE e.page_id = g.page_id AND e.tag = 'a' AND e.linked), '') AS links,
  (SELECT count(*) FROM elements e WHERE e.page_id = g.page_id AND tag = 'div' AND list_contains(string_split(classes, ' '), 'ad')) AS ads
FROM pages g"""
    sql["filter_content"] = (f"WITH a AS (SELECT page_id, CASE WHEN {HAS_AD} THEN {strip_tags(AD)} END AS ad FROM pages) "
                             f"SELECT page_id, coalesce({hit}, false) AS blocked, ad IS NOT NULL AS has_ad FROM a")
    sql["filter_selection"] = with_(LINKS, page_rules()) + f"""SELECT l.page_id,
  (len(coalesce(url_selects, [])) = 0 AND len(coalesce(label_selects, [])) = 0)
  OR len(list_filter(coalesce(url_selects, []), lambda u: contains(l.url, u))) > 0
  OR coalesce(list_has_any(links, label_selects), false) AS selected
FROM links l LEFT JOIN prules r ON r.lang = {PAGE_LANG}
  AND r.service = regexp_extract({HOST}, '([^.]+[.][^.]+)$', 1)"""
    sql["filter_title"] = with_(A, R, RULED) + f"SELECT id, {BLOCKED.format(t='first_title')} AS blocked FROM ruled"
    sql["filter_url"] = with_(A, R, RULED) + f"SELECT id, {URL_BLOCKED} AS blocked FROM ruled"
    sql["accepted"] = with_(judged()) + """SELECT id, concat_ws(',', CASE WHEN by_title THEN 'title' END,
  CASE WHEN by_url THEN 'url' END, CASE WHEN is_duplicate THEN 'duplicate' END) AS reasons,
  NOT (by_title OR by_url OR is_duplicate) AS accepted FROM judged"""
    sql["rule_join"] = with_(A, R) + """SELECT id, a.service, a.lang, mention, array_to_string(title_patterns, '~')
  AS title_patterns FROM articles a JOIN rules r ON r.service = a.service AND r.lang = a.lang"""
    sql["seen_anti"] = with_(KEYED) + """SELECT page_id, lang, feed_host, entry_key, link FROM keyed
ANTI JOIN seen USING (lang, feed_host, entry_key)
QUALIFY row_number() OVER (PARTITION BY lang, feed_host, entry_key ORDER BY page_id) = 1"""
    sql["seen_store_anti"] = sql["seen_anti"]
    sql["publish_eligible"] = with_(KEYED) + """SELECT page_id, lang, feed_host,
  (lang, feed_host) IN (SELECT (lang, feed_host) FROM seen) AS publish_ok FROM keyed"""
    sql["word_membership"] = f"""SELECT doc_id AS id, list_contains(t, 'the') AS has_the, list_contains(t, lang) AS has_lang
FROM (SELECT doc_id, lang, regexp_extract_all(text, {TOKEN}, 1) AS t FROM documents)"""
    sql["stopword_filter"] = with_(L, DOCS, detect("docs", "text"), kept_tokens("docs", "text")) + \
        "SELECT id, pos, token FROM kept"
    sql["find_by_text"] = with_(A) + f"""SELECT id, title FROM articles WHERE contains(text, {q(fixtures.NEEDLE)})
ORDER BY id LIMIT 1"""
    alias = [(q(c), q(a.lower())) for c, names in fixtures.TAG_ALIASES for a in [c, *names]]
    sql["tag_canonical"] = with_(LINKS, f"""alias(canonical, name) AS (
  SELECT min(column0), column1 FROM ({_values(alias)}) v(column0, column1) GROUP BY column1)""",
                                 """t AS (SELECT page_id, unnest(links) AS tag, generate_subscripts(links, 1) - 1 AS pos
  FROM links)""") + """SELECT page_id, pos, tag, coalesce(canonical, tag) AS canonical,
  canonical IS NOT NULL AS known FROM t LEFT JOIN alias ON alias.name = lower(tag)"""
    sql["tokenize"] = f"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(text, {TOKEN}, 1) AS toks FROM documents)
SELECT id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM t"""
    sql["lang_likelihood"] = with_(L, DOCS, detect("docs", "text")) + """SELECT d.id, l.language,
  coalesce(h.hits, 0) AS hits FROM docs d CROSS JOIN (SELECT DISTINCT language FROM base) l
  LEFT JOIN lng_h h ON h.id = d.id AND h.language = l.language"""
    sql["lang_detect"] = with_(L, DOCS, detect("docs", "text")) + "SELECT id, language FROM lng"
    sql["term_freq"] = f"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(text, {TOKEN}, 1) AS toks FROM documents),
u AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM t)
SELECT id, token, count(*) AS tf, min(pos) AS first_pos FROM u GROUP BY ALL"""
    TF = terms("articles", "title")
    sql["doc_freq"] = with_(A, L, TF) + "SELECT term, count(*) AS df FROM tf GROUP BY term"
    sql["stem_vocab"] = with_(L, DOCS, detect("docs", "text"), f"""v AS (SELECT l.language,
  unnest(regexp_extract_all(lower(d.text), {TOKEN}, 1)) AS token FROM docs d JOIN lng l USING (id))""",
                              stem_table("v")) + """SELECT v.language, v.token, count(*) AS uses, any_value(s.stem) AS stem
FROM v JOIN stemmed s ON s.token = v.token AND s.fr = (v.language IS NOT DISTINCT FROM 'french') GROUP BY v.language, v.token"""
    sql["tokens_clean"] = with_(A, L, detect("articles", "title"), kept_tokens("articles", "title"),
                                stem_table("kept")) + """SELECT id, language, pos, k.token, stem FROM kept k
JOIN stemmed s ON s.token = k.token AND s.fr = (k.language IS NOT DISTINCT FROM 'french')"""
    sql["tfidf"] = with_(A, L, TF, VECTORS) + "SELECT id, term, df, round(w, 6) AS weight FROM x"
    sql["top_tags"] = with_(L, DOCS, tags_of("docs")) + \
        "SELECT id, array_to_string(tags, ' ') AS tags FROM toptags"
    sql["top_tags_literal"] = with_(L, DOCS, tags_of("docs", False)) + \
        "SELECT id, array_to_string(tags, ' ') AS tags FROM toptags"
    sql["article_tags"] = with_(L, DOCS, R, tags_of("docs")) + """SELECT d.id, array_to_string(list_concat(
  coalesce(r.tags, []), coalesce(t.tags, [])), ' ') AS tags FROM docs d LEFT JOIN toptags t ON t.id = d.id
  LEFT JOIN rules r ON r.service = d.service AND r.lang = d.lang"""
    sql["main_words"] = with_(L, DOCS, spaced_words("docs"), MAIN_WORDS) + \
        "SELECT id, language, words FROM mainwords"
    sql["main_phrases"] = with_(L, DOCS, spaced_words("docs")) + r""", wk AS (SELECT *,
  count(*) OVER (PARTITION BY id, word) >= 1 + n / 100 AS often,
  pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run
  FROM spk WHERE regexp_matches(word, '[\p{L}\p{N}]'))
SELECT DISTINCT id, phrase FROM (SELECT id, run, string_agg(word, ' ' ORDER BY pos) AS phrase, bool_or(often) AS often
  FROM wk WHERE length(word) BETWEEN 2 AND 15 GROUP BY id, run) WHERE often"""
    sql["summary_topn"] = with_(L, DOCS, summaries("docs")) + "SELECT id, summary FROM summaries"
    sql["near_dup_titles"] = with_(A, L, TF, VECTORS, BEST) + \
        "SELECT id, coalesce(match_id, -1) AS match_id, similarity, similarity_with, is_duplicate FROM verdict"
    sql["near_dup_asof"] = with_(A, L, TF) + ", " + asof(500)
    sql["sliding_similar"] = with_(A, L, TF) + ", " + buffer(6)
    sql["sliding_buffer"] = with_(A) + """, p AS (SELECT id, lower(title) AS text, row_number() OVER (ORDER BY id) AS pos
  FROM articles) SELECT n.id, (n.pos - o.pos)::INTEGER AS slot, o.text FROM p n JOIN p o ON o.pos BETWEEN n.pos - 6 AND n.pos"""
    sql["similar_topn"] = with_(A, L, TF, VECTORS) + """, qs AS (SELECT id FROM articles ORDER BY id DESC LIMIT 5)
SELECT a.id AS query_id, row_number() OVER (PARTITION BY a.id ORDER BY round(sum(a.w * b.w), 9) DESC, b.id) AS rank,
  b.id AS match_id, round(sum(a.w * b.w), 6) AS score
FROM x a JOIN qs ON qs.id = a.id JOIN x b ON b.term = a.term AND b.id <> a.id GROUP BY a.id, b.id QUALIFY rank <= 3"""
    sql["similar_all"] = with_(A, L, TF, VECTORS) + """SELECT a.id AS query_id,
  row_number() OVER (PARTITION BY a.id ORDER BY round(sum(a.w * b.w), 9) DESC, b.id) AS rank,
  b.id AS match_id, round(sum(a.w * b.w), 6) AS score
FROM x a JOIN x b ON b.term = a.term AND b.id <> a.id GROUP BY a.id, b.id QUALIFY rank <= 3"""
    sql["more_like_this"] = "WITH " + MLT
    sql["retention"] = with_(A) + "SELECT id, title FROM articles ORDER BY id DESC LIMIT 500"
    sql["retention_per_source"] = with_(A) + """SELECT id, service, title FROM articles
QUALIFY row_number() OVER (PARTITION BY service ORDER BY id DESC) <= 7"""
    sql["tag_trend"] = with_(L, DOCS, tags_of("docs")) + f""", u AS (SELECT id, {DAY} AS day, unnest(tags) AS tag,
  generate_subscripts(tags, 1) AS pos FROM toptags),
c AS (SELECT day, tag, count(*) AS uses, min((id, pos)) AS f FROM u GROUP BY ALL)
SELECT day, row_number() OVER (PARTITION BY day ORDER BY uses DESC, f) AS rank, tag, uses FROM c QUALIFY rank <= 10"""
    counters = f"""count(*) AS total, count(*) FILTER (ok) AS twitted, count(*) FILTER (NOT ok) AS filtered,
  count(*) FILTER (is_duplicate) AS duplicates,
  coalesce(sum(len(regexp_extract_all(text, {CHUNK}, 1))) FILTER (ok), 0)::BIGINT AS nbwords,
  coalesce(sum(len(all_tags)) FILTER (ok), 0)::BIGINT AS nbtags"""
    figures_of = lambda verdicts: with_(verdicts, tags_of("articles"), f"""told AS (SELECT j.*, {DAY.replace('id', 'j.id')} AS day,
  NOT (by_title OR by_url OR is_duplicate) AS ok, list_concat(coalesce(rule_tags, []), coalesce(t.tags, [])) AS all_tags
  FROM judged j LEFT JOIN toptags t ON t.id = j.id)""", """uses AS (SELECT day, tag, count(*) AS n, min((id, pos)) AS f FROM (
  SELECT id, day, unnest(all_tags) AS tag, generate_subscripts(all_tags, 1) AS pos FROM told WHERE ok) GROUP BY ALL),
tops AS (SELECT day, string_agg(tag, ' ' ORDER BY r) AS top_trend FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, f) AS r FROM uses) WHERE r <= 10 GROUP BY day)""",
                                        f"stats AS (SELECT day, {counters} FROM told GROUP BY day)")
    figures = figures_of(judged())
    sql["daily_stats"] = figures + "SELECT stats.*, top_trend FROM stats LEFT JOIN tops USING (day)"
    sql["stats_merge"] = figures + "SELECT * FROM stats"
    sql["daily_store_scan"] = figures + """SELECT stats.*, coalesce(top_trend, '') AS top_trend, id, service, title, lang,
  array_to_string(all_tags, ' ') AS tags FROM told JOIN stats USING (day) LEFT JOIN tops USING (day) WHERE ok"""
    sql["watcher_run"] = with_(watched()) + f"""SELECT j.id, link, title, array_to_string(reasons, ',') AS reasons,
  len(reasons) = 0 AS accepted, coalesce(match_id, -1) AS match_id, similarity, j.text, raw,
  CASE WHEN href LIKE '//%' THEN 'https:' || href
    WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href WHEN href <> '' THEN href END AS image,
  CASE WHEN len(reasons) = 0 THEN array_to_string(list_concat(rule_tags, coalesce(t.tags, [])), ' ') END AS tags,
  CASE WHEN len(reasons) = 0 THEN len(regexp_extract_all(j.text, {CHUNK}, 1)) END AS nbwords
FROM judged j LEFT JOIN toptags t ON t.id = j.id"""
    # The second run: what the first one stored comes first, whatever its ids.
    told = "SELECT id, title, link, reasons, len(reasons) = 0 AS accepted, match_id, similarity, lang, feed_host, entry_key"
    both = watched("id % 2 = 0").replace("articles AS MATERIALIZED", "fetched AS MATERIALIZED").replace(
        terms("articles", "title"), """corpus AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY late, id) - 1 AS place FROM (
    SELECT id, title, 0 AS late FROM (SELECT id, title FROM run1 WHERE accepted ORDER BY id DESC LIMIT 40)
    UNION ALL SELECT id, title, 1 FROM fetched)),
articles AS MATERIALIZED (SELECT place AS id, title FROM corpus),
""" + terms("articles", "title")).replace("FROM articles a JOIN verdict v USING (id))", """FROM fetched a
  JOIN corpus c ON c.late = 1 AND c.id = a.id JOIN verdict v ON v.id = c.place)""").replace(
        "FROM keyed ANTI JOIN seen", "FROM keyed ANTI JOIN (SELECT * FROM seen UNION SELECT lang, feed_host, entry_key FROM run1) s")
    sql["watcher_two_runs"] = f"""WITH run1 AS MATERIALIZED (WITH {watched("id % 2 = 1")} {told} FROM judged),
run2 AS MATERIALIZED (WITH {both} {told} FROM judged)
SELECT CAST(1 AS BIGINT) AS run, id, title, array_to_string(reasons, ',') AS reasons, accepted, coalesce(match_id, -1) AS match_id, similarity FROM run1
UNION ALL SELECT 2, r.id, r.title, array_to_string(reasons, ','), accepted, coalesce(c.id, -1), similarity
FROM run2 r LEFT JOIN (SELECT *, row_number() OVER (ORDER BY late, id) - 1 AS place FROM (
    SELECT id, 0 AS late FROM (SELECT id FROM run1 WHERE accepted ORDER BY id DESC LIMIT 40)
    UNION ALL SELECT id, 1 FROM run2)) c ON c.place = r.match_id"""
    sql["feed_export"] = with_(judged(), """newest AS (SELECT * FROM judged
  WHERE NOT (by_title OR by_url OR is_duplicate) ORDER BY id DESC LIMIT 100)""", tags_of("newest")) + \
        """SELECT n.id::VARCHAR AS id, title, service AS author, strftime(published, '%Y-%m-%d %H:%M:%S') AS published,
  strftime(published, '%Y-%m-%d %H:%M:%S') AS updated, link,
  (CASE WHEN lang = 'fr' THEN '<img src="' || link || '.jpg"/>' ELSE '' END)
  || (CASE WHEN n.id % 2 = 0 THEN '<p>' || title || '</p>' ELSE '<p>' || text || '</p>' END)
  || '<p>Tags :' || (CASE WHEN len(all_tags) > 0 THEN '[''' || array_to_string(all_tags, ''', ''') || ''']'
    ELSE '[]' END) || '</p><p>Similarity of ' || round(similarity, 2)::DOUBLE::VARCHAR || ' with ' || similarity_with
  || '</p>' AS content
FROM (SELECT n.*, list_concat(coalesce(rule_tags, []), coalesce(t.tags, [])) AS all_tags
  FROM newest n LEFT JOIN toptags t ON t.id = n.id) n"""
    sql["doc_by_id"] = with_(A) + "SELECT id, title, text, lang FROM articles WHERE id = 42"
    sql["field_by_id"] = with_(A) + "SELECT coalesce(max(title), '') AS value FROM articles WHERE id = 42"
    sql["field_update"] = with_(A) + """SELECT a.id, title, CASE WHEN l.quality = 1 THEN 'reviewed' ELSE '' END
  AS is_tagged_by_human FROM articles a LEFT JOIN labels l ON l.doc_id = a.id"""
    sql["index_enrich"] = with_(L, A, """docs AS (SELECT sha256(concat_ws(chr(1), service, title || ' ' || id, text)) AS id,
  title || ' ' || id AS title, service, text FROM articles)""", spaced_words("docs"), MAIN_WORDS,
                                summaries("docs")) + """SELECT d.id, d.title, d.service AS site, l.language,
  CASE WHEN l.language IN ('french', 'english') THEN coalesce(s.summary, '') ELSE '' END AS abstract,
  coalesce(m.words, '') AS mainwords, '' AS is_tagged_by_ai
FROM docs d JOIN lng l ON l.id = d.id LEFT JOIN summaries s ON s.id = d.id LEFT JOIN mainwords m ON m.id = d.id"""
    sql["index_append"] = with_(A) + """SELECT DISTINCT ON (id) sha256(concat_ws('|', service, title, text)) AS id, title,
  service AS site, lang AS language FROM articles"""
    sql["feed_store_scan"] = with_(A) + """SELECT id, service, title, lang, link AS source, service AS tags, text,
  strftime(date_trunc('minute', published) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS published_utc FROM articles"""
    sql["rules_scan"] = with_(A, R, RULED) + f"SELECT id, title, {BLOCKED.format(t='title')} AS blocked FROM ruled"
    sql["article_files_scan"] = """SELECT source, doc_id::VARCHAR AS title, text AS content FROM documents"""
    sql["feed_entries_scan"] = with_(A) + "SELECT title, link, service AS summary FROM articles"
    sql["atom_entries_scan"] = with_(A) + """SELECT title, link, service AS summary,
  CASE WHEN id % 2 = 1 THEN strftime(published, '%Y-%m-%d %H:%M') ELSE strftime(published, '%Y-%m-%d') END AS published
FROM articles"""
    sql["stream_entries"] = with_(A) + """SELECT title, link, service AS summary,
  CASE WHEN id % 2 = 0 THEN strftime(published, '%Y-%m-%d') ELSE '' END AS published FROM articles"""
    sql["feed_sink"] = with_(A) + """SELECT id, title, service AS author, strftime(published, '%Y-%m-%d %H:%M:%S') AS published,
  strftime(published, '%Y-%m-%d %H:%M:%S') AS updated, link, '<img src="' || link || '.jpg?a&b"/><p>' || text
  || '</p><p>Tags :[\'\'' || service || '\'\']</p><p>Similarity of 0.0 with ' || title || '</p>' AS content
FROM articles ORDER BY id DESC LIMIT 100"""
    sql["text_sink"] = with_(KEYED, PARAGRAPHS) + f"""SELECT lang, feed_host, entry_key, {PAGE_TEXT} AS text
FROM (SELECT *, row_number() OVER (PARTITION BY lang, feed_host, entry_key ORDER BY page_id) AS turn FROM keyed)
JOIN paras USING (page_id) WHERE turn = 1"""
    sql["retained_sink"] = with_(A) + "SELECT id, service, title FROM articles ORDER BY id DESC LIMIT 500"
    sql["daily_sink"] = with_(A) + """SELECT strftime(published, '%Y%m%d') AS day,
  CASE WHEN strftime(published, '%Y%m%d') >= '20240105' THEN 2 ELSE 1 END AS run, count(*) AS articles
FROM articles GROUP BY ALL"""
    sql["stream_ingest"] = with_(KEYED) + "SELECT page_id, lang, feed_host, entry_key, link FROM keyed"
    sql["stream_dedup"] = with_(KEYED) + "SELECT DISTINCT lang, feed_host, entry_key FROM keyed"
    # The first two days are known to the third; on the fourth only the third is remembered.
    days = ["2024-03-01", "2024-03-02", "2024-03-08", "2024-03-09"]
    came = ",\n".join(f"""d{k} AS (SELECT DISTINCT '{day}' AS day, lang, service || '.example.com' AS feed_host,
    id % 5 || '.txt' AS entry_key FROM articles WHERE id // 20 % 4 = {k}{' AND id % 9 <> 0' if k == 3 else ''})""" for k, day in enumerate(days))
    keys = "USING (lang, feed_host, entry_key)"
    sql["stream_dedup_bounded"] = with_(A, came, f"e1 AS (SELECT * FROM d1 ANTI JOIN d0 {keys})",
                                        f"e2 AS (SELECT * FROM d2 ANTI JOIN d0 {keys} ANTI JOIN d1 {keys})",
                                        f"e3 AS (SELECT * FROM d3 ANTI JOIN e2 {keys})") + \
        "SELECT * FROM d0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3"
    sql["stream_neardup"] = with_(A, L, TF, batch("a", "SELECT id, 1 AS late FROM articles WHERE id % 2 = 1"), batch(
        "b", """SELECT id, 0 AS late FROM (SELECT id FROM a_told WHERE NOT is_duplicate ORDER BY id DESC LIMIT 500)
  UNION ALL SELECT id, 1 FROM articles WHERE id % 2 = 0""")) + "SELECT * FROM a_told UNION ALL SELECT * FROM b_told"
    sql["stream_event_days"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total FROM events GROUP BY 1"""
    # The odd ids are judged first; the even ones against what was accepted of them.
    kept = f"""SELECT a.id FROM a_told t JOIN articles a USING (id) WHERE NOT t.is_duplicate
    AND NOT ({BLOCKED.format(t='title')}) AND NOT ({URL_BLOCKED}) ORDER BY a.id DESC LIMIT 500"""
    batches = ",\n".join([
        batch("a", "SELECT id, 1 AS late FROM articles WHERE id % 2 = 1"),
        batch("b", f"SELECT id, 0 AS late FROM ({kept}) UNION ALL SELECT id, 1 FROM articles WHERE id % 2 = 0"),
        "verdict AS (SELECT *, '' AS similarity_with FROM a_told UNION ALL SELECT *, '' FROM b_told)"])
    sql["stream_daily"] = figures_of(judged().replace(f"{VECTORS},\n{BEST}", batches)) + """
SELECT stats.*, coalesce(top_trend, '') AS top_trend FROM stats LEFT JOIN tops USING (day)"""
    sql["stream_window"] = with_(A) + """, p AS (SELECT id, service, lower(title) AS text,
  row_number() OVER (PARTITION BY service ORDER BY id % 2 DESC, id) AS pos FROM articles)
SELECT n.service, n.id, n.pos - o.pos AS slot, o.text FROM p n JOIN p o ON o.service = n.service
  AND o.pos BETWEEN n.pos - 6 AND n.pos"""
    return sql
