"""Native page extraction for ``container / section`` rules.

Tags, classes, sections and attributes are plain texts or columns, so every row
may follow a rule of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running_sum

# Inline elements, which do not end a paragraph.
INLINE = ("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
          "small span strong sub sup time tt u var wbr").split()
# Character references decoded natively; ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"))

# Elements without content.
VOID = r"(?i)^<(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b"
# A tag begins here; "<" before anything else is text.
PIECE = "(?=</?[a-zA-Z])"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*["']([^"']*)["']"""
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def visible(html: Column) -> Column:
    """Markup without scripts, styles and comments."""
    return F.regexp_replace(html, HIDDEN, "")


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _pattern(*parts) -> Column:
    """A pattern put together from texts and columns."""
    if any(isinstance(p, Column) for p in parts):
        return F.concat(*[_column(p) for p in parts])
    return F.lit("".join(parts))


def container(html: Column, tag, class_=None) -> Column:
    """Inner markup of the first such element up to its own end tag.

    A class matches as one token of the attribute, or as the whole attribute; a
    null class asks for none.  Elements of the same name may nest.  Null when there
    is no such element or it is never closed.
    """
    bare = _pattern("(?is)<", tag, r"\b[^>]*>.*")
    if class_ is None:
        opened = bare
    else:
        name = F.concat(F.lit("\\Q"), _column(class_), F.lit("\\E"))
        classed = F.concat(
            F.lit("(?is)<"), _column(tag), F.lit(r"""\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?"""), name,
            F.lit(r"""(?:\s[^"']*)?["'][^>]*>.*"""))
        opened = F.when(F.coalesce(_column(class_), F.lit("")) == "", bare).otherwise(classed)
    pieces = F.split(F.regexp_substr(html, opened), _pattern(r"(?i)(?=</?", tag, r"[\s/>])"))
    # The pieces are named once for the two uses below.
    return F.transform(F.array(pieces), lambda ps: _balanced(ps, tag))[0]


def _balanced(pieces: Column, tag) -> Column:
    """Pieces up to the end tag that closes the first one, without its start tag."""
    opens, closes = _pattern(r"(?i)^<", tag, r"[\s/>]"), _pattern(r"(?i)^</", tag, r"[\s/>]")

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(F.regexp_like(piece, closes), -1).when(F.regexp_like(piece, opens), 1).otherwise(0)
        done = (s["n"] > 0) & (s["depth"] == 0)
        return F.when(done, s).otherwise(F.struct(
            depth.alias("depth"), (s["n"] + F.when(depth == 0, 0).otherwise(1)).alias("n")))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step)
    inner = F.transform(F.array(found), lambda f: F.when(
        f["depth"] == 0, F.array_join(F.slice(pieces, 1, f["n"]), "")))[0]
    return F.regexp_replace(inner, "^<[^>]*>", "")


def _tags(pieces: Column) -> Column:
    """Of every piece its tag name in lower case ('' for text), whether it is an end tag, and whether it is whole."""
    return F.transform(pieces, lambda p: F.struct(
        F.lower(F.regexp_extract(p, TAG_NAME, 1)).alias("name"), F.startswith(p, F.lit("</")).alias("ends"),
        F.contains(p, F.lit(">")).alias("whole")))


def section_markup(inner: Column, section) -> Column:
    """Inner markup of all sections: each runs until its end tag or the next block tag.

    One pass over the pieces between tags: those that are no inline tag cut the markup,
    and a section is what lies between its start tag and the next cut.
    """
    inline, name = F.array(*map(F.lit, INLINE)), F.lower(_column(section))

    def spans(pieces: Column, cuts: Column) -> Column:
        # A cut ends where the next one begins.
        stops = F.transform(cuts, lambda c, k: F.struct(c["at"].alias("at"), c["opens"].alias("opens"), F.coalesce(
            F.try_element_at(cuts, k + 2)["at"], F.size(pieces)).alias("stop")))
        return F.transform(F.filter(stops, lambda c: c["opens"]), lambda c: F.regexp_replace(
            F.array_join(F.slice(pieces, c["at"] + 1, c["stop"] - c["at"]), ""), "^<[^>]*>", ""))

    def found(pieces: Column) -> Column:
        # A section may be an inline element itself, which then cuts too.
        marks = F.transform(_tags(pieces), lambda t, i: F.struct(
            i.alias("at"), ((t["name"] == name) & ~t["ends"] & t["whole"]).alias("opens"),
            (F.array_contains(inline, t["name"]) & (t["name"] != name) & t["whole"]).alias("inline")))
        return let(F.filter(marks, lambda m: ~m["inline"]), lambda cuts: spans(pieces, cuts))

    return let(F.split(inner, PIECE), found)


def sections(inner: Column, section) -> Column:
    """Texts of all sections, tags removed and references decoded."""
    return F.transform(section_markup(inner, section), plain_text)


def own_texts(inner: Column, section) -> Column:
    """Texts that stand directly in a section, not in an element inside it."""
    return F.flatten(F.transform(section_markup(inner, section), _direct))


def _step(piece: Column) -> Column:
    """Change of depth: an end tag -1, a start tag 1, text and elements without content 0."""
    return F.when(F.startswith(piece, F.lit("</")), -1).when(
        F.regexp_like(piece, F.lit("^<[a-zA-Z]")) & ~F.regexp_like(piece, F.lit(VOID)), 1).otherwise(0)


def _direct(markup: Column) -> Column:
    def texts(pieces: Column) -> Column:
        return F.zip_with(pieces, running_sum(F.transform(pieces, _step)),
                          lambda p, depth: F.when(depth == 0, plain_text(p)))

    return F.filter(let(F.split(markup, PIECE), texts), lambda t: t != "")


def parsed(html: Column) -> Column:
    """A page as ``struct<pieces, elements>``.

    ``pieces`` are the visible markup, cut before every tag.  ``elements`` has one entry
    per start tag, in order: struct<tag, classes, attributes, start, stop, depth, text>.
    ``start`` and ``stop`` are the pieces of the start and end tag; the end tag is the one
    that closes the element among those of its name, null when there is none.  ``depth``
    counts the closed elements around it, so tags left open shift nothing.  ``text`` is
    the text up to the next tag.

    All steps are sorts and passes over the pieces: a page with a hundred thousand tags
    takes a hundred thousand steps, and no pattern spans more than one tag.
    """
    def elements(pieces: Column) -> Column:
        events = F.filter(F.transform(pieces, lambda p, i: F.struct(
            F.lower(F.regexp_extract(p, TAG_NAME, 1)).alias("name"), i.alias("at"), _step(p).alias("step"))),
            lambda e: e["step"] != 0)
        # Along each name the levels rise and fall; an end tag has the level that it closes.
        pairs = let(F.array_sort(events), lambda by_name: F.array_sort(F.zip_with(
            by_name, running_sum(F.transform(by_name, lambda e: e["step"])), lambda e, sum: F.struct(
                e["name"].alias("name"), F.when(e["step"] > 0, sum).otherwise(sum + 1).alias("level"),
                e["at"].alias("at"), e["step"].alias("step")))))
        closed = let(pairs, lambda ps: F.filter(F.transform(ps, lambda e, k: let(
            F.try_element_at(ps, k + 2), lambda n: F.when((e["step"] > 0) & (n["step"] < 0) & (n["name"] == e["name"])
                                                         & (n["level"] == e["level"]), F.struct(
                e["at"].alias("start"), n["at"].alias("stop"))))), lambda e: e.isNotNull()))
        return let(closed, lambda ends: _described(pieces, ends))

    return let(F.split(visible(html), PIECE), lambda ps: F.struct(
        ps.alias("pieces"), elements(ps).alias("elements")))


def _described(pieces: Column, ends: Column) -> Column:
    """The elements of all start tags; ``ends`` (start, stop) are those with an end tag."""
    bounds = F.concat(F.transform(ends, lambda e: F.struct(e["start"].alias("at"), e["stop"].alias("stop"), F.lit(1).alias("step"))),
                      F.transform(ends, lambda e: F.struct(e["stop"].alias("at"), F.lit(0).alias("stop"), F.lit(-1).alias("step"))))
    starts = F.filter(F.transform(pieces, lambda p, i: F.when(F.regexp_like(p, F.lit("^<[a-zA-Z][^>]*>")), F.struct(
        i.alias("at"), F.lit(-1).alias("stop"), F.lit(0).alias("step")))), lambda e: e.isNotNull())
    # At one place the start tag comes first (-1 before its stop), then its bound.
    return let(F.array_sort(F.concat(starts, bounds)), lambda all_: F.filter(F.zip_with(
        F.zip_with(all_, running_sum(F.transform(all_, lambda e: e["step"])), lambda e, d: F.struct(e.alias("e"), d.alias("depth"))),
        F.transform(all_, lambda e, k: F.try_element_at(all_, k + 2)),
        lambda x, after: F.when(x["e"]["stop"] == -1, let(F.element_at(pieces, x["e"]["at"] + 1), lambda p: F.struct(
            F.lower(F.regexp_extract(p, TAG_NAME, 1)).alias("tag"), _classes(p).alias("classes"),
            _attributes(p).alias("attributes"), x["e"]["at"].alias("start"),
            F.when((after["at"] == x["e"]["at"]) & (after["step"] == 1), after["stop"]).alias("stop"),
            x["depth"].alias("depth"), plain_text(p).alias("text"))))), lambda e: e.isNotNull()))


def _attributes(piece: Column) -> Column:
    """Quoted attributes of a start tag as array<struct<name, value>>, names in lower case."""
    found = F.regexp_extract_all(F.regexp_extract(piece, "^<[^>]*>", 0), F.lit(ATTRIBUTE), F.lit(0))
    return F.transform(found, lambda a: F.struct(
        F.lower(F.regexp_extract(a, ATTRIBUTE, 1)).alias("name"), decode(F.regexp_extract(a, ATTRIBUTE, 2)).alias("value")))


def _classes(piece: Column) -> Column:
    held = F.filter(_attributes(piece), lambda a: a["name"] == "class")
    words = F.split(F.coalesce(F.try_element_at(held, F.lit(1))["value"], F.lit("")), r"\s+")
    return F.filter(words, lambda w: w != "")


def find_all(page: Column, tag, class_=None) -> Column:
    """The elements of a parsed page with that tag and, unless null, that class."""
    wanted, token = F.lower(_column(tag)), _column(class_)
    return F.filter(page["elements"], lambda e: (e["tag"] == wanted) & (
        token.isNull() | F.array_contains(e["classes"], F.coalesce(token, F.lit("")))))


def attribute(element: Column, name: str) -> Column:
    """The first attribute of that name, null when there is none."""
    return F.try_element_at(F.filter(element["attributes"], lambda a: a["name"] == name), F.lit(1))["value"]


def element_markup(page: Column, element: Column) -> Column:
    """What stands between the start and end tag; null for an element without end tag."""
    inside = F.slice(page["pieces"], element["start"] + 1, element["stop"] - element["start"])
    return F.when(element["stop"].isNotNull(), F.regexp_replace(F.array_join(inside, ""), "^<[^>]*>", ""))


def element_text(page: Column, element: Column) -> Column:
    """All text inside an element, tags removed and references decoded."""
    return plain_text(element_markup(page, element))


def attributes(inner: Column, section, attribute) -> Column:
    """Values of the attribute over all sections."""
    pattern = _pattern("(?is)<", section, r"\b[^>]*\b", attribute, r"""\s*=\s*["']([^"']*)["']""")
    return F.transform(F.regexp_extract_all(inner, pattern, F.lit(1)), decode)


def plain_text(markup: Column) -> Column:
    return decode(F.regexp_replace(markup, "<[/!?a-zA-Z][^>]*>", ""))


def decode(value: Column) -> Column:
    value = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, value)
    return F.regexp_replace(value, "&amp;?", "&")
