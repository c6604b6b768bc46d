"""Page extraction: texts, formatted texts, attributes, tags, content checks.

Everything stays in the JVM.  ``native_sections`` serves one rule for all pages;
``located`` lets every page follow the locators of its own source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, text

LOCATOR = "struct<type:string,name:string,value:string,section:string,attribute:string>"


def native_sections(pages: DataFrame, html: str, tag: str, section: str, out: str,
                    class_: str | None = None) -> DataFrame:
    """Add ``out``: texts of ``tag/section``, null when there is no container."""
    inner = markup.container(markup.visible(F.col(html)), tag, class_)
    return (pages.withColumn("_inner", inner)
            .withColumn(out, markup.sections(F.col("_inner"), section)).drop("_inner"))


def joined_text(paragraphs: Column, markers) -> Column:
    """Sanitised paragraphs, joined without a separator."""
    clean = F.transform(paragraphs, lambda p: text.sanitise_paragraph(p, markers))
    return F.coalesce(F.array_join(clean, ""), F.lit(""))


def formatted_text(paragraphs: Column, markers) -> Column:
    """Non-empty sanitised paragraphs, each in ``<p>…</p>``."""
    clean = F.transform(paragraphs, lambda p: text.sanitise_paragraph(p, markers))
    kept = F.filter(clean, lambda p: p != "")
    wrapped = F.transform(kept, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>")))
    return F.coalesce(F.array_join(wrapped, ""), F.lit(""))


def page_tags(texts: Column) -> Column:
    """Lower case, without dashes, blanks and ``...``; empties dropped."""
    def clean(t):
        t = F.lower(t)
        for piece in ("-", " ", "..."):
            t = F.replace(t, F.lit(piece), F.lit(""))
        return t

    return F.filter(F.transform(texts, clean), lambda t: t != "")


def first_of(*values: Column) -> Column:
    """First non-empty value, else ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


# Column of the rule -> (output column, what to read).
_READS = {
    "text_rule": ("paragraphs", "texts"), "image_rule": ("image", "attribute"),
    "image_alt_rule": ("image_alt", "attribute"), "tag_rule": ("tag_texts", "texts"),
    "label_rule": ("labels", "own"), "content_rule": ("content", "content"),
}


def _read(shown: Column, rule: Column, want: str) -> Column:
    """What one locator finds in the visible markup."""
    box = F.when(F.coalesce(rule["name"], F.lit("class")) == "class",
                 markup.container(shown, rule["type"], F.coalesce(rule["value"], F.lit(""))))
    if want == "texts":
        return markup.sections(box, rule["section"])
    if want == "own":
        return markup.own_texts(box, rule["section"])
    if want == "attribute":
        values = markup.attributes(box, rule["section"], rule["attribute"])
        return F.when(values.isNotNull(), F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("")))
    return F.lower(markup.plain_text(box))


def located(pages: DataFrame, html: str) -> DataFrame:
    """Add paragraphs, image, image_alt, tag_texts, labels and content, as far as ``pages`` carries
    the locator columns ``text_rule``, ``image_rule``, ``image_alt_rule``, ``tag_rule``,
    ``label_rule`` and ``content_rule`` (type ``LOCATOR``).

    What a rule does not find is null; all rules of a row read the same visible markup.
    """
    rules = [c for c in _READS if c in pages.columns]
    shown = pages.withColumn("_shown", markup.visible(F.col(html)))
    return shown.withColumns({
        _READS[r][0]: _read(F.col("_shown"), F.col(r), _READS[r][1]) for r in rules}).drop("_shown")


def content_rejected(html: Column, blocks: Column) -> Column:
    """Some block (tag, class, text) names an element whose lower-cased text holds its text."""
    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(F.contains(
        F.lower(markup.plain_text(markup.container(html, b["tag"], b["class"]))), F.lower(b["text"])),
        F.lit(False))), F.lit(False))


def element_rejected(html: Column, blocks: Column) -> Column:
    """Some block (tag, class) names an element that the page has."""
    return F.coalesce(F.exists(blocks, lambda b: markup.container(html, b["tag"], b["class"]).isNotNull()),
                      F.lit(False))


def selection_labels(html: Column, selects: Column) -> Column:
    """Of the label rules (tag, class, section, text) the texts of those that admit the page."""
    held = F.filter(selects, lambda s: F.array_contains(
        markup.own_texts(markup.container(html, s["tag"], s["class"]), s["section"]), s["text"]))
    return F.transform(held, lambda s: s["text"])


def content_blocked(content: Column, words: Column) -> Column:
    """A block word occurs in the text of the checked element."""
    return F.exists(F.coalesce(words, F.array().cast("array<string>")),
                    lambda w: F.contains(F.lower(content), F.lower(w)))
