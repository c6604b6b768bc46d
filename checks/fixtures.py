"""Rules and settings the registered queries use; the tables themselves are given."""

SOURCES = range(20)


def document_rules():
    """Rules per (service, lang) for the documents table."""
    out = []
    for k in SOURCES:
        patterns = [["[ée]+r ", "^[A-Z][a-z]+ "], ["[|] "], [" [a-z]{2} "], None][k % 4]
        blocks = [["Than ", "LEAUX"], ["and"], None, None, None][k % 5]
        urls = [["/13", "77"], None, None][k % 3]
        for lang in ("en", "fr"):
            out.append({
                "service": f"src{k}", "lang": lang, "mention": f"#src{k}",
                "tags": [f"src{k}", "news"] if k % 2 == 0 else None,
                "title_patterns": patterns, "title_blocks": blocks, "url_blocks": urls,
            })
    return out


def page_rules():
    """Selection rules per (service, lang) for the pages table."""
    select = {"fr": (["/fr/4", "/fr/8"], None), "en": (None, ["the", "and"]),
              "es": (["/zz/"], ["de"]), "de": (None, None)}
    return [{"service": s, "lang": lang, "url_selects": u, "label_selects": w}
            for s in ("example.com", "example.net") for lang, (u, w) in select.items()]


def watched_rules():
    """Rules of the watched run over pages, per (service, lang)."""
    out = []
    for k, service in enumerate(("example.com", "example.net", "example.org")):
        for lang in ("de", "en", "es", "fr"):
            out.append({
                "service": service, "lang": lang, "tags": [f"site{k}", lang] if k < 2 else [],
                "title_patterns": ["^[A-Z][a-z]+ "] if k == 0 else [],
                "title_blocks": ["THAN", "ellea"] if lang in ("en", "fr") else [],
                "url_blocks": ["/1"] if k == 1 else [],
                "content_blocks": [("div", "ad", "la "), ("div", "none", "la ")] if k == 2 else [],
                "element_blocks": [("div", "ad")] if (k, lang) == (1, "de") else [],
                "url_selects": ["/fr/4", "/fr/8"] if (k, lang) == (0, "fr") else [],
                "label_selects": ["the", "and", "for"] if (k, lang) == (0, "en") else [],
            })
    return out


def watched_settings() -> str:
    """The same as XML settings."""
    from xml.sax.saxutils import escape, quoteattr

    def element(of, value="", /, **attrs):
        return f"<{of}{''.join(f' {a}={quoteattr(v)}' for a, v in attrs.items())}>{escape(value)}</{of}>"

    def service(r):
        filters = ([element("filter", v, type="title") for v in r["title_blocks"]]
                   + [element("filter", v, type="url") for v in r["url_blocks"]]
                   + [element("filter", v, type="class", name=c, section=t) for t, c, v in r["content_blocks"]]
                   + [element("filter", c, type=t) for t, c in r["element_blocks"]])
        selects = ([element("select", v, type="url") for v in r["url_selects"]]
                   + [element("select", v, type="nav", section="a") for v in r["label_selects"]])
        return "".join([
            f"<service name={quoteattr(r['service'])} lang={quoteattr(r['lang'])}>",
            element("text", type="article", section="p"), element("image", type="nav", section="img", attribute="src"),
            element("image_alt", type="nav", section="a", attribute="href"),
            "<selection>", *selects, "</selection><sanitize>",
            *[element("remove", v, type="title") for v in r["title_patterns"]], "</sanitize><filters>",
            *filters, "</filters><hashtags>", *[element("tag", v) for v in r["tags"]], "</hashtags></service>"])

    return "<data>" + "\n".join(service(r) for r in watched_rules()) + "</data>"


DOCUMENT_RULE_TYPE = ("service string, lang string, mention string, tags array<string>, "
                      "title_patterns array<string>, title_blocks array<string>, url_blocks array<string>")
PAGE_RULE_TYPE = "service string, lang string, url_selects array<string>, label_selects array<string>"

# Tag dictionary: (canonical, aliases).
TAG_ALIASES = [("article", ["The", "le", "das"]), ("pronoun", ["elle", "she"]), ("oreille", []),
               ("thing", ["thion", "tion", "Ention"]), ("src", ["src0", "src2", "src4"])]


def tag_dictionary() -> str:
    """The same as an XML dictionary; its last entries are of the other kind."""
    from xml.sax.saxutils import escape, quoteattr

    def group(kind, entries):
        tags = "".join(f"<tag value={quoteattr(c)}>{escape(', '.join(names))}</tag>" for c, names in entries)
        return f"<{kind}>{tags}</{kind}>"

    return f"<data>{group('hashtags', TAG_ALIASES[:3])}{group('simplify', TAG_ALIASES[3:])}</data>"


PARAGRAPH_MARKERS = ("adsbygoogle", "toto", "Read next:")
AD_WORDS = ["aulich", "the", "leaux"]
NEEDLE = "tion and"
