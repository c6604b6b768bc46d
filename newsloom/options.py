"""Run settings, one frozen value per knob."""

from __future__ import annotations

from dataclasses import dataclass

# Settings of the watched run.
RETAINED = 500
EXPORTED = 100
DUPLICATE_AT = 0.4
TAGS_PER_ARTICLE = 10
SUMMARY_SENTENCES = 3
BUFFER_SIZE = 6
POST_LIMIT = 140
LINK_ROOM = 24
PARAGRAPH_MARKERS = ("adsbygoogle", "toto", "Read next:")


@dataclass(frozen=True)
class RunOptions:
    retained: int = RETAINED
    exported: int = EXPORTED
    duplicate_at: float = DUPLICATE_AT
    tags_per_article: int = TAGS_PER_ARTICLE
    summary_sentences: int = SUMMARY_SENTENCES
    buffer_size: int = BUFFER_SIZE
    key_from: str = "canonical"
    paragraph_markers: tuple[str, ...] = PARAGRAPH_MARKERS
