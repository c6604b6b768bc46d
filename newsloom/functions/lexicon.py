"""Stop words, punctuation and language names."""

from __future__ import annotations

from functools import lru_cache

from .stop_lists import BASE

# Languages told apart by default, in the order that settles equal scores.
LANGUAGES = ("english", "french", "german", "spanish")
LANGUAGE_OF_CODE = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}

# Marks and words dropped besides the public stop lists.
PUNCTUATION = (
    ". , : ; ? ! \" ' $ % ( ) « » ’ ` `` '' - _ &".split()
)
MEASURES = "mm cm km m".split()
# Written from grammar: pronoun tables, present forms of weak verbs, the calendar, quantities.
FRENCH_PRONOUNS = [
    "je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "me", "te", "se", "moi", "toi", "soi", "lui", "eux",
    "mien", "tien", "sien", "nôtre", "vôtre", "celui", "celle", "ceux", "celles", "ceci", "cela", "ça", "qui", "que", "quoi", "dont",
]
FRENCH_WEAK_VERBS = [
    "être", "suis", "es", "est", "sommes", "êtes", "sont", "avoir", "ai", "as", "a", "avons", "avez", "ont",
    "faire", "fais", "fait", "faisons", "font", "aller", "vais", "vas", "va", "allons", "allez", "vont",
    "pouvoir", "peux", "peut", "pouvons", "pouvez", "peuvent", "devoir", "dois", "doit", "devons", "devez", "doivent",
    "vouloir", "veux", "veut", "voulons", "voulez", "veulent", "savoir", "sais", "sait", "savons", "savez", "savent",
]
FRENCH_CALENDAR = [
    "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche", "janvier", "février", "mars", "avril", "mai",
    "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre", "seconde", "secondes", "minute", "minutes",
    "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "an", "ans", "année", "années", "siècle", "siècles",
]
FRENCH_QUANTITIES = [
    "aucun", "aucune", "chaque", "plusieurs", "quelques", "tout", "toute", "tous", "toutes", "peu", "beaucoup", "trop",
    "assez", "plus", "moins", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix",
]
FRENCH_LINKS = [
    "à", "après", "avant", "avec", "chez", "contre", "dans", "depuis", "derrière", "devant", "durant", "entre", "hors",
    "malgré", "par", "pendant", "pour", "sans", "sauf", "selon", "sous", "sur", "vers", "et", "ou", "mais", "donc", "or", "ni", "car",
]
FRENCH_EXTRA = FRENCH_PRONOUNS + FRENCH_WEAK_VERBS + FRENCH_CALENDAR + FRENCH_QUANTITIES + FRENCH_LINKS
ENGLISH_PRONOUNS = [
    "i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its",
    "we", "us", "our", "ours", "they", "them", "their", "theirs",
]
ENGLISH_WEAK_VERBS = [
    "be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "having", "do", "does", "did", "done",
    "can", "could", "may", "might", "must", "shall", "should", "will", "would",
]
ENGLISH_CALENDAR = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april",
    "may", "june", "july", "august", "september", "october", "november", "december", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "century", "centuries",
]
ENGLISH_EXTRA = ENGLISH_PRONOUNS + ENGLISH_WEAK_VERBS + ENGLISH_CALENDAR


def base_words(language: str) -> tuple[str, ...]:
    """The public stop list of a language; needs neither a session nor a file."""
    return tuple(BASE[language])


@lru_cache(maxsize=None)
def stop_words(language: str | None) -> tuple[str, ...]:
    """Words dropped for a language, marks included; anything but French and
    English drops both lists."""
    if language == "french":
        words = base_words("french") + tuple(FRENCH_EXTRA) + tuple(PUNCTUATION)
    elif language == "english":
        words = base_words("english") + tuple(ENGLISH_EXTRA) + tuple(PUNCTUATION)
    else:
        words = stop_words("french") + stop_words("english") + tuple(MEASURES)
    return tuple(dict.fromkeys(words))
