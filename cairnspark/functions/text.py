"""Names, tokens and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NOTE_TYPES

# Words that carry no domain signal in notes, English and Spanish.
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "when", "from", "into", "per", "are", "was", "its", "not", "but", "you", "use", "via",
    "bug", "pattern", "decision", "architecture", "testing", "reference", "gotcha", "test", "note",
    "feature", "run", "spec", "scope", "status", "task", "fix", "legacy", "null", "real", "only", "related", "new", "set", "one", "never",
    "que", "para", "con", "los", "las", "del", "una", "por", "como", "este", "esta", "esto", "pero", "desde", "sobre", "entre", "sin", "hay", "son", "más",
)
# Class names too common to be a note's subject.
COMMON_SYMBOLS = (
    "Jackson", "Package", "Feature", "Widgets", "Item", "String", "Object", "List", "Map", "Props", "State", "Context", "Provider", "Component",
    "Element", "Ref", "Fragment", "Children", "Store", "Handler", "Server", "Client", "Config", "Service",
)


def author_slug(author: Column) -> Column:
    """Lower case, each other character than a-z and 0-9 a dash, dashes trimmed; empty: local."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(author, F.lit(""))), "[^a-z0-9]", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("local"))


def type_of_topic(topic_key: Column) -> Column:
    """The part before the first slash if it is a note type, else empty."""
    head = F.substring_index(topic_key, "/", 1)
    return F.when(topic_key.contains("/") & head.isin(*NOTE_TYPES), head).otherwise("")


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def squeeze(text: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def domain_tokens(topic_key: Column, title: Column, content: Column) -> Column:
    """Distinct tokens of a note in order of appearance: ASCII letters and digits, lower-cased after the
    split, of 3 and more, no stop words, no bare numbers. The topic's part before a slash is left out."""
    key = F.when(topic_key.contains("/"), F.regexp_replace(topic_key, "^[^/]*/", "")).otherwise(topic_key)
    raw = F.split(F.concat_ws(" ", key, title, content), "[^A-Za-z0-9]+")
    low = F.transform(raw, F.lower)
    return F.array_distinct(F.filter(low, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS) & ~t.rlike("^[0-9]+$")))


def symbols(content: Column) -> Column:
    """Distinct capitalised identifiers of 3 and more characters in order, without COMMON_SYMBOLS."""
    found = F.regexp_extract_all(content, F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9]{2,})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, COMMON_SYMBOLS)))


def search_terms(query: Column) -> Column:
    """White-space separated terms, each quoted (quotes doubled), joined by OR."""
    terms = F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def sync_id(scope: Column, topic_key: Column) -> Column:
    return F.concat(F.lit("obs-"), F.substring(F.sha2(F.concat(scope, F.lit("\0"), topic_key), 256), 1, 24))


def tag(text: Column) -> Column:
    """A scenario tag without white space around it and its @."""
    return F.regexp_replace(F.trim(text), "^@", "")


def strip_test_suffix(name: Column) -> Column:
    """Without a trailing Tests, Test or IT; null where there is none or nothing else."""
    base = F.regexp_replace(name, "(?:Tests|Test|IT)$", "")
    return F.when((base != name) & (base != ""), base)


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters of at most so many UTF-8 bytes."""
    head = F.substring(F.encode(text, "UTF-8"), 1, limit)
    whole = F.regexp_replace(F.decode(head, "ISO-8859-1"), "[À-ÿ][\u0080-¿]*$", "")
    last = F.regexp_extract(F.decode(head, "ISO-8859-1"), "([À-ÿ][\u0080-¿]*)$", 1)
    need = F.when(last.rlike("^[ð-ÿ]"), 4).when(last.rlike("^[à-ï]"), 3).otherwise(2)
    kept = F.when((last == "") | (F.length(last) == need), F.decode(head, "ISO-8859-1")).otherwise(whole)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.encode(kept, "ISO-8859-1"), "UTF-8"))


def complexity(span: Column) -> Column:
    """1 to 2: longer symbols weigh more, up to 60 lines."""
    return F.lit(1.0) + F.least(F.greatest(span, F.lit(0)), F.lit(60)) / F.lit(60.0)


def quantise(similarity: Column) -> Column:
    return F.round(similarity * 10000).cast("int")


def parse_time(text: Column, otherwise: Column) -> Column:
    """A timestamp; a malformed one counts as `otherwise`."""
    return F.coalesce(F.try_to_timestamp(text), otherwise)
