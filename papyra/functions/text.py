"""Column functions over strings: tokens, identifiers, names, similarity.

All of them are built-in expressions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the plain letters they fold to (fixed values).
MARKED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccddeeeeeeeeegggghiiiiiiiiijklllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"
WORD = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without Latin marks; a text of ASCII alone has none to look for."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, MARKED, PLAIN))


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def word_set(text: Column) -> Column:
    """Distinct lower-case words (letters, marks, digits and _)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1)))


def title_words(text: Column) -> Column:
    """Distinct lower-case words of a title, marks dropped and not split at:
    ``don't`` is ``dont``."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s\p{Z}]", "")
    return F.array_distinct(F.array_remove(F.split(bare, r"[\s\p{Z}]+"), ""))


def dice(a: Column, b: Column) -> Column:
    """2|A∩B| / (|A|+|B|) of the word sets of two titles, 0 if either is empty."""
    x, y = title_words(a), title_words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def similar_title(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or four fifths of the larger word set shared."""
    p, q = F.lower(F.trim(a)), F.lower(F.trim(b))
    x, y = word_set(p), word_set(q)
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))
    return (F.length(p) > 0) & (F.length(q) > 0) & ((p == q) | p.contains(q) | q.contains(p) | (share > 0.8))


def overlap_ratio(of: Column, other: Column) -> Column:
    """Share of the words of four letters and more in ``of`` that ``other`` has."""
    long_words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{M}\p{N}_]{4,})"), F.lit(1)))
    x = long_words(of)
    return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, long_words(other))) / F.size(x))


def normal_tag(tag: Column) -> Column:
    """Lower, blanks and _ as -, no doubled or outer -."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), r"[\s_]+", "-"), "-{2,}", "-")
    return F.regexp_replace(joined, "^-+|-+$", "")


def alias_phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), r"\s+", " "))


def normal_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[-_/]+", " "), r"\s+", " "))


def clean_doi(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(text), r"(?i)^https?://(dx\.)?doi\.org/", "")))


def arxiv_key(text: Column) -> Column:
    """Identifier without prefix, address and version; '' where it is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(https?://(www\.)?arxiv\.org/(abs|pdf)/|arxiv:)\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"v\d+$", "")
    return F.when(bare.rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[a-z]{2})?/\d{7})$"), bare).otherwise(F.lit(""))


def arxiv_of_doi(doi: Column) -> Column:
    return F.regexp_extract(F.lower(doi), r"^10\.48550/arxiv\.(.+)$", 1)


def year_of(text: Column) -> Column:
    return F.regexp_extract(text, r"\b(1[89]\d{2}|20\d{2})\b", 1)


def flipped_name(name: Column) -> Column:
    """'Last, First' as 'First Last'."""
    return F.trim(F.regexp_replace(F.trim(name), r"^([^,]*),\s*(.*)$", "$2 $1"))


def last_name(name: Column) -> Column:
    """Family name with its particles; of a name in Han script the first sign;
    initials in last place ('Smith J') leave the word before them."""
    flipped = F.when(name.contains(","), F.trim(F.split(name, ",")[0])).otherwise(F.trim(name))
    words = F.split(flipped, r"\s+")
    size = F.size(words)
    last = F.element_at(words, -1)
    initials = (size > 1) & last.rlike(r"^([A-Z]\.?){1,2}$")
    particle = (size > 2) & F.lower(F.get(words, size - 2)).isin("van", "von", "der", "den", "de", "di", "da", "del", "la", "le", "ter", "ten")
    return (
        F.when(flipped.rlike(r"^\p{IsHan}"), F.substring(flipped, 1, 1))
        .when(name.contains(","), flipped)
        .when(initials, F.get(words, F.lit(0)))
        .when(particle, F.concat_ws(" ", F.get(words, size - 2), last))
        .otherwise(last)
    )


#: Words that carry no topic in titles (fixed values).
TITLE_STOPS = ["a", "an", "the", "of", "in", "on", "for", "and", "to", "with", "by", "from", "at", "is", "are", "as", "its", "via", "using"]


def title_keywords(title: Column) -> Column:
    words = F.regexp_extract_all(F.lower(title), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    return F.array_join(F.slice(F.filter(words, lambda w: ~w.isin(TITLE_STOPS)), 1, 8), " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def match_key(text: Column) -> Column:
    return F.regexp_replace(title_key(text), r"[^\p{L}\p{M}\p{N}_]+", "")


def clean_title(title: Column) -> Column:
    """Without tags, formulas, commands and signs."""
    out = F.regexp_replace(title, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"\$[^$]*\$", "")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+(\{([^}]*)\})?", "$2")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s-]", " "), r"\s+", " "))


def file_stem(last: Column, year: Column, title: Column) -> Column:
    """Last-Year-Title, each with its default."""
    short = F.regexp_replace(F.array_join(F.slice(F.split(clean_title(title), r"\s+"), 1, 8), "-"), "-{2,}", "-")
    part = lambda c, default: F.coalesce(F.when(F.length(F.trim(c)) > 0, F.regexp_replace(F.trim(c), r"\s+", "-")), F.lit(default))
    return F.concat_ws("-", part(last, "Unknown"), part(year.cast("string"), "XXXX"), part(short, "Untitled"))


def plain_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(\*\*|__)(.+?)\1", "$2"), r"[*`]([^*`]+)[*`]", "$1")


def is_language_code(text: Column) -> Column:
    return text.rlike("^[a-z]{2,5}$")


def split_tags(text: Column) -> Column:
    """Tags of a comma-separated list, blanks and empty ones dropped."""
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), "")
