"""Checks and parsers that run on the driver."""

from __future__ import annotations

import re


def year_range(text: str) -> tuple[str | None, str | None]:
    """'2023', '2020-2024', '2020-' or '-2024' as (from, to); a bare '-' is no bound."""
    text = text.strip()
    if re.fullmatch(r"\d{4}", text):
        return text, text
    if m := re.fullmatch(r"(\d{4})?-(\d{4})?", text):
        return m[1], m[2]
    raise ValueError(f"not a year or a range of years: {text!r}")


def safe_name(name: str) -> str:
    """A name that is one path part and no hidden file."""
    if not re.fullmatch(r"[\w][\w.\- ]*", name) or ".." in name or name != name.strip():
        raise ValueError(f"not a valid name: {name!r}")
    return name


def sanitized_query(text: str) -> str:
    return re.sub(r"[^\w\s]", " ", text).strip()


def remote_filter(year: str = "", issn: str = "", concept: str = "", author: str = "", min_citations: int = 0, kind: str = "") -> str:
    """Predicate text of a catalogue request; bounds of 0 and less are left out."""
    parts = []
    if year:
        a, b = year_range(year)
        parts += [f"from_publication_date:{a}-01-01"] * bool(a) + [f"to_publication_date:{b}-12-31"] * bool(b)
    for key, value in (("primary_location.source.issn", issn), ("concepts.id", concept), ("authorships.author.id", author), ("type", kind)):
        if value:
            parts.append(f"{key}:{value}")
    if min_citations > 0:
        parts.append(f"cited_by_count:>{min_citations - 1}")
    return ",".join(parts)


def sort_order(wanted: str | None, keyword: str | None) -> str:
    return wanted or ("relevance_score:desc" if keyword else "publication_year:asc")


def merged_config(base: dict, local: dict) -> dict:
    """``local`` over ``base``, tables merged into each other."""
    out = dict(base)
    for k, v in local.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
