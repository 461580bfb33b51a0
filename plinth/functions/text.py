"""Tokens, folding and other text expressions; all of them stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _marks() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by Unicode decomposition."""
    have, bare = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            have.append(c)
            bare.append(parts[0])
    return "".join(have), "".join(bare)


_WITH, _BARE = _marks()
#: Marks that stand behind their letter in decomposed text.
_COMBINING = "".join(chr(c) for c in range(0x300, 0x370))


def fold(c: Column) -> Column:
    """Lower case without diacritics, also those of decomposed text."""
    return F.translate(F.lower(c), _WITH + _COMBINING, _BARE)


def tokens(c: Column) -> Column:
    """Folded runs of letters, digits and private-use characters; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(_WITH, _BARE, _COMBINING))


def token_list(text: str) -> list[str]:
    """:func:`tokens` for a text on the driver, such as a query."""
    out, run = [], []
    for c in fold_text(text):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out + (["".join(run)] if run else [])


def query_terms(query: str) -> list[str]:
    """Words of a query; an underscore is part of a word."""
    return re.findall(r"\w+", query)


def phrases(query: str) -> list[list[str]]:
    """Each query word as the run of index tokens that it stands for."""
    return [token_list(term) for term in query_terms(query)]


def in_scope(module: Column, roots: list[str]) -> Column:
    """The module is a root or lies below one, with a dot as the border."""
    hit = F.lit(False)
    for root in roots:
        hit = hit | (module == root) | F.startswith(module, F.lit(root + "."))
    return hit


def without_prefixes(path: Column, prefixes: list[str]) -> Column:
    """The path lies below none of the prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(path, F.lit(p.rstrip("/") + "/"))
    return ~hit


def token_estimate(chars: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(chars / F.lit(4)).cast("long")


def module_path(module: Column) -> Column:
    """Path of a module's file: dots outside «» part folders, the quotes go.

    Quotes that nest or lack their other half raise.
    """
    parts = F.split(module, "«|»")
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit("."), F.lit("/"))).otherwise(x)), "")
    path = F.concat(joined, F.lit(".lean"))
    quoted = F.instr(module, "«") + F.instr(module, "»") > 0
    broken = ~F.rlike(module, F.lit("^[^«»]*(«[^«»]*»[^«»]*)*$"))
    return F.when(quoted & broken, F.raise_error(F.concat(F.lit("BLOCKED_ARTIFACT_INTEGRITY: quotes of module "), module)).cast("string")).otherwise(path)


def candidate_id(source: Column, declaration: Column, row: Column) -> Column:
    """``source::declaration``, or the source row where there is no declaration."""
    return F.concat(source, F.lit("::"), F.coalesce(declaration, row, F.raise_error(F.lit("BLOCKED_PROJECTION_INTEGRITY: neither declaration nor row")).cast("string")))


def last_component(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def parent_name(name: Column) -> Column:
    """All but the last component; null for an undotted name."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def hex_digest(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def is_hex64(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_commit(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{40}$")


def is_repository(c: Column) -> Column:
    """owner/name."""
    return c.rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def repository_name(url: Column) -> Column:
    """owner/name of a hosted git address in any of its usual spellings, else null."""
    text = F.regexp_replace(F.trim(url), r"\.git$", "")
    hosted = F.regexp_extract(text, r"^(?:https://github\.com/|ssh://git@github\.com/|git@github\.com:)(.*)$", 1)
    bare = text.contains("/") & ~text.contains("://") & ~text.contains("@")
    return F.when(hosted != "", hosted).when(bare, text)


def is_inside(path: Column) -> Column:
    """A normal relative path: not absolute, no empty, ``.`` or ``..`` part, no odd mark."""
    return (path != "") & ~path.rlike(r"(^/)|(^|/)\.{1,2}(/|$)|//|/$|\\|\x00")


def is_plain_https(url: Column) -> Column:
    """An absolute https address without user, password or fragment."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.coalesce((part("PROTOCOL") == "https") & (F.length(F.coalesce(part("HOST"), F.lit(""))) > 0) & part("USERINFO").isNull() & part("REF").isNull(), F.lit(False))
