"""Column functions with Python's text semantics, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
EOS = "<EOS>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once however often f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, _EDGES, "")


def strip_right(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+$", "")


def words(c: Column | str) -> Column:
    """Runs between Unicode white space; no empty ones."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def collapse(c: Column | str) -> Column:
    """Words joined by one blank; null becomes empty."""
    return F.coalesce(F.array_join(words(c), " "), F.lit(""))


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def comma_token(c: Column | str) -> Column:
    """Collapsed, with the dialogue corpora's comma token spelled out."""
    return collapse(F.replace(c, F.lit("_comma_"), F.lit(",")))


def bounded(c: Column | str, limit: int = 220) -> Column:
    """At most `limit` characters: cut at the last blank and closed by three dots."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.substring(c, 1, limit - 3)
    short = strip_right(F.regexp_replace(head, r" [^ ]*$", ""))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.when(short == "", head).otherwise(short), F.lit("...")))


def any_of(column: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | column.rlike(p)
    return out


#: Restrictions that win over any grant, on upper-case labels whose
#: other characters are blanks.
LICENSE_DENIED = (
    "NON COMMERCIAL|NONCOMMERCIAL|NO DERIVATIVES|SHARE ALIKE|SHAREALIKE",
    r"(?:^| )(?:NC|ND|SA)(?: |$)",
)
#: Grants, on upper-case labels with single blanks.
LICENSE_ALLOWED = (
    "PUBLIC DOMAIN",
    r"\bCC0(?:\b|[- ])",
    r"\bCC[\s-]*BY(?:[\s-]*(?:2(?:\.0|\.5)?|3(?:\.0)?|4(?:\.0)?))?(?:\b|$)",
    "CREATIVE COMMONS ATTRIBUTION",
    r"\bAPACHE(?: LICENSE)?[\s-]*2(?:\.0)?\b",
    r"\bODC[\s-]*BY(?:[\s-]*1(?:\.0)?)?\b",
    "LICENCE OUVERTE|OPEN GOVERNMENT LICENCE V3",
)
#: Fixed value: the one label that must match as a whole.
LICENSE_WHOLE = r"^MIT(?: LICENSE)?$"


def license_allowed(label: Column | str) -> Column:
    """True for explicit public-domain and permissive labels only; null is no label."""
    upper = F.upper(collapse(label))
    compact = F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", " "))
    return (
        F.when(upper == "", F.lit(False))
        .when(any_of(compact, *LICENSE_DENIED), F.lit(False))
        .otherwise(any_of(upper, *LICENSE_ALLOWED) | compact.rlike(LICENSE_WHOLE))
    )


#: A licence sentence on a line of its own.
LICENSE_LINE = r"(?m)^(?:Released|Licensed) under (?:the )?([^\n]+?)\.?$"


def license_label(text: Column | str) -> Column:
    """The label of a text's first licence sentence; null without one."""
    found = F.regexp_extract(text, LICENSE_LINE, 1)
    return F.when(found != "", found)


def characters(c: Column | str) -> Column:
    """Code points of a text, in order."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def eos_parts(c: Column | str) -> Column:
    """A text's parts between end markers."""
    return F.split(c, EOS, -1)


def json_object(c: Column | str) -> Column:
    """A text's JSON object as a variant; null for bad JSON, anything but an object,
    and an object that has a key twice."""
    return let(F.try_parse_json(c), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a seeded key; the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def seeded(seed: int, key: Column | str) -> Column:
    """The MD5 that seeded orders sort by."""
    return F.md5(F.concat(F.lit(f"{seed}-"), (F.col(key) if isinstance(key, str) else key).cast("string")))
