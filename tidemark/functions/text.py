"""Text functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never count as claim tokens.
CLAIM_STOP_WORDS = [
    "yang", "dan", "atau", "dari", "pada", "untuk", "dengan", "dalam", "ini", "itu", "the", "and", "for", "from", "with", "this",
    "that", "sebagai", "akan", "telah", "oleh", "serta", "atas", "ke", "di", "a", "an", "of", "to", "is", "are",
]
CLAIM_TOKEN = "[a-z0-9][a-z0-9._%/-]*"


def strip(x: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def ticker(x: Column) -> Column:
    return F.upper(F.trim(x))


def lower_each(x: Column) -> Column:
    """Lower case code point by code point, so that places in the result are places in ``x``: a dotted capital I stays one
    character, and a capital sigma does not look at its neighbours."""
    return F.lower(F.replace(F.replace(x, F.lit("\u03a3"), F.lit("\u03c3")), F.lit("\u0130"), F.lit("i")))


@cache
def _upper_alone() -> tuple[str, str]:
    """The characters whose upper case is several, and the one that stands for each in a mapping of code points."""
    many = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
    return "".join(many), "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in many)


def upper_each(x: Column) -> Column:
    """Upper case code point by code point: a sharp s becomes a capital one, ligatures stay."""
    many, one = _upper_alone()
    parts = F.split(x, f"(?<=[{many}])|(?=[{many}])")
    each = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{many}]$"), F.translate(p, many, one)).otherwise(F.upper(p))), "")
    return F.when(x.rlike(f"[{many}]"), each).otherwise(F.upper(x))


def normalize_text(x: Column) -> Column:
    """Drop NULs, squeeze blanks and tabs, allow three line feeds in a row at most, strip."""
    x = F.regexp_replace(F.replace(x, F.lit("\x00"), F.lit("")), "[ \t]+", " ")
    return strip(F.regexp_replace(x, "\n{4,}", "\n\n\n"))


def normalize_name(x: Column) -> Column:
    """Lower case, ``_`` and ``-`` as blanks, white space squeezed and stripped."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "_-", "  "), r"(?U)\s+", " "))


def file_suffix(name: Column) -> Column:
    """``.pdf`` of ``Report.PDF``; empty for names without one, dot-files included."""
    base = F.regexp_extract(name, "([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.].*?(\.[^.]+)$", 1))


@cache
def _foreign(least: int = 64) -> str:
    """A character class that holds every code point through which NFKC can change the tokens of a text: those that become
    ASCII letters or digits, and marks, which may join the letter before them. It is all but the runs of ``least`` or more
    code points without such a one, so that the class stays short and common letters are passed at once."""
    runs, start = [], 0
    for n in range(sys.maxunicode + 2):
        c = chr(min(n, sys.maxunicode))
        if n > sys.maxunicode or n >= 0x80 and (unicodedata.category(c)[0] == "M" or any(o < "\x80" and o.isalnum() for o in unicodedata.normalize("NFKC", c))):
            if n - start >= least:
                runs.append((start, n - 1))
            start = n + 1
    return "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def nfkc(x: Column) -> Column:
    """NFKC for token rules. Texts without a character that matters stay in the JVM as they are; only others go to Python."""

    @F.pandas_udf("string")
    def normal(t: pd.Series) -> pd.Series:
        return t.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.coalesce(normal(F.when(x.rlike("[^\\x00-\\x7F]") & x.rlike(_foreign()), x)), x)


def dedup_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(nfkc(x)), F.lit("[a-z0-9]+"), F.lit(0))


def claim_tokens(x: Column) -> Column:
    """Distinct tokens of a claim that are longer than two characters and no stop words."""
    words = F.regexp_extract_all(lower_each(x), F.lit(CLAIM_TOKEN), F.lit(0))
    stop = F.array(*[F.lit(w) for w in CLAIM_STOP_WORDS if len(w) > 2])
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop)


def token_shingles(tokens: Column, width: int = 5) -> Column:
    """Distinct hashes of all token n-grams."""

    def grams(t: Column) -> Column:
        count = F.size(t) - (width - 1)
        each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i + 1, F.lit(width)), "\x1f")))
        return F.when(count >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    # Bound to a variable, the tokens are made once a row and not once an n-gram.
    return F.transform(F.array(tokens), grams)[0]


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Length of the shorter over that of the longer if the longer contains it, else 0."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.when((F.length(long) > 0) & F.contains(long, short), F.length(short) / F.length(long)).otherwise(F.lit(0.0))


def match_share(claim: Column, source: Column) -> Column:
    """Share of the claim's tokens that the source has; both are token arrays."""
    return F.size(F.array_intersect(claim, source)) / F.greatest(F.lit(1), F.size(claim))


def digest(x: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, length)


def safe_filename(name: Column, default: str = "attachment") -> Column:
    """Path separators and runs of unusual characters become ``_``; at most 180 characters."""
    flat = F.regexp_replace(F.translate(name, "/\\", "__"), r"[^A-Za-z0-9._() -]+", "_")
    flat = F.substring(F.regexp_replace(flat, r"^[ .]+|[ .]+$", ""), 1, 180)
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(default)).otherwise(flat)


def slug(x: Column, default: str = "profile") -> Column:
    flat = F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(default)).otherwise(flat)


def percents(line: Column) -> Column:
    """The percentages on a line, decimal comma or point."""
    found = F.regexp_extract_all(line, F.lit(r"(?:^|[^0-9])([0-9]{1,3}(?:[.,][0-9]{1,4})?)\s*%"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def byte_size(n: Column) -> Column:
    """512 B, 1.5 KB, 3.0 MB, ..."""
    n = n.cast("double")
    out = F.format_string("%.0f B", n)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024.0**power, F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def safe_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(F.expr("null").cast("int") if x is None else x.try_cast("int"), F.lit(default))


def placeholders(template: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([a-z_]+)\}"), F.lit(1))))


def render_template(template: Column, values: Column) -> Column:
    """Fill ``{name}`` from a map in one pass, so that a value's own braces are left alone; a missing value is empty."""
    parts = F.split(template, r"(?=\{[a-z_]+\})|(?<=\})")
    fill = lambda p: F.when(
        p.rlike(r"^\{[a-z_]+\}$"), F.coalesce(F.element_at(values, F.regexp_extract(p, r"^\{([a-z_]+)\}$", 1)), F.lit(""))
    ).otherwise(p)
    return F.array_join(F.transform(parts, fill), "")
