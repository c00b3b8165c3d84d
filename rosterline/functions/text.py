"""Text scalars: presence, cleaning, e-mail and phone patterns, hashes, names.

Java's ``\\w``, ``\\b`` and ``\\s`` are narrower than the Unicode-aware ones the
semantics call for, so the classes are spelled out here once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
DIGITS_ONLY = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+\z"

# The e-mail and phone patterns that define a match. The pipe inside
# the top-level-domain class is part of the pattern.
EMAIL_BODY = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
# Each pattern opens with a look at its first character, so that most positions fail cheaply.
EMAIL = r"(?=[A-Za-z0-9._%+-])" + EDGE + EMAIL_BODY + EDGE
PHONE_PATTERNS = [
    r"(?=\p{Nd})" + EDGE + r"\p{Nd}{3}[-.]?\p{Nd}{3}[-.]?\p{Nd}{4}" + EDGE,
    r"(?=\()" + EDGE + r"\(\p{Nd}{3}\)" + SPACE + r"*\p{Nd}{3}[-.]?\p{Nd}{4}" + EDGE,
    r"(?=\+)" + EDGE + r"\+\p{Nd}{1,3}(?:[-.]|" + SPACE + r")?\(?\p{Nd}{1,4}\)?(?:[-.]|" + SPACE + r")?\p{Nd}{1,4}(?:[-.]|"
    + SPACE + r")?\p{Nd}{1,9}" + EDGE,
]


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, inside one row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(c: ColumnLike, dtype: T.DataType | None = None) -> Column:
    """True where a value counts as given: not null, ``''``, 0 or false."""
    c = as_column(c)
    if dtype is None or isinstance(dtype, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != F.lit(0))
    if isinstance(dtype, T.ArrayType | T.MapType):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def py_strip(c: ColumnLike) -> Column:
    """Strip every Unicode whitespace character at both ends, not just U+0020."""
    return F.regexp_replace(as_column(c), rf"^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def clean_text(c: ColumnLike) -> Column:
    """Collapse whitespace, keep word characters and basic punctuation, strip."""
    one_spaced = F.regexp_replace(F.coalesce(as_column(c), F.lit("")), SPACE + "+", " ")
    return F.trim(F.regexp_replace(one_spaced, r"[^\p{L}\p{N}_ @.,;:!?()\-]", ""))


def truncate_text(c: ColumnLike, max_length: int = 500) -> Column:
    c = as_column(c)
    return F.when(F.length(c) <= max_length, c).otherwise(
        F.concat(F.substring(c, 1, max_length), F.lit("..."))
    )


def content_hash(c: ColumnLike) -> Column:
    return F.sha2(as_column(c), 256)


def tokens(c: ColumnLike) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(as_column(c), SPACE + "+"), lambda t: t != "")


def reading_time_s(c: ColumnLike, wpm: int = 200) -> Column:
    """Whole seconds to read the text at ``wpm`` words per minute."""
    return ((F.size(tokens(c)).cast("double") / F.lit(float(wpm))) * 60).cast("bigint")


def extract_emails(c: ColumnLike) -> Column:
    """Every e-mail address in order, duplicates kept."""
    c = as_column(c)
    return F.when(c.contains("@"), F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))).when(
        c.isNotNull(), F.array().cast("array<string>")
    )


def extract_phones(c: ColumnLike) -> Column:
    """Phone numbers, listed pattern by pattern, duplicates kept."""
    c = as_column(c)
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in PHONE_PATTERNS])


def first_email(c: ColumnLike) -> Column:
    c = as_column(c)
    return F.coalesce(F.when(c.contains("@"), F.regexp_substr(c, F.lit(EMAIL))), F.lit(""))


def first_phone(c: ColumnLike) -> Column:
    c = as_column(c)
    return F.coalesce(*[F.regexp_substr(c, F.lit(p)) for p in PHONE_PATTERNS], F.lit(""))


def email_valid(c: ColumnLike) -> Column:
    """Whole-value e-mail check; like Python's ``$`` it lets one newline trail."""
    return as_column(c).rlike("^" + EMAIL_BODY + r"\n?\z")


def name_parts(c: ColumnLike) -> Column:
    """struct(first, middle, last, full) from whitespace tokens."""
    c = as_column(c)
    words = tokens(c)
    count = F.size(words)
    return F.struct(
        F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("first"),
        F.when(count > 2, F.array_join(F.slice(words, F.lit(2), F.greatest(count - 2, F.lit(0))), " "))
        .otherwise("").alias("middle"),
        F.when(count > 1, F.get(words, count - 1)).otherwise("").alias("last"),
        c.alias("full"),
    )


def key_part(c: Column, dtype: T.DataType | None = None) -> Column:
    """Lower-cased, stripped text of a present value, else null."""
    return F.when(present(c, dtype), py_strip(F.lower(c.cast("string"))))


def dedup_key(columns: dict[str, T.DataType], fields: list[str]) -> Column:
    """Present key values joined by a pipe; null where no field is present."""
    parts = [key_part(F.col(f"`{f}`"), columns[f]) for f in fields if f in columns]
    if not parts:
        return F.lit(None).cast("string")
    has_any = F.coalesce(*parts).isNotNull()
    return F.when(has_any, F.concat_ws("|", *parts))


def record_id(page_url: ColumnLike, name: ColumnLike, email: ColumnLike, source_url: ColumnLike) -> Column:
    """Stable 16-hex id: page URL, else name and e-mail, else source URL."""
    url, name, email = as_column(page_url), as_column(name), as_column(email)
    parts = [key_part(name), key_part(email)]
    basis = F.coalesce(
        F.when(present(url), url),
        F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("|", *parts)),
        as_column(source_url),
    )
    return F.substring(F.sha2(basis, 256), 1, 16)
