"""Scalar functions as column expressions: templates, paths, names, dates, arrays, big-endian integers.

All stay inside the JVM. Functions that .NET defines to throw return null here, or raise where noted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of the properties that a template may name, in the order of their replacement.
TEMPLATE_KEYS = ("Title", "ISBN", "Author", "Publisher", "PubDate", "Series", "SeriesNum")
#: Characters that a file name may not hold.
INVALID_NAME = r'["<>|:*?\\/\x00-\x1F]'
#: Seconds from 1904-01-01 to 1970-01-01.
MOBI_EPOCH = 2082844800


def _lit(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


# ------------------------------------------------------------------ strings, maps and templates


def props(title="title", isbn="isbn", author="author", publisher="publisher", pub_date="pub_date", series="series", series_num="series_num") -> Column:
    """The template properties of a book as a map; a series number of 0 is blank."""
    number = F.when(F.coalesce(F.col(series_num), F.lit(0.0)) == 0, "").otherwise(F.regexp_replace(F.col(series_num).cast("string"), r"\.0$", ""))
    values = [F.col(title), F.col(isbn).cast("string"), F.col(author), F.col(publisher), F.col(pub_date).cast("string"), F.col(series), number]
    return F.create_map(*[x for k, v in zip(TEMPLATE_KEYS, values) for x in (F.lit(k), F.coalesce(v, F.lit("")))])


def dict_format(template, values: dict[str, Column | str]) -> Column:
    """``{key}`` replaced key after key (so a value may bring in a later key), blanks and empty brackets tidied."""
    out = _lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(_lit(value).cast("string"), F.lit("")))
    out = F.regexp_replace(out, " {2,}", " ")
    for pair in ("[]", "{}", "()"):
        out = F.replace(out, F.lit(pair), F.lit(""))
    return F.trim(out)


def map_format(template, entries: Column, keys=TEMPLATE_KEYS) -> Column:
    return dict_format(template, {k: F.try_element_at(entries, F.lit(k)) for k in keys})


def filesystem_safe(path, separator: str = "\\") -> Column:
    """Characters that a file name may not hold become one underscore; the first segment (the drive) stays."""
    parts = F.split(_lit(path), "\\\\" if separator == "\\" else separator)

    def clean(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, rf"({INVALID_NAME}*\.+$)|({INVALID_NAME}+)", "_"), "_{2,}", "_")

    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(clean(x))), separator)


def extension(path) -> Column:
    """With the dot, in the case given; blank if there is none."""
    return F.regexp_extract(_lit(path), r"(\.[^./\\]*)$", 1)


def basename(path) -> Column:
    return F.regexp_extract(_lit(path), r"([^/\\]*)$", 1)


def change_extension(path, new: str) -> Column:
    return F.concat(F.regexp_replace(_lit(path), r"\.[^./\\]*$", ""), F.lit(new))


def relative_path(path, root: str) -> Column:
    return F.when(F.startswith(_lit(path), F.lit(root)), F.ltrim(F.substring(_lit(path), len(root) + 1, 1 << 30), F.lit("\\/"))).otherwise(_lit(path))


def absolute_path(path, root: str, separator: str = "\\") -> Column:
    return F.concat(F.lit(root.rstrip("\\/") + separator), _lit(path))


def file_path_template(directory_format: str, title_template: str | None = None, separator: str = "\\") -> str:
    """The template of a book's path below its root; ``title_template`` replaces the plain title."""
    return separator.join(x for x in (directory_format, title_template or "{Title}") if x)


def format_file_path(template: str, entries: Column, file_path, separator: str = "\\") -> Column:
    """A book's path below the root: the filled template and the file's extension, made safe, segments trimmed."""
    full = F.concat(F.lit("root" + separator), map_format(template, entries), extension(file_path))
    parts = F.split(filesystem_safe(full, separator), "\\\\" if separator == "\\" else separator)
    return F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.trim(x)), separator)


def sort_author(author) -> Column:
    """``Charles Dickens`` as ``Dickens, Charles``; a single name as it is."""
    words = F.split(_lit(author), " ")
    return F.when(F.size(words) == 1, _lit(author)).otherwise(F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")))


def truncate(text, n: int) -> Column:
    return F.substring(_lit(text), 1, n)


def map_get(entries: Column, key, default=None) -> Column:
    return F.coalesce(F.try_element_at(entries, _lit(key)), _lit(default))


def split_subjects(text) -> Column:
    return F.transform(F.split(_lit(text), ","), lambda x: F.trim(x))


def join_subjects(subjects: Column) -> Column:
    return F.array_join(subjects, ", ")


def pdb_title(title) -> Column:
    """32 characters, padded with NUL, spaces as underscores."""
    return F.rpad(F.translate(F.substring(_lit(title), 1, 32), " ", "_"), 32, "\0")


def encode_utf8(text) -> Column:
    return F.encode(_lit(text), "UTF-8")


def decode_utf8(data) -> Column:
    return F.decode(_lit(data), "UTF-8")


def byte_char(b) -> Column:
    return F.chr(_lit(b).cast("int"))


# ------------------------------------------------------------------ dates and numbers


def parse_date(text) -> Column:
    """The date of the first ten characters, as year, month or day, or as month/day/year; null if none fits."""
    head = F.substring(_lit(text), 1, 10)
    forms = ((r"^\d{4}$", "yyyy"), (r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))
    return F.coalesce(*[F.when(head.rlike(form), F.try_to_timestamp(head, F.lit(pattern))) for form, pattern in forms]).cast("date")


def normalize_date(text, today=None, strict: bool = False) -> Column:
    """As month/day/year. A blank gives ``today`` if that is given (then as MM/dd/yyyy), else null."""
    parsed = F.date_format(parse_date(text), "M/d/yyyy")
    blank = F.date_format(_lit(today).cast("date"), "MM/dd/yyyy") if today is not None else F.lit(None).cast("string")
    other = F.coalesce(parsed, F.raise_error(F.concat(F.lit("not a date: "), _lit(text))).cast("string")) if strict else parsed
    return F.when(_lit(text) == "", blank).when(_lit(text).isNotNull(), other)


def iso_date(text) -> Column:
    """``12/31/1999`` as ``1999-12-31``."""
    return F.date_format(F.to_date(F.try_to_timestamp(_lit(text), F.lit("M/d/yyyy"))), "yyyy-MM-dd")


def mobi_timestamp(at) -> Column:
    """Seconds since 1904-01-01 of a timestamp or date."""
    return F.unix_seconds(_lit(at).cast("timestamp")) + F.lit(MOBI_EPOCH)


def random_number(digits: int = 3, seed: int | None = None) -> Column:
    """Uniform from 1 to 10 ** digits - 2."""
    return (F.floor(F.rand(seed) * (10**digits - 2)) + 1).cast("long")


def float_to_text(x) -> Column:
    """Blank for null and 0."""
    return F.when(F.coalesce(_lit(x), F.lit(0)) == 0, "").otherwise(F.regexp_replace(_lit(x).cast("string"), r"\.0$", ""))


def text_to_float(text) -> Column:
    return F.when(~_lit(text).rlike(r"[^0-9.\-]+"), _lit(text).try_cast("float"))


def one_decimal(x) -> Column:
    return F.format_string("%.1f", _lit(x).cast("double"))


def visibility(flag) -> Column:
    """Visible for true; Collapsed for false and null."""
    return F.when(F.coalesce(_lit(flag), F.lit(False)), "Visible").otherwise("Collapsed")


def is_visible(text) -> Column:
    return F.coalesce(_lit(text) == "Visible", F.lit(False))


def is_numeric_text(text) -> Column:
    return ~_lit(text).rlike(r"[^0-9.\-]+")


def base32(text) -> Column:
    """The number that digits 0-9 and A-V in either case stand for; null if other characters or none are there."""
    return F.when(_lit(text).rlike("^[0-9A-Va-v]+$"), F.conv(_lit(text), 32, 10).cast("decimal(20,0)"))


def bit_count(x) -> Column:
    return F.bit_count(_lit(x))


def extra_data_flags(flags) -> Column:
    """(multibyte, trailers) of a MOBI header's extra data flags."""
    return F.struct((_lit(flags).bitwiseAND(F.lit(1)) == 1).alias("multibyte"), F.bit_count(F.shiftright(_lit(flags), 1)).alias("trailers"))


# ------------------------------------------------------------------ arrays and binary


def last(a) -> Column:
    return F.element_at(a, -1)


def insert_after(a, i: int, b) -> Column:
    """``b`` put in after place ``i`` (from 0)."""
    return F.concat(F.slice(a, 1, i + 1), b, F.slice(a, F.lit(i + 2), F.greatest(F.size(a) - (i + 1), F.lit(0))))


def append(a, b) -> Column:
    return F.concat(a, b)


def append_item(a, item) -> Column:
    return F.array_append(a, item)


def sub_array(a, i: int, n: int = -1) -> Column:
    """``n`` values from place ``i`` (from 0); all that follow for -1."""
    return F.slice(a, F.lit(i + 1), F.lit(n) if n >= 0 else F.greatest(F.size(a) - i, F.lit(0)))


def replace_at(a, new, i: int) -> Column:
    return F.concat(F.slice(a, 1, i), new, F.slice(a, F.lit(i + 1) + F.size(new), F.greatest(F.size(a) - i - F.size(new), F.lit(0))))


def total_length(arrays) -> Column:
    return F.aggregate(arrays, F.lit(0), lambda n, x: n + F.size(x))


def sub_binary(data, offset, length) -> Column:
    return F.substring(_lit(data), _lit(offset) + 1, _lit(length))


def big_endian(data, offset: int, size: int, signed: bool = False) -> Column:
    """The integer in ``size`` bytes from ``offset``, as decimal(20,0); null if the bytes aren't there."""
    part = F.substring(_lit(data), offset + 1, size)
    value = F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")
    if signed:
        value = F.when(value >= F.lit(str(2 ** (8 * size - 1))).cast("decimal(20,0)"), value - F.lit(str(2 ** (8 * size))).cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")
    return F.when(F.octet_length(part) == size, value)


def big_endian_bytes(n, size: int) -> Column:
    """The low ``size`` bytes of an integer, most significant first."""
    digits = F.hex(_lit(n).cast("long")) if size < 8 else F.conv(_lit(n).cast("string"), 10, 16)
    return F.unhex(F.right(F.lpad(digits, 16, "0"), F.lit(2 * size)))
