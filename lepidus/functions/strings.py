"""Names, keys, numbers and sections out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(c: Column, rule: str = "file") -> Column:
    """Names made safe.  "file": all but word characters, - _ . become _; "strict": only ASCII letters, digits, _ and - stay; "species": all but ASCII letters, digits and _ become _; "label": as "file", but blanks stay and the rest goes."""
    pattern, by = {"file": (r"[^\w\-.]", "_"), "strict": (r"[^A-Za-z0-9_\-]", ""), "species": (r"[^A-Za-z0-9_]", "_"), "label": (r"[^\w.\- ]", "")}[rule]
    return F.regexp_replace(c, pattern, by)


def canonical(c: Column) -> Column:
    """Key of a file name: no extension, only ASCII letters, digits and _, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"[^A-Za-z0-9_]", ""))


def stem(c: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """Text before ".jpg", else before the first dot; with ``suffixes``, one of these at the end goes first."""
    if suffixes:
        c = F.regexp_replace(c, f"(?:{'|'.join(suffixes)})$", "")
    return F.when(F.contains(c, F.lit(".jpg")), F.substring_index(c, ".jpg", 1)).otherwise(F.substring_index(c, ".", 1))


def normalised(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))


def tokens(c: Column) -> Column:
    """The words of normalised(), in one pass less."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")


def section(c: Column, start: str) -> Column:
    """The lines from one that begins with ``start`` to the next blank line, without that first line; "" if there is none."""
    return F.trim(F.regexp_extract(c, rf"(?s)(?:^|\n){start}[^\n]*\n(.*?)(?:\n[ \t]*\n|$)", 1))


def first_sentence(c: Column) -> Column:
    return F.substring_index(c, ". ", 1)


def json_block(c: Column) -> Column:
    """A JSON object from a fenced block, else from the outermost braces, with closing braces that are missing added; null if there is none."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?)\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"(?s)(\{.*)", 1), F.lit("")))
    count = lambda ch: F.length(body) - F.length(F.replace(body, F.lit(ch), F.lit("")))
    return F.concat(body, F.repeat(F.lit("}"), F.greatest(count("{") - count("}"), F.lit(0))))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def windows(words: Column, size: int = 70, stride: int = 35) -> Column:
    """Overlapping windows of an array, a stride apart until the start passes its end; the short ones at the end stay."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride)), lambda s: s < F.size(words))
    return F.transform(starts, lambda s: F.slice(words, s + 1, size))


def wrapped(c: Column, width: int = 80) -> Column:
    """Lines of at most ``width``, broken at blanks: a fold, as each line depends on the one before."""

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.lit(" "), w)
        fits = F.length(joined) <= width
        return F.when(F.size(acc) == 0, F.array(w)).when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(w)))

    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.aggregate(words, F.array().cast("array<string>"), step), "\n")


def versioned(c: Column) -> Column:
    """A file name with _V{n + 1} for _V{n}, or _V1."""
    base, ext = F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"_V\d+$", ""), F.regexp_extract(c, r"(\.[^.]*)$", 1)
    n = F.coalesce(F.nullif(F.regexp_extract(c, r"_V(\d+)(?:\.[^.]*)?$", 1), F.lit("")).cast("int"), F.lit(0)) + 1
    return F.concat(base, F.lit("_V"), n.cast("string"), ext)


def key_features(c: Column) -> Column:
    """What sets a species apart: the first sentence of its Diagnosis section, else of its QA section, with its full stop; null if it has neither."""
    first = lambda x: F.when(F.contains(x, F.lit(". ")), F.concat(first_sentence(x), F.lit("."))).otherwise(x)
    return F.coalesce(first(F.nullif(section(c, "Diagnosis"), F.lit(""))), first(F.nullif(section(c, "QA"), F.lit(""))))


def feature_line(name: Column, features: Column) -> Column:
    """"name: a; b" of an array of features."""
    return F.concat(name, F.lit(": "), F.array_join(features, "; "))


def parsed_features(c: Column) -> Column:
    """map of name -> features, of lines "name: a; b"."""
    lines_ = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit(": ")))
    return F.map_from_entries(F.transform(lines_, lambda x: F.struct(F.substring_index(x, ": ", 1), F.split(F.regexp_replace(x, "^.*?: ", ""), "; "))))


def without_keys(c: Column, key: str = "Dichotomous Key:", stop: str = "Species Description for") -> Column:
    """Text without its old key sections, each of which goes up to ``stop``, which stays, or to the end."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?s){key}.*?(?={stop}|\z)", ""), r"^\s+|\s+$", "")


def with_key(c: Column, key: Column) -> Column:
    """Text and a new key after it."""
    ends = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.concat(ends(c), F.lit("\n\n"), ends(key), F.lit("\n"))


def listed(c: Column) -> Column:
    """The items of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def floats(c: Column) -> Column:
    """The numbers of a comma list; null where an item isn't one."""
    return F.transform(listed(c), lambda x: x.try_cast("double"))


def block_species(c: Column) -> Column:
    """The species that a block's header names, else unknown_species."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(c, r"(?i)species description for\s+\*?([^\n:*]+)", 1)), F.lit("")), F.lit("unknown_species"))


def fixed(c: Column, digits: int) -> Column:
    """A double as text of ``digits`` decimals (1 to 14) as C's printf writes it: rounded by its binary value, exact halves to even.

    format_string() rounds the shortest decimal that reads back as the double, halves up: it serves what is clearly beside a half.
    Else, what a product of doubles rounds off is found by splitting the factor in two (Dekker).  From 2**63 on, where
    doubles have no decimals, the digits are format_string()'s.
    """
    c = c.cast("double")
    a = F.abs(c)
    whole = F.floor(a)
    part, m = a - F.floor(a).cast("double"), 2.0 * 10**digits
    high = part * 134217729.0 - (part * 134217729.0 - part)
    p = part * m
    rest = (high * m - p) + (part - high) * m
    n = F.floor(p / 2.0)
    half = 2 * n + 1
    up = (p > half) | (p == half) & ((rest > 0) | (rest == 0) & (n % 2 == 1))
    n = n + F.when(up, 1).otherwise(0)
    over = n == 10**digits
    sign = F.when((c < 0) | (c == 0) & F.startswith(c.cast("string"), F.lit("-")), "-").otherwise("")
    text = F.concat(sign, (whole + F.when(over, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad(F.when(over, 0).otherwise(n).cast("string"), digits, "0"))
    plain = F.format_string(f"%.{digits}f", c)
    exact = F.when(F.isnan(c), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a < 2.0**63, text).otherwise(plain)
    near = (a * m >= 2.0**30) | (F.abs(a * m - 2.0 * F.floor(a * m / 2.0) - 1.0) < 1e-6)
    return F.when(near, exact).when(c.isNotNull(), plain)
