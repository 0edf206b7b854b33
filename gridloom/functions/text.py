"""Text as columns: number detection, plain decimals, signatures, distances and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a run of digits, each with an optional sign, point or comma before it.
NUMBER = r"(?:(?:\+)?(?:-)?(?:\.)?(?:,)?[0-9])+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number_kind(value: Column, allow_chars: list[str] | None = None) -> Column:
    """'value', 'attribute' or 'empty' for a cell's text. allow_chars: characters that a number may hold besides."""
    number, marks = NUMBER, r"+\-.,"
    if allow_chars:
        extra = "".join(rf"(?:{_escaped(x)})?" for x in allow_chars)
        number, marks = rf"(?:(?:\+)?(?:-)?(?:\.)?(?:,)?{extra}[0-9])+", marks + "".join(map(_escaped, allow_chars))
    t = trimmed(F.coalesce(value, F.lit("")))
    found = F.regexp_extract_all(t, F.lit(f"({number})"), 1)
    rest = F.regexp_replace(t, number, "")
    bare = trimmed(F.regexp_replace(rest, f"[{marks}]+", "")) == ""
    digits = F.regexp_replace(F.get(found, F.lit(0)), "[.,]+", "")
    for x in allow_chars or []:
        digits = F.replace(digits, F.lit(x), F.lit(""))
    return (
        F.when((F.size(found) == 0) & bare, "empty")
        .when((F.size(found) == 1) & bare & digits.rlike(r"^[+-]?[0-9]+$"), "value")
        .otherwise("attribute")
    )


def _escaped(x: str) -> str:
    return x if x.isalnum() else "\\" + x


def decimal_text(c: Column) -> Column:
    """A number without exponent and without trailing zeros, of ten decimals at most; as Spark writes it where it has more
    than 28 digits before the point or is too small for ten after it."""
    plain = F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), r"\.0+$|(\.\d*[1-9])0+$", "$1")
    return F.when((plain != "0") | (c == 0), plain).otherwise(c.cast("string"))


def clean_string(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), " +", " "))


def fingerprint(c: Column) -> Column:
    """The cleaned string with its words sorted, repeats left out, so that their order doesn't count."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(clean_string(c), " "))), " ")


def shingles(c: Column, q: int = 3) -> Column:
    """Distinct substrings of q characters; the whole string if it is shorter."""
    n = F.length(c) - (q - 1)
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(q))))).otherwise(F.array(c))


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of a column number: 1 is A, 27 is AA."""
    digits = F.lit("")
    rest = n
    for _ in range(7):  # 26^7 columns
        digits = F.when(rest > 0, F.concat(F.char(F.pmod(rest - 1, F.lit(26)) + 65), digits)).otherwise(digits)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    return digits


def human_size(n: Column) -> Column:
    out = F.concat(decimal_text(F.round(n, 2)), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(decimal_text(F.round(n / 1024**k, 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def serial_date(n: Column) -> Column:
    """A spreadsheet's day number as a date."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(n) - 25569).cast("int"))


def serial_timestamp(n: Column) -> Column:
    return F.timestamp_seconds((n - 25569) * 86400)


def name_suffixes(names: list[str]) -> list[str]:
    """Names made unique by a number after repeats; blanks become `sheet`."""
    out: list[str] = []
    for name in (n if n and n.strip() else "sheet" for n in names):
        k, tried = 1, name
        while tried in out:
            k += 1
            tried = f"{name}_{k}"
        out.append(tried)
    return out


def osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        two, one = one, row
    return one[-1]


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Distance from 0 (equal) to 1."""
    if not a or not b:
        return float(a != b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, first, second = [True] * len(b), [], [None] * len(b)
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == x), None)
        if j is not None:
            free[j] = False
            first.append(x)
            second[j] = x
    m = len(first)
    if not m:
        return 1.0
    swaps = sum(x != y for x, y in zip(first, (y for y in second if y is not None), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return 1 - (jaro + start * scale * (1 - jaro))


def _vectorised(kind: str, f):
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return run


def osa_distance(a: Column, b: Column) -> Column:
    return _vectorised("int", osa)(a, b)


def jaro_winkler_distance(a: Column, b: Column) -> Column:
    return _vectorised("double", jaro_winkler)(a, b)


def common_substring(a: str, b: str) -> str:
    """The longest common substring, the first in `a` of equals."""
    best, at, last = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else 0)
            if row[j] > best:
                best, at = row[j], i
        last = row
    return a[at - best : at]
