"""Expressions for values that a cast can't read, found from the values themselves.

Values become patterns: digit runs are one token, letter runs and separators stay.  A pattern whose
one number stands beside a unit is read by an extraction that fits its marks; several patterns are
put together as cases if they agree on the unit.  What isn't sure to keep each value's meaning (two
numbers, other units) gets no expression."""

from __future__ import annotations

import re

from ..functions import templates as tpl

_NUMBER = re.compile(r"[+-]?\d+(?:[.,]\d+)*")
_UNIT = re.compile(r"[^\W\d_]+")


def pattern(value: str) -> str:
    """The value in lower case, trimmed, with single blanks, 9 for each run of digits, and # for three
    digits after a comma, which may be a group."""
    text = re.sub(r"\s+", " ", value.strip().lower())
    return re.sub(r"[0-9]+", "9", re.sub(r",[0-9]{3}(?![0-9])", ",#", text))


def _shape(value: str) -> tuple[str, str, str, float] | None:
    """What stands before and after the one number, how the number is written, and the number."""
    text = re.sub(r"\s+", " ", value.strip().lower())
    numbers = list(_NUMBER.finditer(text))
    if len(numbers) != 1:
        return None
    n = numbers[0]
    digits = n[0]
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", digits):
        kind, number = "point", float(digits)
    elif re.fullmatch(r"[+-]?\d{1,3}(,\d{3})+(\.\d+)?", digits):
        # 1,500 is a thousand and a half to some and one and a half to others.
        if digits.count(",") == 1 and "." not in digits:
            return None
        kind, number = "grouped", float(digits.replace(",", ""))
    elif re.fullmatch(r"[+-]?\d+,\d+", digits):
        kind, number = "comma", float(digits.replace(",", "."))
    else:
        return None
    return text[: n.start()], text[n.end() :], kind, number


def _same_unit(units: set[str]) -> bool:
    """Whether all are short and long forms of one word: h, hr, hrs, hours."""
    plain = sorted({u.rstrip("s") or u for u in units}, key=len)
    whole = plain[-1] if plain else ""

    def shortens(u: str) -> bool:
        # The first letter, and the others in their order.
        rest = iter(whole)
        return whole[:1] == u[:1] and all(c in rest for c in u)

    return all(map(shortens, plain))


_READ = {
    "point": r"try_cast(regexp_extract({e}, r'[+-]?[0-9]+([.][0-9]+)?', 0) as double)",
    "comma": r"try_cast(replace(regexp_extract({e}, r'[+-]?[0-9]+,[0-9]+', 0), ',', '.') as double)",
    "grouped": r"try_cast(replace(regexp_extract({e}, r'[+-]?[0-9]+(,[0-9]+)+([.][0-9]+)?', 0), ',', '') as double)",
}
_WRITTEN = {"point": r"[+-]?[0-9]+([.][0-9]+)?", "comma": r"[+-]?[0-9]+,[0-9]+", "grouped": r"[+-]?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?"}


def _literal(text: str) -> str:
    """The text as a regular expression; blanks may be wider."""
    return "".join(r"\s+" if c == " " else re.sub(r"([^\w])", r"\\\1", c) for c in text)


def propose(column: str, base: str, values: list[str]) -> str | None:
    """``base``, and where it reads nothing an extraction for each pattern of ``values``; None if one of
    them can't be read for sure."""
    if not values:
        return None
    shapes = [_shape(v) for v in values]
    if None in shapes:
        return None
    if not _same_unit({u for before, after, _, _ in shapes for u in _UNIT.findall(before + " " + after)}):
        return None
    e = tpl.as_text(column)
    cases = []
    for before, after, kind in sorted({s[:3] for s in shapes}):
        where = rf"(?i)^\s*{_literal(before)}{_WRITTEN[kind]}{_literal(after)}\s*$"
        cases.append(f"when rlike({e}, {_quoted(where)}) then {_READ[kind].replace('{e}', e)}")
    return f"coalesce({base}, case {' '.join(cases)} end)"


def _quoted(regex: str) -> str:
    """As an SQL literal, with backslashes and quotes doubled."""
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read(value: str) -> float | None:
    """The number that a proposed expression has to give for a value."""
    shape = _shape(value)
    return shape and shape[3]
