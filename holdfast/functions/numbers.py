"""SQL expressions for numbers, as text: one call to the JVM per column, not one per operator."""

from __future__ import annotations

from collections.abc import Container, Mapping

# The texts that read as an infinite number.
INFINITE_TEXTS = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def half_even(value: str, places: int) -> str:
    """Round to ``places`` decimals, exact halves to the even digit, never to a negative zero."""
    scale = f"{10**places}D"
    return f"(rint(({value}) * {scale}) / {scale} + 0D)"


def to_number(text: str) -> str:
    """Text to double; anything that is not a plain decimal number becomes null.

    The JVM parser also takes ``1d``, ``1f``, hexadecimal text and NaN, which are no numbers
    here: all of these hold one of the letters a, d, f, x, and a plain number holds none.
    """
    infinite = ", ".join(f"'{t}'" for t in INFINITE_TEXTS)
    return (
        f"CASE WHEN translate({text}, 'aAdDfFxX', '') = {text} THEN try_cast({text} AS DOUBLE) "
        f"WHEN lower(trim({text})) IN ({infinite}) THEN try_cast({text} AS DOUBLE) END"
    )


def without_nan(value: str) -> str:
    """The value as double, NaN as null."""
    return f"nullif(CAST({value} AS DOUBLE), double('NaN'))"


def clamp(value: str, low: float, high: float) -> str:
    """Limit to ``[low, high]``; null stays null."""
    low, high = float(low), float(high)
    return f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, {low}D), {high}D) END"


def weighted_sum(columns: Container[str], weights: Mapping[str, float]) -> str:
    """Sum of column × weight in the given order; a column not in ``columns`` counts as 0."""
    return " + ".join(f"{c if c in columns else 0} * {w}D" for c, w in weights.items())


def ratio(numerator: str, denominator: str) -> str:
    """Division that gives null instead of failing on a zero denominator."""
    return f"({numerator}) / nullif({denominator}, 0D)"


def labelled(value: str, labels: Mapping[int, str]) -> str:
    """The label of a code; null for codes without one."""
    cases = " ".join(f"WHEN {value} = {code} THEN '{text}'" for code, text in labels.items())
    return f"CASE {cases} END"


def quoted(column: str) -> str:
    """A column name as it may stand in SQL text."""
    return "`" + column.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A text constant as it may stand in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
