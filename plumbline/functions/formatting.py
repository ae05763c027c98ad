"""Short texts for results, made on the driver."""

from __future__ import annotations

import re
from datetime import datetime


def truncate(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def split_camel_case(text: str) -> str:
    """TextLength -> Text Length."""
    return " ".join(re.findall(r"[A-Z]?[^A-Z]+|[A-Z]+(?![a-z])", text)) or text


def to_snake_case(text: str) -> str:
    """TextLength and Text Length -> text_length."""
    return re.sub(r"[\s_]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text.strip())).lower()


def format_number(x: float, places: int = 2) -> str:
    """Thousands with commas; numbers too small for the places in scientific notation."""
    if x and abs(x) < 10**-places:
        return f"{x:.{places}e}"
    text = f"{x:,.{places}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def format_percent(ratio: float, places: int = 2, sign: bool = False) -> str:
    """A ratio as percent; what rounds to 100 % or 0 % without being it stays apart from it."""
    plus = "+" if sign and ratio > 0 else ""
    if 0 < abs(ratio) < 10 ** -(places + 2):
        return f"{plus}{ratio * 100:.{places}e}%"
    if abs(ratio) < 1 and round(abs(ratio) * 100, places) >= 100:
        return f"{plus}{'-' if ratio < 0 else ''}{100 - 10**-places:.{places}f}%"
    return plus + f"{ratio * 100:.{places}f}".rstrip("0").rstrip(".") + "%"


def format_list(items: list, most: int = 10, width: int = 40) -> str:
    shown = ", ".join(truncate(str(i), width) for i in items[:most])
    return shown + (f", and {len(items) - most} more" if len(items) > most else "")


def format_datetime(t: datetime) -> str:
    """As precise as the time is: date, minutes or seconds."""
    if (t.hour, t.minute, t.second) == (0, 0, 0):
        return t.strftime("%Y/%m/%d")
    return t.strftime("%Y/%m/%d %H:%M" if not t.second else "%Y/%m/%d %H:%M:%S")
