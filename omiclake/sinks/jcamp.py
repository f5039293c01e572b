"""JCAMP-DX documents: packed ordinates and labelled records."""

from __future__ import annotations

import math

from omiclake.sources.text_formats import DIFFERENCE, SQUEEZED

_SQUEEZED = {v: k for k, v in SQUEEZED.items()}
_DIFFERENCE = {v: k for k, v in DIFFERENCE.items()}


def y_factor(values: list[float], digits: int = 7) -> float:
    """The least power of ten by which the largest value is a number of at most so many digits, or their power of ten itself; 1 of none."""
    most = max((abs(v) for v in values), default=0.0)
    return 1.0 if most == 0 else 10.0 ** (math.ceil(math.log10(most)) - digits)


def rounded(v: float) -> int:
    """To the nearest whole number, halves away from zero."""
    return math.floor(v + 0.5) if v >= 0 else math.ceil(v - 0.5)


def _packed(n: int, table: dict[int, str]) -> str:
    text = str(abs(n))
    first = int(text[0])
    return table[-first if n < 0 else first] + text[1:]


def encoded(values: list[float], first_x: float, delta_x: float, factor: float, mode: str = "DIF", width: int = 10) -> list[str]:
    """(X++(Y..Y)) lines of PAC, SQZ or DIF form; a DIF line begins with the value that the last one ended in, as a check."""
    y = [rounded(v / factor) for v in values]
    out, at = [], 0
    while at < len(y):
        part = y[at : at + width]
        head = f"{first_x + at * delta_x:.10g}"
        if mode == "PAC":
            out.append(head + "".join(f"{v:+d}" for v in part))
        elif mode == "SQZ":
            out.append(head + "".join(_packed(v, _SQUEEZED) for v in part))
        elif mode == "DIF":
            back = [y[at - 1]] if at else []
            line = back + part
            head = f"{first_x + (at - len(back)) * delta_x:.10g}"
            out.append(head + _packed(line[0], _SQUEEZED) + "".join(_packed(b - a, _DIFFERENCE) for a, b in zip(line, line[1:], strict=False)))
        else:
            raise ValueError(mode)
        at += width
    return out


def document(title: str, data_type: str, x: list[float], y: list[float], mode: str = "DIF", x_units: str = "1/CM", y_units: str = "ABSORBANCE") -> str:
    """A document of evenly spaced values."""
    n, factor = len(y), y_factor(y)
    delta = (x[-1] - x[0]) / (n - 1) if n > 1 else 0.0
    head = [
        f"##TITLE={title}", "##JCAMP-DX=5.01", f"##DATA TYPE={data_type}", f"##XUNITS={x_units}", f"##YUNITS={y_units}", f"##FIRSTX={x[0] if x else 0.0:.10g}", f"##LASTX={x[-1] if x else 0.0:.10g}",
        f"##DELTAX={delta:.17g}", f"##YFACTOR={factor:.17g}", "##XFACTOR=1", f"##NPOINTS={n}", "##XYDATA=(X++(Y..Y))",
    ]
    return "\n".join([*head, *encoded(y, x[0] if x else 0.0, delta, factor, mode), "##END=", ""])
