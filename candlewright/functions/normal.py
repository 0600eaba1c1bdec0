"""The normal distribution as SQL text, with relative accuracy in the tail."""

from __future__ import annotations

#: Coefficients, from the highest power down, of the Chebyshev fit of erfc in t = 1 / (1 + z / 2) in Numerical
#: Recipes; its fractional error is under 1.2e-7 for every z >= 0, so the tail keeps its digits.
FIT = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
ROOT2 = "1.4142135623730951E0"


def log_erfc(z: str) -> str:
    """Natural logarithm of erfc(z), z >= 0: finite where erfc itself is too small for a double."""
    t = f"(1.0E0 / (1.0E0 + 0.5E0 * ({z})))"
    inner = f"{FIT[0]!r}E0"
    for c in FIT[1:]:
        inner = f"({inner} * {t} + ({c!r}E0))"
    return f"(ln({t}) - ({z}) * ({z}) + {inner})"


def erfc(z: str) -> str:
    """erfc(z), z >= 0."""
    return f"exp({log_erfc(z)})"


def cdf(x: str) -> str:
    """Normal distribution function."""
    tail = f"(0.5E0 * {erfc(f'abs({x}) / {ROOT2}')})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def two_sided(t: str) -> str:
    """Chance of a normal value beyond |t| on either side."""
    return erfc(f"abs({t}) / {ROOT2}")


def log10_two_sided(t: str) -> str:
    return f"({log_erfc(f'abs({t}) / {ROOT2}')} / 2.302585092994046E0)"
