"""Scalar measures, as SQL expressions in either dialect."""

from __future__ import annotations

from .dialect import Dialect


def js_round(x: str) -> str:
    """Half up, also below zero."""
    return f"cast(floor(({x}) + 0.5) as bigint)"


def words(d: Dialect, text: str) -> str:
    return d.hits(text, r"\S+")


def token_estimate(d: Dialect, text: str) -> str:
    """0 for blank text; a quarter of the characters, averaged with 1.33 a word unless there are no real words."""
    t = d.trim(text)
    c, w = js_round(f"length({t}) / 4.0"), words(d, t)
    return f"case when {text} is null or length({t}) = 0 then 0 when {w} = 0 or length({t}) > 20 * {w} then greatest(1, {c}) else greatest(1, {js_round(f'({js_round(f"1.33 * {w}")} + {c}) / 2.0')}) end"


def energy(tokens: str) -> str:
    """Wh of so many tokens, to four places."""
    return f"round(greatest(0, {tokens}) * 0.001, 4)"


def carbon(tokens: str) -> str:
    """Grams of CO2 of so many tokens, to four places."""
    return f"round(greatest(0, {tokens}) * 0.00036, 4)"


def headroom_level(remaining: str, usable: str) -> str:
    return f"case when {remaining} <= 0 then 'full' when {remaining} <= 0.08 * {usable} then 'critical' when {remaining} <= 0.2 * {usable} then 'warn' else 'ok' end"


def rating(mean: str) -> str:
    return f"case when {mean} >= 90 then 'Efficient' when {mean} >= 70 then 'Good' else 'Needs work' end"


def grams(g: str) -> str:
    return f"case when {g} <= 0 then '0 g' when {g} < 0.001 then '<1 mg' when {g} < 1 then concat(cast({js_round(f'{g} * 1000')} as varchar(20)), ' mg') else concat(cast(cast({g} as decimal(18,1)) as varchar(20)), ' g') end"
