"""All queries of this subpackage, by name."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, langid, lbl, pii, quality, simhash, toxicity

_MODULES = (toxicity, simhash, langid, decontaminate, lbl, chat, ann, pii, quality, bpe)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
