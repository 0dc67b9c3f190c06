"""Findings about a prompt: detectors, classification by severity, and merging of those about the same thing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from .protect import mask
from .scoring import OPPOSED

_I = re.A | re.I

# Categories and severities, the severity of each type, and the detectors' patterns and confidences.
CATEGORIES = ("spelling", "grammar", "punctuation", "repetition", "ambiguity", "missing-context", "contradiction", "scope", "output-format", "structure")
SEVERITIES = ("error", "suggestion", "improvement")
SEVERITY_OF = {
    **dict.fromkeys(("spelling", "agreement", "verb-form", "noun-form", "pronoun-case", "article", "contraction"), "error"),
    **dict.fromkeys(("word-choice", "confusable", "phrasing"), "suggestion"),
    **dict.fromkeys(("capitalization", "punctuation", "redundancy", "structure", "complexity"), "improvement"),
}
DOUBLED = re.compile(r"\b(\w+)(\s+\1\b)+", _I)
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twenty": 20, "fifty": 50, "hundred": 100}
_TEN = "one|two|three|four|five|six|seven|eight|nine|ten"
CAP = re.compile(rf"\b(?:exactly|no more than|at most|only|just|in)\s+(\d+|{_TEN})\s+(words?|sentences?|lines?|characters?)\b", _I)
DEMAND = re.compile(rf"\b(\d+|{_TEN}|several|multiple)\s+(?:\w+\s+){{0,2}}?(examples?|points?|reasons?|steps?|items?|paragraphs?|sections?)\b", _I)
UNBOUNDED = [
    ("everything", re.compile(r"\b(?:explain|cover|include|tell me)\s+everything\b", _I)),
    ("every case", re.compile(r"\bevery(?:thing|\s+(?:detail|aspect|possible|single))\b", _I)),
    ("a whole field", re.compile(r"\b(?:all|complete|full|entire)\s+(?:the\s+)?(?:details|topics|algorithms|concepts|methods|cases|history)\b", _I)),
    ("a production system from nothing", re.compile(r"\bfrom\s+scratch\b.*\bproduction[\s-]ready\b", _I)),
    ("a whole subject", re.compile(r"\bteach\s+me\s+(?:everything|all)\b", _I)),
]
ORDINALS = re.compile(r"\b(?:second(?:ly)?|third(?:ly)?|fourth(?:ly)?|lastly)\b(?=\s*[,:]?\s*[a-z])", _I)
VAGUE_QUALITY = re.compile(r"\b(good|better|best|nice|proper|decent|clean|modern|professional|beautiful|optimal|efficient)\b", _I)
OPENER = re.compile(r"^\s*(?:make|fix|improve|change|update|rewrite|do)\s+(it|this|that|them|these|those)\b", _I)
SHOWN = re.compile(r"```|`[^`]+`|\"[^\"]{3,}\"|\n\s*\n")
BUILD = re.compile(r"\b(?:create|build|make|write|design|develop|implement)\s+(?:a|an|the|me\s+a)?\s*(?:\w+\s+){0,4}?(website|web\s?app|app|application|api|service|dashboard|game|bot|script|tool|system|platform)\b", _I)
PURPOSE = re.compile(r"\b(?:for|that|which|to)\s+\w+", _I)
AUDIENCE = re.compile(r"\b(?:for|aimed at|targeting)\s+(?:a|an|my|our|beginners?|students?|clients?|users?|kids?|children)", _I)
MOST_SEMANTIC = 0.9


@dataclass(frozen=True)
class Finding:
    category: str
    severity: str
    explanation: str
    confidence: float = 0.6
    text: str | None = None
    start: int | None = None
    suggestion: str | None = None
    needs_clarification: bool = False
    question: str | None = None
    source: str = "rule"

    @property
    def end(self) -> int | None:
        return None if self.start is None or self.text is None else self.start + len(self.text)


def classify(findings: Iterable[tuple[str, str]]) -> list[tuple[str, str, str, int]]:
    """(type, label, severity, count) of (type, label) pairs: one for each label whatever its case, with the gravest
    severity and its type; by severity, then by first appearance."""
    kept: dict[str, list] = {}
    for kind, label in findings:
        if label:
            grave = SEVERITIES.index(SEVERITY_OF.get(kind, "suggestion"))
            row = kept.setdefault(label.lower(), [grave, kind, label, 0])
            row[3] += 1
            if grave < row[0]:
                row[:2] = grave, kind
    return [(kind, label, SEVERITIES[grave], n) for grave, kind, label, n in sorted(kept.values(), key=lambda r: r[0])]


def repetition(prompt: str, masked: str) -> list[Finding]:
    out = [Finding("repetition", "error", f'"{m[1]}" is said {len(m[0].split())} times in a row', 0.97, m[0], m.start(), m[1]) for m in DOUBLED.finditer(masked)]
    often = Counter(re.findall("[a-z]{5,}", masked.lower()))
    return out + [Finding("repetition", "improvement", f'"{w}" appears {n} times', 0.5, w) for w, n in often.items() if n >= 3]


def _number(text: str) -> int:
    return NUMBERS.get(text.lower()) or (int(text) if text.isdigit() else 3)


def contradiction(prompt: str, masked: str) -> list[Finding]:
    out = [Finding("contradiction", "error", "these two requirements pull against each other", 0.85, m[0], m.start(), None, True, "Which matters more, brevity or detail?") for p in OPPOSED if (m := p.search(masked))]
    cap, demand = CAP.search(masked), DEMAND.search(masked)
    if cap and demand:
        size, unit, many = _number(cap[1]), cap[2].lower(), _number(demand[1])
        if size < many * (2 if unit.startswith("word") else 1):
            out.append(Finding("contradiction", "error", f"caps the answer at {size} {unit} and asks for {many} {demand[2].lower()}", 0.9, f"{cap[0]} ... {demand[0]}", None, None, True, "Which of the two should hold?"))
    return out


def unbounded_scope(prompt: str, masked: str) -> list[Finding]:
    out = [Finding("scope", "suggestion", f"asks for {what}", 0.8, m[0], m.start(), None, True, "Which parts matter most?") for what, p in UNBOUNDED if (m := p.search(masked))]
    joined = len(re.findall(r"\band\b", masked, _I)) + len(ORDINALS.findall(masked))
    if joined >= 3 and len(re.split(r"\s+", masked)) < 60:
        out.append(Finding("scope", "improvement", f"asks for {joined + 1} things at once", 0.55))
    return out


def ambiguity(prompt: str, masked: str) -> list[Finding]:
    vague = {}
    for m in VAGUE_QUALITY.finditer(masked):
        vague.setdefault(m[1].lower(), m)
    out = []
    if vague:
        first = next(iter(vague.values()))
        out.append(Finding("ambiguity", "improvement", "vague: " + ", ".join(vague), 0.7, first[1], first.start(), None, True, f"What would make it {first[1]}?"))
    opener = OPENER.match(masked)
    if opener and not re.search(r":\s*\S", masked[opener.end() :]) and not SHOWN.search(prompt):
        out.append(Finding("ambiguity", "suggestion", f'nothing yet for "{opener[1]}" to point at', 0.85, opener[1], opener.start(), None, True, "What should be changed?"))
    return out


def missing_context(prompt: str, masked: str) -> list[Finding]:
    m = BUILD.search(masked)
    if not m or PURPOSE.search(masked[m.end() :]) or AUDIENCE.search(masked):
        return []
    return [Finding("missing-context", "suggestion", f"no purpose given for the {m[1].lower()}", 0.6, m[0], m.start(), None, True, f"What should the {m[1].lower()} do, and for whom?")]


DETECTORS = (repetition, contradiction, unbounded_scope, ambiguity, missing_context)


def same_ground(a: Finding, b: Finding) -> bool:
    """Whether two findings of a category are about the same: overlapping spans; where a place is unknown, one text within
    the other; without any spans the same explanation; one with a span covers one without."""
    if a.text is None or b.text is None:
        return a.explanation == b.explanation if a.text is b.text else True
    if a.start is None or b.start is None:
        x, y = a.text.lower(), b.text.lower()
        return x in y or y in x
    return a.start < b.end and b.start < a.end


def merge(findings: Iterable[Finding]) -> list[Finding]:
    """Findings of a category on the same ground as one: gravest severity, highest confidence, the wording of the surer.
    The gravest first, then the surest. Each meets those kept so far in order, so the result depends on the order."""
    kept: list[Finding] = []
    for new in findings:
        if not new.explanation:
            continue
        at = next((k for k, old in enumerate(kept) if old.category == new.category and same_ground(old, new)), None)
        if at is None:
            kept.append(new)
            continue
        old = kept[at]
        surer = new.confidence > old.confidence
        place = new if (surer or old.text is None) and new.text is not None else old
        kept[at] = replace(
            old,
            severity=min(old.severity, new.severity, key=SEVERITIES.index),
            explanation=new.explanation if surer else old.explanation,
            question=(new.question if surer and new.question else old.question) or new.question,
            text=place.text,
            start=place.start,
            suggestion=old.suggestion or new.suggestion,
            confidence=max(old.confidence, new.confidence),
            needs_clarification=old.needs_clarification or new.needs_clarification,
            source=old.source if old.source == new.source else "rule+semantic",
        )
    return sorted(kept, key=lambda f: (SEVERITIES.index(f.severity), -f.confidence))


def analyze(prompt: str | None, semantic: Callable[[str], Iterable[dict]] | None = None) -> list[Finding]:
    """All detectors' findings, merged; and a caller's own analyser's, whose confidence is capped. If that fails, or gives
    what cannot be read, the detectors' findings stand alone."""
    if not (prompt or "").strip():
        return []
    masked = mask(prompt).masked
    found = [f for detect in DETECTORS for f in detect(prompt, masked)]
    if semantic:
        try:
            for x in semantic(prompt):
                text, start = x.get("text"), x.get("start")
                start = start if isinstance(start, int) else prompt.find(text) if text and text in prompt else None
                category, severity = x.get("category"), x.get("severity")
                found.append(Finding(category if category in CATEGORIES else "ambiguity", severity if severity in SEVERITIES else "suggestion", x.get("explanation") or "flagged by contextual analysis", min(MOST_SEMANTIC, x.get("confidence", 0.6)), text, start, x.get("suggestion"), bool(x.get("needsClarification")), x.get("question"), "semantic"))
        except Exception:  # noqa: BLE001 - a caller's code; its failure must not cost the findings
            found = [f for f in found if f.source == "rule"]
    return merge(found)


def clarifications(findings: Iterable[Finding]) -> list[str]:
    """The distinct questions of findings that need an answer, in order."""
    return list(dict.fromkeys(f.question for f in findings if f.needs_clarification and f.question))
