"""Compression of a prompt: parts, repeats, modifiers, candidates by tier, their validation and the choice among them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from . import words as W
from .language import is_code, looks_english, looks_english_vocabulary
from .protect import mask, unmask
from .words import Dictionary

_I = re.A | re.I

# Tiers and strictness, parts of a prompt, words the validator passes over.
MODES = ("conservative", "balanced", "aggressive")
STRICTNESS = {"fixes": "conservative", "trim": "balanced", "condense": "aggressive"}
FORMATS = re.compile(r"\b(json|xml|yaml|csv|markdown|html|table|bullet(?:s|ed)?|list|essay|email|poem|script|summary|outline|diagram|pseudocode|step[\s-]by[\s-]step)\b", _I)
CONSTRAINTS = [
    re.compile(p, _I)
    for p in (
        r"\b(?:exactly|at least|at most|no more than|under|over|within|up to)\s+\d+\s+\w+",
        r"\b\d+\s*(?:words?|characters?|lines?|pages?|paragraphs?|sentences?|bullets?|slides?|items?|steps?|examples?)\b",
        r"\bmust\s+(?:not\s+)?\w+",
        r"\bonly\s+(?:use\s+)?\w+",
        r"\bno\s+(?:external|third[\s-]party|new|extra)?\s*(?!(?:idea|clue|worries|problem|matter|time|way|doubt|one|longer)\b)\w+",
        r"\b(?:do not|don't|never|avoid)\s+(?!(?:really\s+)?(?:understand|know|get|think|mind|care|remember|have\s+(?:any|much))\b)\w+",
        r"\b(?:to not|not to|without)\s+\w+",
        r"\b(?:would|'d)\s+(?:really\s+)?(?:like|love|prefer)\s+(?:it\s+)?(?:to|if|that)\b[^.!?\n]*",
        r"\bappreciate\s+it\s+if\b[^.!?\n]*",
        r"\bin\s+(?:python|javascript|typescript|java|c\+\+|c#|go|rust|ruby|php|sql)(?!\w)\s*\d*\.?\d*",
        r"\b(?:in (?:great |full |more )?detail|in depth|in-depth|briefly|step[- ]by[- ]step|with (?:an? |some )?examples?|in O\([^)]+\)|O\([^)]+\) (?:time|space))\b",
        r"\b(?:act as|acting as|pretend (?:you are|to be)|(?:play|take on|assume) the role of|you are (?:an?|the))\s+[^.!?\n,]+",
        r"\b(?:be|keep it|make it)\s+(?:very\s+)?(?:concise|brief|short|succinct|specific|detailed|thorough|formal|informal|casual|funny|polite|professional|friendly|simple|clear)\b",
    )
]
ASKS = re.compile(r"\b(?:explain|write|create|build|make|give|list|show|tell|describe|compare|summari[sz]e|translate|fix|debug|generate|design|draft|suggest|recommend|calculate|solve|analy[sz]e|review|rewrite|convert|implement|help|teach|outline|what|why|how|when|which|who)\b", _I)
TASK = re.compile(r"\b(explain|write|create|build|make|give|list|show|tell|describe|compare|summari[sz]e|translate|fix|debug|generate|design|draft|suggest|recommend|calculate|solve|analy[sz]e|review|rewrite|convert|implement|teach|outline|plan|check|find|parse|format|schedule|refactor|proofread)\b", _I)
VERB = re.compile(r"\b(explain|write|create|build|list|describe|compare|summari[sz]e|translate|fix|debug|generate|design|draft|suggest|recommend|calculate|solve|analy[sz]e|review|rewrite|convert|implement|outline|plan|check|find|refactor|proofread|add|remove|include|mention|highlight|plot|test|provide|discuss|elaborate|propose|predict|estimate|evaluate|identify|define|derive|prove|imagine|reason)\b", _I)
NOUN_BEFORE = re.compile(r"\b(?:the|a|an|my|your|our|their|this|that|no|any)\s\Z", _I)
SAME_TASK = {"give": {"list", "show", "suggest"}, "tell": {"explain", "list"}, "show": {"list"}}
LOOSE_TASKS = {"give", "make", "show", "tell"}
NOT_NAMES = set("ok okay lol omg pls plz asap btw tbh imo thx ty hi hey chatgpt gpt ai hello please kindly can could would will shall should may explain write give tell list show make create describe summarize summarise compare suggest recommend help draft plan outline review analyze analyse translate fix solve calculate add mention include keep provide highlight also then and but so thanks thank i what how why when where which who is are do does the my".split())
FUNCTION_WORDS = set("the a an and or but if then than that this these those there here it its is are was were be been being am do does did done doing have has had having will would can could shall should may might must not no yes of to in on at by for with from as into over under about after before between out up down off again further once you your yours we our ours i me my mine they them their he she his her so such own same too very just now also please".split())
REWRITTEN = set("quickly many i'm im summarize summarise teach define plan one them simply briefly because list about now can beginner should how explain concisely shortly although promptly consider decide near soon most before after daily every first clearly needs need often usually despite they're it's you're who's than whether which their there losing advise known saw bought fewer are write between and for to gone done seen taken written given he she buy".split())
COMPARATORS = set("more less least most than under over up exactly precisely within around about".split())
MANNER = set("clearly simply briefly properly well again really understand know learn need want".split())
REQUEST = re.compile(r"^(?:explain|describe|write|give|list|tell|show|help|summari[sz]e|teach)\b|^(?:and\s+)?i\s+(?:really\s+|just\s+)?(?:need|want)\s+to\s+(?:understand|know|learn)\b", _I)
_FACE = r"(?![-'^o]?[)(\]\[DPpO3|*]+(?=[ \t]|$))"
_NOUNS = "message|text|input|sentence|passage|email|tweet|review|paragraph|content|data|word|quote|letters?|options?|statement|story|essay|poem|lyrics|transcript"
PAYLOAD = re.compile(
    rf"\bfollowing\b[^:\n]{{0,300}}:{_FACE}|\b(?:below|here)\s*:{_FACE}|\b(?:text|paragraph|article|passage|email|message|essay|story|code|sentences?|list|document|poem)\s+below\b[^\n]*\n"
    rf"|\b(?:translate|proofread|fix|correct|check|rewrite|rephrase|paraphrase|summari[sz]e|improve|edit|polish|shorten|simplify|explain|analy[sz]e|review|grade|rate|make\s+it\s+(?:better|shorter|formal|professional))\b[^:\n]{{0,60}}:(?!//){_FACE}"
    rf"|\bfollowing\b[^:\n]{{0,80}}[.:]?[ \t]*(?=\n)|(?=\n[ \t]*(?:{_NOUNS})[ \t]*:)|^[ \t]*(?:{_NOUNS})[ \t]*:{_FACE}[ \t]*",
    _I,
)
SIGN_OFF = re.compile(r"\n\s*(?:(?:kind|best|warm)\s+regards|regards|thanks(?:\s+in\s+advance)?|thank\s+you|cheers|sincerely|yours\s+(?:truly|sincerely))\b[\s\S]*\Z", _I)

# Wordy constructions and what they stand for.
CONCISE = [
    (re.compile(rf"\b{p}\b", _I), by)
    for p, by in (
        (r"in\s+order\s+to", "to"),
        (r"(?:that|which)\s+can\s+be\s+used\s+to", "to"),
        (r"due\s+to\s+the\s+fact\s+that", "because"),
        (r"as\s+a\s+matter\s+of\s+fact", "actually"),
        (r"for\s+all\s+intents\s+and\s+purposes", "basically"),
        (r"at\s+this\s+point\s+in\s+time", "now"),
        (r"in\s+the\s+event\s+that", "if"),
        (r"for\s+the\s+purpose\s+of", "for"),
        (r"(?:has|have)\s+the\s+(?:capability|ability)\s+to", "can"),
        (r"make\s+a\s+decision", "decide"),
        (r"perform\s+an\s+analysis\s+on", "analyze"),
        (r"take\s+into\s+consideration", "consider"),
        (r"with\s+(?:regard|respect)\s+to", "regarding"),
        (r"give\s+me\s+a\s+(?:brief\s+|short\s+|quick\s+)?overview\s+of", "summarize"),
        (r"make\s+a\s+comparison\s+(?:between|of)", "compare"),
        (r"(?:carry\s+out|conduct)\s+an\s+analysis\s+of", "analyze"),
        (r"(?:provide|give)\s+a\s+description\s+of", "describe"),
        (r"(?:is|are)\s+able\s+to", "can"),
        (r"on\s+a\s+daily\s+basis", "daily"),
        (r"on\s+a\s+weekly\s+basis", "weekly"),
        (r"on\s+a\s+monthly\s+basis", "monthly"),
        (r"on\s+a\s+regular\s+basis", "regularly"),
        (r"in\s+the\s+near\s+future", "soon"),
        (r"at\s+(?:the\s+present|this)\s+time", "now"),
        (r"a\s+number\s+of", "several"),
        (r"the\s+majority\s+of", "most"),
        (r"(?:in\s+spite\s+of|despite|regardless\s+of)\s+the\s+fact\s+that", "although"),
        (r"(?:it\s+is\s+possible|there\s+is\s+a\s+possibility)\s+that", "possibly"),
        (r"in\s+a\s+timely\s+manner", "promptly"),
        (r"with\s+the\s+exception\s+of", "except"),
        (r"in\s+close\s+proximity\s+to", "near"),
    )
]
TIGHTEN = [
    (re.compile(p, _I), by)
    for p, by in (
        (r"\bmake\s+sure\s+(?:to|(?:that\s+)?you)\s+", ""),
        (r"\bthe\s+(?:concept|idea|notion|topic)\s+of\s+", ""),
        (r"\bgive\s+me\s+(?:a\s+list\s+of|some)\s+", "list "),
        (r"\bwhat\s+should\s+i\s+do\s+to\s+(\w+)", r"how do I \1"),
        (r"\bgive\s+me\s+the\s+(steps|points|options)\b", r"list the \1"),
        (r"\bi\s+have\s+(?:this|a)\s+problem\s+where\s+", ""),
        (r"\bexplain\s+to\s+me\b", "explain"),
        (r"\bprior\s+to\b", "before"),
        (r"\bwhether\s+or\s+not\b", "whether"),
        (r"\bthe\s+reason\s+why\b", "why"),
        (r"\b(?:various\s+different|different\s+various)\b", "various"),
        (r"\bfirst\s+and\s+foremost\b", "first"),
        (r"\ba\s+majority\s+of\b", "most"),
        (r"\bi(?:'m|\s+am)\s+planning\s+to\b", "I plan to"),
        (r"\band\s+then\s+(?=[a-z])", "then "),
        (r"\bnot\s+only\s+([^.?!]+?),?\s+but\s+also\s+", r"\1 and "),
        (r"\s+for\s+me\b(?!\s+(?:and|to)\b)", ""),
        (r"\s+as\s+well(?=\s*[.?!]|\Z)", ""),
    )
]
PADDING = [
    re.compile(p, _I)
    for p in (
        r"^\s*(?:hello|hi|hey|greetings|good\s+(?:morning|afternoon|evening))(?:\s+(?:there|chatgpt|gpt|dear\s+assistant))?\b[,.!]*\s*",
        r"\b(?:could|can|would|will)\s+you\s+(?:please\s+|kindly\s+)?(?=[a-z])",
        r"\b(?:please|kindly)\s+",
        r"[,.]?\s*\b(?:thanks|thank\s+you)(?:\s+(?:a\s+(?:lot|ton|bunch)|so\s+much|very\s+much))?(?:\s+in\s+advance)?\b[!.]*(?=\s*\Z)",
        r"\bi\s+was\s+(?:just\s+)?wondering\s+if\s+",
    )
]

# Modifiers that say the same, the most specific first; opinions; requirements.
SYNONYMS = {
    "simplicity": ["beginner-friendly", "beginner friendly", "entry-level", "introductory", "basic", "simple", "easy", "straightforward", "uncomplicated", "plain", "elementary", "simplified", "easy-to-follow"],
    "brevity": ["brief", "concise", "succinct", "short", "compact", "terse"],
    "depth": ["comprehensive", "in-depth", "detailed", "thorough", "exhaustive", "complete", "extensive", "elaborate", "full"],
    "clarity": ["unambiguous", "clear", "understandable", "readable", "legible", "coherent", "lucid"],
    "novelty": ["new", "fresh", "innovative", "creative", "unique"],
    "importance": ["critical", "essential", "important", "vital", "crucial", "significant"],
    "speed": ["real-time", "instant", "fast", "rapid", "quick", "speedy", "swift"],
    "size": ["large", "big", "huge", "massive", "enormous", "sizeable"],
    "correctness": ["correct", "accurate", "precise", "exact"],
    "modernity": ["up-to-date", "modern", "contemporary", "recent"],
}
OPINIONS = set("beautiful nice amazing great lovely wonderful gorgeous stunning awesome excellent fantastic brilliant elegant sleek slick pretty professional polished decent".split())
REQUIREMENTS = set("secure scalable accessible responsive performant portable maintainable reliable testable documented typed async asynchronous synchronous offline online mobile desktop server-side client-side open-source cross-platform multilingual encrypted authenticated cached paginated stateless idempotent annotated commented interactive static dynamic free paid python javascript technical visual written verbal".split())
_PLACE = {w: (group, k) for group, ws in SYNONYMS.items() for k, w in enumerate(ws)}
_MODIFIERS = {*_PLACE, *OPINIONS, *REQUIREMENTS}
_LETTERS, _SIGNS = regex.compile(r"\p{L}+"), regex.compile(r"[^\p{L}\p{N}]+")
_EDGES, _WORD, _IE, _ENDING = re.compile(r"^[^a-z-]+|[^a-z-]+$", re.I), re.compile(r"[a-z][a-z'-]{2,}"), re.compile("ie$"), re.compile("(?:ing|ed|es|s)$")
_TEXTS, _WORDS = 64, 1 << 16  # how many results of the last texts, and of the last words, are kept: a prompt is held against each of its candidates


_mask = lru_cache(maxsize=_TEXTS)(mask)  # read only


def sentences(text: str) -> list[str]:
    return [x for x in map(str.strip, re.split(r"(?<=[.!?])[ \t]+|\n+", text)) if x]


def numbers(text: str) -> list[str]:
    return re.findall(r"\d+(?:[.,]\d+)*", text, re.A)


def verbatim(text: str) -> list[str]:
    """Code, addresses, quotes and complexities, which must stay letter by letter."""
    return [m for p in (r"```[\s\S]*?```", r"`[^`\n]+`", r"https?://\S+", r'"[^"\n]{4,}"', "(?<![\\w'’])'[^'\\n]{4,}'(?![\\w'’])", r"\bO\([^)\s]{1,12}\)") for m in re.findall(p, text, re.A)]


@lru_cache(maxsize=_WORDS)
def _stem(w: str) -> str:
    return _IE.sub("y", _ENDING.sub("", w))


@lru_cache(maxsize=_WORDS)
def _bare(w: str) -> str:
    return _EDGES.sub("", w).lower()


def content(text: str) -> frozenset[str]:
    """Words that carry meaning, without plural and verb endings."""
    return _content(text) if len(text) > 40 else _short_content(text)


@lru_cache(maxsize=_TEXTS)
def _content(text: str) -> frozenset[str]:
    return frozenset(_stem(w) for w in _WORD.findall(text.lower()) if w not in FUNCTION_WORDS)


_short_content = lru_cache(maxsize=_WORDS)(_content.__wrapped__)


@lru_cache(maxsize=_TEXTS)
def names(text: str) -> list[str]:
    """Names: an inner capital anywhere; capitals, or a capital within a sentence, unless the text shouts."""
    plain = re.sub(r"```[\s\S]*?```|`[^`\n]+`|https?://\S+", " ", text)
    letters = re.findall("[A-Za-z]", plain)
    shouts = sum(c.isupper() for c in letters) > 0.6 * len(letters)
    found: dict[str, None] = {}
    for m in re.finditer(r"(?<![A-Za-z0-9_+#])[A-Za-z0-9][A-Za-z0-9_+#]*(?:[-.][A-Za-z0-9_+#]+)*", plain):
        w = m[0].removesuffix(".")
        if len(w) < 2 or not re.search("[A-Za-z]", w) or w.lower() in NOT_NAMES:
            continue
        at = m.start()
        while at and plain[at - 1].isspace():
            at -= 1
        opens = not at or "\n" in plain[at : m.start()] or plain[at - 1] in ".!?:;-*•([\"'“‘"
        if re.search("[a-z][A-Z]", w) or (not shouts and (re.fullmatch("[A-Z]{2,}[A-Z0-9+#-]*", w) or (re.match("[A-Z][a-z]", w) and not opens))):
            found[w] = None
    return list(found)


def payload_at(text: str) -> int | None:
    """Where material that is not to be edited begins, if something follows its announcement."""
    m = PAYLOAD.search(text)
    return m.end() if m and text[m.end() :].strip() else None


def payload(text: str) -> str | None:
    at = payload_at(text)
    return (SIGN_OFF.sub("", text[at:]).strip() or None) if at is not None else None


@dataclass
class Parts:
    objective: str = ""
    context: list[str] = field(default_factory=list)
    constraints: list[str] = field(default_factory=list)
    format: list[str] = field(default_factory=list)
    terminology: list[str] = field(default_factory=list)
    reference: list[str] = field(default_factory=list)


@lru_cache(maxsize=_TEXTS)
def parts(prompt: str | None) -> Parts:
    """Objective, context, constraints, formats, terms and protected spans of a prompt."""
    if not (prompt or "").strip():
        return Parts()
    m = _mask(prompt)
    text = m.masked
    said = [x for x in map(str.strip, re.split(r"(?<=[.!?])\s+|\n+", text)) if x]
    objective = next((s for s in said if ASKS.search(s) or "?" in s), said[0] if said else "")
    unique = lambda xs: list(dict.fromkeys(xs))
    terms = [w for w in re.findall(r"\b[A-Z][A-Za-z0-9+#.]*\b", text, re.A) if len(w) > 1]
    acronyms = [w[0] for w in W._compiled(tuple(W.ACRONYMS)).finditer(text)]
    return Parts(objective, [s for s in said if s != objective], unique(h[0].strip() for p in CONSTRAINTS for h in p.finditer(text)), unique(f[0].lower() for f in FORMATS.finditer(text)), unique(terms + acronyms), list(m.spans))


def select_modifiers(run: list[str]) -> list[bool]:
    """Which modifiers of a run stay: of those that say the same the most specific, first; opinions only if nothing else
    in the run is concrete."""
    low = [w.lower() for w in run]
    best: dict[str, int] = {}
    for k, w in enumerate(low):
        if w in _PLACE and (_PLACE[w][0] not in best or _PLACE[w][1] < _PLACE[low[best[_PLACE[w][0]]]][1]):
            best[_PLACE[w][0]] = k
    keep = [w not in _PLACE or best[_PLACE[w][0]] == k for k, w in enumerate(low)]
    concrete = any(w in REQUIREMENTS or w in _PLACE or w not in OPINIONS for w in low)
    return [stay and not (concrete and w in OPINIONS) for stay, w in zip(keep, low)]


def thin_modifiers(text: str) -> str:
    """Runs of two or more modifiers reduced to those that say something of their own."""
    known, bare = _MODIFIERS, _bare
    tokens = re.split(r"(\s+)", text)
    out, k = [], 0
    while k < len(tokens):
        run = []
        for j in range(k, len(tokens), 2):
            if bare(tokens[j]) not in known:
                break
            run.append(tokens[j])
            if re.search(r"[.!?;:]$", tokens[j]):
                break
        stay = select_modifiers([bare(w) for w in run]) if len(run) > 1 else [True]
        if len(run) < 2 or all(stay):
            out.append("".join(tokens[k : k + 2]))
            k += 2
            continue
        tail = re.search("[,;]?$", run[-1])[0]
        kept = [re.sub("[,;]+$", "", w) for w, s in zip(run, stay) if s]
        out.append(" ".join(kept) + tail + "".join(tokens[k + 2 * len(run) - 1 : k + 2 * len(run)]))
        k += 2 * len(run)
    return re.sub(r"\s+([,;.])", r"\1", re.sub("[ \t]{2,}", " ", "".join(out)))


@lru_cache(maxsize=_WORDS)
def _letters(x: str) -> str:
    return _SIGNS.sub("", x.lower())


def _doubled_blocks(keys: list[str], least: int, fits: Callable[[int, int], bool]) -> list[int]:
    """Places that stay after blocks repeated right behind themselves are taken out, the longest and first of them first."""
    at = list(range(len(keys)))
    again = True
    while again:
        again = False
        for size in range(len(at) // 2, least - 1, -1):
            same = [keys[at[k]] == keys[at[k + size]] for k in range(len(at) - size)]
            run = 0
            for k, s in enumerate(same):
                run = run + 1 if s else 0
                first = k - size + 1
                if run >= size and fits(at[first], size):
                    del at[first + size : first + 2 * size]
                    again = True
                    break
            if again:
                break
    return at


def drop_repeats(text: str) -> str:
    """A run of four words or more said twice in a row once (8 to 600 words on one line); of several lines, blocks of at
    least twelve letters, and a line that the next one begins with (a draft of eight letters or more)."""
    if "`" in text:
        return text
    if "\n" not in text:
        ws = text.split()
        if not 8 <= len(ws) <= 600:
            return text
        ends = lambda k: ws[k][-1] in ".!?"
        at = _doubled_blocks([_letters(w) for w in ws], 4, lambda a, n: ends(a + n - 1) == ends(min(len(ws) - 1, a + 2 * n - 1)))
        return text if len(at) == len(ws) else " ".join(ws[k] for k in at)
    lines = text.split("\n")
    rows = [k for k, x in enumerate(lines) if _letters(x)]
    keys = [_letters(lines[k]) for k in rows]
    stay = _doubled_blocks(keys, 1, lambda a, n: sum(len(keys[a + k]) for k in range(n)) >= 12)
    stay = [k for n, k in enumerate(stay) if n + 1 == len(stay) or not (8 <= len(keys[k]) < len(keys[stay[n + 1]]) and keys[stay[n + 1]].startswith(keys[k]))]
    if len(stay) == len(rows):
        return text
    kept, gone = {rows[k] for k in stay}, {rows[k] for k in set(range(len(rows))) - set(stay)}
    return "\n".join(x for k, x in enumerate(lines) if k in kept or (k not in gone and (k + 1 not in gone)))


def drop_restated(text: str) -> str:
    """Requests, from the last back, all of whose meaning and numbers the other sentences hold."""
    if "\n" in text or "`" in text:
        return text
    said = sentences(text)
    if len(said) < 3:
        return text
    keep = list(said)
    manner = content(" ".join(MANNER))
    for s in reversed(said[1:]):
        if REQUEST.match(s) and not s.endswith("?"):
            others = list(keep)
            others.reverse()
            if s in others:
                others.remove(s)
            others.reverse()
            rest = " ".join(others)
            own = content(s) - manner
            if len(own) >= 2 and own <= content(rest) and set(numbers(s)) <= set(numbers(rest)):
                keep = others
    return text if len(keep) == len(said) else " ".join(keep)


def _tidy(text: str) -> str:
    text = re.sub(r",\s*,", ",", re.sub(r"\s+([,.?!;:])(?![=<>\d])", r"\1", re.sub("[ \t]{2,}", " ", text))).strip()
    return re.sub(r"(^|[.!?]\s+)([a-z])", lambda m: m[1] + m[2].upper(), text)


def edit(text: str, change: Callable[[str], str]) -> str:
    """A change made to what is not protected."""
    m = _mask(text)
    out = change(m.masked)
    return text if out == m.masked else unmask(out, m.spans)


def corrected(text: str, words: Dictionary, preserve: frozenset[str] = frozenset()) -> str:
    """The lightest tier: spelling by tables and dictionary, stretched and stray characters, shouting, doubled phrases."""

    def change(s: str) -> str:
        s = W.unshout(s, words)
        if looks_english_vocabulary(s, words) or len(s.split()) < 4:
            s = W.unstray(s, words)
            s = W.replace_words(s, {**W.TYPOS, **W.POLITENESS, **W.SLANG}, True, preserve)
            s = W.unstretch(s, words)

            def one(m: re.Match) -> str:
                w = m[0]
                low = w.lower()
                name = any(c.isupper() for c in w[1:]) or (w[0].isupper() and not re.search(r"(?:^|[.!?\n]\s*)\Z", m.string[max(0, m.start() - 40) : m.start()]))
                new = None if low in preserve or name else words.correct(low)
                return w if not new else new[0].upper() + new[1:] if w[0].isupper() else new

            s = re.sub(r"(?<![\w'’])[A-Za-z]+(?![\w'’])", one, s)
            s = W.replace_words(W.gated_acronyms(s), W.ACRONYMS)
        return W.collapse_repeats(s)

    return edit(text, change)


def optimized(text: str, words: Dictionary, preserve: frozenset[str] = frozenset()) -> str:
    """The middle tier: corrected, without courtesies, wordy constructions and modifiers that say the same. Code stays."""
    if is_code(text):
        return text

    def change(s: str) -> str:
        for p in PADDING:
            s = p.sub("", s)
        for p, by in CONCISE:
            s = p.sub(by, s)
        return _tidy(thin_modifiers(s))

    return edit(corrected(text, words, preserve), change)


def tightened(text: str) -> str:
    def change(s: str) -> str:
        for _ in range(2):
            for p, by in (*CONCISE, *TIGHTEN):
                s = p.sub(by, s)
        return s

    return edit(text, lambda s: s if (t := change(s)) == s else _tidy(t))


def candidates(prompt: str, words: Dictionary, preserve: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(mode, text) of all tiers; material after an announcement is never edited."""
    at = payload_at(prompt)
    if at is not None:
        head, tail = prompt[:at], prompt[at:]
        gap = re.match(r"\s*", tail)[0] or " "
        colon = head.rstrip().endswith(":")
        close = lambda t: re.sub("[.!?]$", "", t.rstrip()) + ":" if colon and not t.rstrip().endswith(":") else t.rstrip()
        return [(mode, close(t) + gap + tail.lstrip()) for mode, t in candidates(head, words, preserve)]
    light, middle = corrected(prompt, words, preserve), optimized(prompt, words, preserve)
    out = [("conservative", light), ("balanced", middle)]
    once = drop_repeats(prompt)
    if once != prompt:
        out.append(("balanced", optimized(once, words, preserve)))
    best = drop_repeats(middle)
    if best != middle:
        out.append(("balanced", best))
    tight = tightened(best)
    if tight != best:
        out.append(("aggressive", tight))
    fewer = drop_restated(tight)
    return out + [("aggressive", fewer)] if fewer != tight else out


def validate(original: str, candidate: str, words: Dictionary, also: str | None = None) -> list[tuple[str, str]]:
    """(rule, detail) of what a candidate loses or invents; none if it may replace the original. Words of `also`, the
    corrected original, do not count as invented."""
    letters = _LETTERS.findall
    if not candidate.strip():
        return [("empty", "nothing left")]
    if letters(original) and not letters(candidate):
        return [("empty", "no words left")]
    if len(letters(candidate)) <= 1 and len(letters(original)) >= 3:
        return [("empty", "one word left")]
    low = candidate.lower()
    has = lambda w: re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", low, re.A) is not None
    fixed = lambda w: (words.correct(w.lower()) or w).lower() if re.fullmatch("[A-Za-z]+", w) else w
    kept = content(candidate)
    there = lambda pool: lambda w: w in pool or fixed(w) in pool or not content(fixed(w)).isdisjoint(pool)
    out = [("name", n) for n in names(original) if not has(n) and not has(fixed(n))]
    lines = [content(x) for x in candidate.split("\n")]
    for item in re.findall(r"^[ \t]*(?:\d+\s*[.)\-]|[-*•])[ \t]+.+$", original, re.M):
        if not any(all(map(there(pool), content(item))) for pool in lines):
            out.append(("list-item", item.strip()[:40]))
    stray = re.sub(r"\b([A-Za-z]+)\d([A-Za-z]+)\b", lambda m: m[1] + m[2] if len(m[1] + m[2]) >= 3 else m[0], original, flags=re.A)
    missing = Counter(set(numbers(stray))) - Counter(numbers(candidate))
    out += [("numbers", n) for n in dict.fromkeys(numbers(stray)) if n in missing]
    out += [("verbatim", s[:40]) for s in verbatim(original) if s not in candidate]
    if data := payload(also or original) or payload(original):
        if lost := sorted(content(data) - kept):
            out.append(("payload", ", ".join(lost[:5])))
    found = parts(original)
    for c in found.constraints:
        carriers = content(c) - COMPARATORS
        if not set(numbers(c)) <= set(numbers(candidate)) or (carriers and 2 * sum(map(there(kept), carriers)) < len(carriers)):
            out.append(("constraint", c))
    formats = {m[0].lower() for m in FORMATS.finditer(candidate)} | ({"summary"} if re.search(r"\bsummari[sz]e\b", candidate, _I) else set())
    out += [("format", f) for f in found.format if f not in formats]
    task = lambda s: m[0].lower() if (m := TASK.search(s)) else None
    before, after = task(original), task(candidate)
    summary = after in ("summarize", "summarise") and re.search(r"\bsummary\b", original, _I)
    if before and after != before and before not in LOOSE_TASKS and not summary and after not in SAME_TASK.get(before, ()) and not has(before):
        out.append(("task", f"{before} -> {after}" if after else "the request verb is gone"))
    verbs = lambda s: {m[0].lower() for m in VERB.finditer(s) if not NOUN_BEFORE.search(s[: m.start()])}
    lost, gained = verbs(original) - verbs(candidate), verbs(candidate) - verbs(original)
    if len(lost) > len(gained):
        out.append(("task", "request dropped: " + ", ".join(sorted(lost))))
    invented = sorted(kept - content(original) - content(also or "") - content(" ".join(REWRITTEN)) - REWRITTEN)
    return out + ([("invention", ", ".join(invented[:5]))] if invented else [])


@dataclass
class Result:
    status: str
    text: str
    mode: str
    before: int
    after: int
    candidates: list[tuple[str, str, int, list[tuple[str, str]]]] = field(default_factory=list)

    @property
    def percent(self) -> int:
        return int(100 * (self.before - self.after) / self.before + 0.5) if self.before else 0


def tokens(text: str | None) -> int:
    """The token estimate: a quarter of the characters, averaged with 1.33 a word unless there are no real words."""
    t = (text or "").strip()
    half_up = lambda x: int(x + 0.5)
    chars, count = half_up(len(t) / 4), len(t.split())
    return 0 if not t else max(1, chars if not count or len(t) > 20 * count else half_up((half_up(1.33 * count) + chars) / 2))


def _once(prompt: str, words: Dictionary, strictness: str, count: Callable[[str], int], preserve: frozenset[str]) -> Result:
    size = count(prompt)
    at = payload_at(prompt)
    if not looks_english(prompt[:at].rstrip(": \n") if at is not None else prompt, words):
        return Result("unsupported_language", prompt, "none", size, size)
    made = candidates(prompt, words, preserve)
    scored = [(mode, t, count(t), validate(prompt, t, words, made[0][1])) for mode, t in made]
    allowed = MODES[: MODES.index(STRICTNESS[strictness]) + 1]
    fine = [x for x in scored if x[0] in allowed and not x[3]]
    loose = lambda s: re.sub(r"\s+", "", re.sub(r"(^|[.!?]\s+)([a-z])(?=[a-z])", lambda m: m[1] + m[2].upper(), " ".join(s.split())))
    best = min((x for x in fine if x[2] < size), key=lambda x: (x[2], len(x[1])), default=None) or min((x for x in fine if loose(x[1]) != loose(prompt) and x[1].count("\n") == prompt.count("\n") and x[2] <= size + 2), key=lambda x: x[2], default=None)
    if best:
        return Result("successful", best[1], best[0], size, best[2], scored)
    unsafe = any(x[3] and x[2] < size for x in scored)
    return Result("unsafe_compression" if unsafe else "already_optimal", prompt, "none", size, size, scored)


def compress(prompt: str | None, words: Dictionary, strictness: str = "condense", count: Callable[[str], int] = tokens, preserve: frozenset[str] = frozenset()) -> Result:
    """The shortest valid candidate within the strictness, and that once more of its own result if that holds."""
    if not (prompt or "").strip():
        return Result("already_optimal", prompt or "", "none", 0, 0)
    first = _once(prompt, words, strictness, count, preserve)
    if first.text == prompt:
        return first
    again = _once(first.text, words, strictness, count, preserve)
    if again.text != first.text and again.after <= first.after and not validate(prompt, again.text, words, first.candidates[0][1]):
        first.text, first.after = again.text, again.after
    return first
