"""Whether a text is English enough for English rules, and whether it is code."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import regex

from .words import ACRONYMS, POLITENESS, SLANG, TYPOS, Dictionary

# Function words that mark English, those that mark it strongly, and signs of code.
MARKERS = set("the a an is are was were be to of and or in on for with that this it i you we my me what how why when which who can do does please not from as at by about if all some have has would should could will want need make give write".split())
STRONG = set("the you your can could would should what how why which this that with and for of i my it are was were do does did not from about please pls plz explain write make give tell to there their they going will have has had we when where who that's it's i'm what's don't can't you're i've didn't doesn't".split())
CHATTY = re.compile(r"(?:hi+|he+y+|yo+|hai|hlo|helo|hlw|sup|hiya|bro|bruh|bhai|sir|maam|mam|madam|dude|guys|pls|plz|plzz|thx|ty)")
CODE_SIGNS = [
    (r"^\s*(?:import|export)\s+[\w*{}\s,'\"]+from", re.M),
    (r"^\s*(?:const|let|var|function|class|def|async|await|return|yield|if|elif|else|for|while|switch|case|try|catch|except|finally|import|export|public|private|protected|static|void|struct|enum|interface|type|fn|impl|package)\b[^\n]*(?:[{};]|=|[\w$]\(|=>|->|:\s*$)", re.M),
    (r"^\s*(?:public|private|protected|static|void|int|string|boolean|double|float)\s+[\w$]", re.M),
    (r"\bSELECT\b[\s\S]{0,200}?\bFROM\b", re.I),
    (r"\bINSERT\s+INTO\s+[\w\"`\[]", re.I),
    (r"\bUPDATE\s+[\w.\"`\[\]]+\s+SET\b", re.I),
    (r"\bDELETE\s+FROM\s+[\w\"`\[]", re.I),
    (r"\b(?:CREATE|DROP|ALTER)\s+(?:TEMP(?:ORARY)?\s+)?(?:TABLE|DATABASE|SCHEMA|INDEX|VIEW|TRIGGER|PROCEDURE|SEQUENCE)\b", re.I),
    (r"^\s*(?:<[!a-zA-Z]|</?[a-zA-Z]+>)", re.M),
    (r"^\s*\{\s*\"[\w-]+\"\s*:", re.M),
    (r"Traceback\s+\(most\s+recent\s+call\s+last\):", re.I),
    (r"Error:\s+[\s\S]*?\b(?:at\s+|line\s+\d+)", re.I),
    (r"console\.(?:log|warn|error|info)\s*\(", 0),
]
LATIN_SHARE, DICTIONARY_SHARE, ACCENTED_SHARE, NEAR_SHARE = 0.65, 0.34, 0.75, 0.75

_CODE = [re.compile(p, f | re.A) for p, f in CODE_SIGNS]
_NO_LETTERS, _NO_LETTER, _NOT_LATIN = re.compile("[^A-Za-z]+"), regex.compile(r"\P{L}+"), regex.compile(r"\P{Script=Latin}+")
_EMOTICON = re.compile(r"(^|\s)[:;=8][-o'^]?[)(\]\[DPpO3|*]+(?=\s|\Z)")


def is_code(text: str | None) -> bool:
    """Any sign of code, or more than two lines of which over 35 % end like statements."""
    if not text:
        return False
    if any(p.search(text) for p in _CODE):
        return True
    lines = text.strip().split("\n")
    return len(lines) > 2 and sum(bool(re.search(r"[{};()=>]\Z", x.strip())) for x in lines) / len(lines) > 0.35


def latin_share(text: str) -> tuple[int, int]:
    """Latin letters, and letters."""
    if text.isascii():
        n = len(_NO_LETTERS.sub("", text))
        return n, n
    return len(_NOT_LATIN.sub("", text)), len(_NO_LETTER.sub("", text))


def _latin_enough(text: str) -> bool:
    latin, letters = latin_share(text)
    return letters < 8 or latin / letters >= LATIN_SHARE


@lru_cache(maxsize=1 << 16)
def _expanded(word: str) -> str:
    return TYPOS.get(word, SLANG.get(word, word)).lower().split()[0]


def _weight(word: str, words: Dictionary, near: float, least: int) -> float:
    if word in words.rank or word in MARKERS or word in SLANG or word in POLITENESS or word in TYPOS or word in ACRONYMS:
        return 1.0
    return near if len(word) >= least and words.correct(word) else 0.0


def _counted(all_: Counter[str], words: Dictionary) -> Counter[str]:
    return Counter({w: n for w, n in all_.items() if len(w) >= 3 or (len(w) == 2 and w in words.rank)}) or all_


def looks_english(text: str | None, words: Dictionary) -> bool:
    """Latin script; not six words or more with few of them strong or known; enough known words, more among accents."""
    text = _EMOTICON.sub(r"\1", text or "")
    found = Counter(re.findall(r"[a-z']+", text.lower()))
    if not text.strip() or not found or not _latin_enough(text):
        return False
    strong = {w for w in found if w in STRONG or _expanded(w) in STRONG}
    capitals = {w.lower() for w in re.findall(r"\b[A-Z]{2,5}\b", text, re.A)}
    plain = {w: n for w, n in found.items() if w not in capitals}
    known = lambda ws: sum(n for w, n in ws.items() if w in words.rank)
    if sum(plain.values()) >= 6 and len(strong) < 2 and known(plain) < 0.5 * sum(plain.values()):
        return False
    if found.total() >= 4 and not strong:
        close = sum(n for w, n in found.items() if words.known(w) or bool(CHATTY.fullmatch(w)) or w in ACRONYMS or w in SLANG or (len(w) >= 4 and bool(words.correct(w))))
        if known(found) < 2 or close < NEAR_SHARE * found.total():
            return False
    counted = _counted(found, words)
    share = sum(n * _weight(w, words, 0.5, 4) for w, n in counted.items()) / counted.total()
    return share >= (ACCENTED_SHARE if re.search("[à-öø-ÿ]", text, re.I) else DICTIONARY_SHARE)


def looks_english_vocabulary(text: str | None, words: Dictionary) -> bool:
    """The laxer test before correction: misspellings of known words count as near."""
    found = Counter(re.findall(r"[a-z']+", (text or "").lower()))
    if not (text or "").strip() or not found or not _latin_enough(text):
        return False
    counted = _counted(found, words)
    known, near = (sum(n * _weight(w, words, e, 3) for w, n in counted.items()) / counted.total() for e in (0.0, 1.0))
    if near < DICTIONARY_SHARE:
        return False
    return (near == 1 and counted.total() >= 2) or known >= 0.6 or any(w in STRONG for w in found)
