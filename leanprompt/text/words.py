"""Word-level kernels: replacement maps, edit distance and its indexes, dictionary-based repairs.

A dictionary is a parameter: words in order of their rank (commonest first), a list of the caller's own or one counted from
a corpus (operators/corpus.py, attested_words). Nothing here holds a word list of a language.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Replacements of whole words (lower case), and short words that keep their doubling.
POLITENESS = {"thx": "thanks", "thnks": "thanks", "thanku": "thank you", "tysm": "thank you", "ty": "thank you", "plz": "please", "pls": "please"}
SLANG = {"w/o": "without", "w/": "with", "b/c": "because", "bc": "because", "asap": "as soon as possible", "gimme": "give me", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "dunno": "don't know", "approx": "approximately"}
ACRONYMS = {w.lower(): w for w in "AI ML DL NLP LLM CV NN CNN RNN LSTM GAN OCR ETL UI UX DOM JSX TSX API APIs SQL JSON YAML TOML HTML CSS JS TS DSA DB XML CSV PDF URL URI UUID HTTP HTTPS gRPC GraphQL ORM JWT OAuth SSO CORS CSRF XSS CLI GUI IDE OS VM CPU GPU SDK npm CSS3 HTML5 OOP TDD MVC MVP QA CI CD DNS SSL TLS SSH FTP TCP UDP IP CDN PWA SSR CSR AWS GCP K8s SaaS PaaS IaaS WASM JVM JDK APK iOS PNG JPG GIF SVG ASCII BFS DFS LRU GCD LCM SEO CRM ERP KPI ROI B2B B2C FAQ".split()}
TYPOS = {"buyed": "bought", "thinked": "thought", "teached": "taught", "catched": "caught", "bringed": "brought", "goed": "went", "eated": "ate", "runned": "ran", "swimmed": "swam", "writed": "wrote", "speaked": "spoke", "drinked": "drank", "knowed": "knew", "throwed": "threw", "growed": "grew", "choosed": "chose", "fighted": "fought", "maked": "made", "taked": "took", "gived": "gave", "loosing": "losing", "hte": "the", "yuo": "you", "yuor": "your", "nad": "and", "fo": "of", "si": "is", "mch": "much", "muhc": "much", "wht": "what", "whta": "what", "becoz": "because", "bcoz": "because"}
COMPANIONS = {
    "REST": "api|apis|endpoint|endpoints|service|services|call|calls|client|architecture",
    "CRUD": "operation|operations|app|application|api|endpoint|endpoints|interface",
    "RAM": "usage|size|memory|module|modules|stick|slot|speed|limit",
    "RAG": "pipeline|pipelines|system|model|retrieval|app|application|setup|chatbot",
    "ARM": "processor|processors|architecture|chip|chips|cpu|mac|macs|64",
    "SPA": "app|application|router|routing|framework|mode",
}
KEPT_DOUBLES = {"had", "that", "is", "bye", "no", "so", "very", "really", "ha", "haha", "knock", "yeah", "well", "now", "go", "wait"}
LOOKALIKES = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
LONGEST_DELETE, MOST_EDITS = 12, 3


def alternation(keys, mask_open: str = "") -> re.Pattern:
    """Any of the keys as a whole word, the longest first; not before a word character or a placeholder."""
    return re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(keys, key=len, reverse=True))) + rf")(?![\w{mask_open}])", re.A | re.I)


@lru_cache(maxsize=16)
def _compiled(keys: tuple[str, ...]) -> re.Pattern:
    return alternation(keys)


def replace_words(text: str, table: dict[str, str], keep_case: bool = False, preserve: frozenset[str] = frozenset()) -> str:
    """Words of the table replaced; with keep_case a capital stays one; words to preserve stay."""

    def one(m: re.Match) -> str:
        w = m[0].lower()
        new = m[0] if w in preserve else table.get(w, m[0])
        return new[:1].upper() + new[1:] if keep_case and m[0][0].isupper() and new else new

    return _compiled(tuple(table)).sub(one, text)


def gated_acronyms(text: str) -> str:
    """Acronyms that are words too, capitalised before a companion that vouches for them."""
    for word, companions in COMPANIONS.items():
        text = re.sub(rf"\b{word}(?=[ \t]+(?:{companions}))", word, text, flags=re.A | re.I)
    return text


def distance(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions, and swaps of neighbours edited no further."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + (x != y))
            new.append(best)
        before, row = row, new
    return row[-1]


def budget(word: str, candidate: str) -> int:
    return min(MOST_EDITS, max(1, max(len(word), len(candidate)) // 3))


def skeleton(word: str) -> str:
    """The consonants, runs of a letter as one."""
    return re.sub("[aeiou]", "", re.sub(r"(.)\1+", r"\1", word))


def deletions(word: str) -> list[str]:
    """The word and, up to LONGEST_DELETE letters, the word without each of its letters."""
    return [word] + ([word[:k] + word[k + 1 :] for k in range(len(word))] if len(word) <= LONGEST_DELETE else [])


@lru_cache(maxsize=1)
def neighbours() -> dict[str, set[str]]:
    """Keys beside each key: in its row, and in the rows above and below at the same place or one to the side."""
    out: dict[str, set[str]] = {c: set() for row in KEY_ROWS for c in row}
    for r, row in enumerate(KEY_ROWS):
        for k, c in enumerate(row):
            out[c] |= {row[j] for j in (k - 1, k + 1) if 0 <= j < len(row)}
            for q in (r - 1, r + 1):
                if 0 <= q < len(KEY_ROWS):
                    out[c] |= {KEY_ROWS[q][j] for j in (k - 1, k, k + 1) if 0 <= j < len(KEY_ROWS[q])}
    return out


def neighbour_slip(word: str, candidate: str) -> bool:
    """Whether one inner letter was struck on a key beside the right one."""
    off = [k for k, (x, y) in enumerate(zip(word, candidate)) if x != y] if len(word) == len(candidate) else []
    return len(off) == 1 and 0 < off[0] < len(word) - 1 and candidate[off[0]] in neighbours().get(word[off[0]], ())


def within(short: str, long: str) -> bool:
    """Whether the letters of short come in long in that order."""
    rest = iter(long)
    return all(c in rest for c in short)


def plausible(word: str, candidate: str) -> bool:
    """Whether a slip could have made word of candidate: same first letter, and a swap, a neighbouring key, other vowels
    within the same consonants, letters left out, or one letter too many that is a vowel or a double."""
    if not word or not candidate or word[0] != candidate[0]:
        return False
    if sorted(word) == sorted(candidate) and distance(word, candidate) == 1:
        return True
    if neighbour_slip(word, candidate) or skeleton(word) == skeleton(candidate) or (len(word) < len(candidate) and within(word, candidate)):
        return True
    extra = [k for k in range(len(word)) if word[:k] + word[k + 1 :] == candidate]
    return any(word[k] in "aeiou" or (k and word[k] == word[k - 1]) for k in extra)


class Dictionary:
    """Known words by rank, indexed by consonant skeletons and single deletions. Corrections of the last words are kept."""

    def __init__(self, ranked: list[str]):
        self.correct = lru_cache(maxsize=1 << 17)(self.correct)
        self.rank = {w: k for k, w in reversed(list(enumerate(ranked)))}
        self.by: dict[str, set[str]] = {}
        for w in self.rank:
            for key in {"s:" + skeleton(w), *("d:" + x for x in deletions(w))}:
                self.by.setdefault(key, set()).add(w)

    def known(self, word: str) -> bool:
        return word in self.rank

    def inflected(self, word: str) -> bool:
        """Whether a regular ending was added to a known word."""
        stems = {word[: -len(e)] + add for e in ("s", "es", "ed", "d", "ing", "er", "est", "ly") if word.endswith(e) for add in ("", "e")}
        stems |= {word[:-3] + "y" for e in ("ies", "ied") if word.endswith(e)}
        stems |= {x[:-1] for x in stems if len(x) > 2 and x[-1] == x[-2]}
        return any(len(x) >= 3 and x in self.rank for x in stems)

    def candidates(self, word: str) -> set[str]:
        out: set[str] = set()
        for key in ("s:" + skeleton(word), *("d:" + x for x in deletions(word))):
            out |= self.by.get(key, set())
        return out

    def correct(self, word: str) -> str | None:
        """The plausible known word at the least distance within the edit budget; on ties the commoner one. None for words
        that are known, inflected or shorter than three letters, and where nothing fits."""
        if len(word) < 3 or self.known(word) or self.inflected(word):
            return None
        found = [(distance(word, c), self.rank[c], c) for c in self.candidates(word) if plausible(word, c)]
        fit = [x for x in found if x[0] <= budget(word, x[2])]
        return min(fit)[2] if fit else None


def unstretch(text: str, words: Dictionary) -> str:
    """Letters three times or more in a row twice, or once if only that makes a known word or the letter hardly doubles."""

    def one(m: re.Match) -> str:
        w = m[0]
        runs = re.compile(r"([a-z])\1{2,}", re.I)
        if not runs.search(w):
            return w
        double, single = runs.sub(lambda r: r[1] * (2 if r[1].lower() in "eomsnlpftr" else 1), w), runs.sub(r"\1", w)
        return single if not words.known(double.lower()) and words.known(single.lower()) else double

    return re.sub("[a-z]+", one, text, flags=re.A | re.I)


def unshout(text: str, words: Dictionary) -> str:
    """A text nearly all in capitals (at least four words, twelve letters, 90 %) with its known words in lower case."""
    letters, capitals = re.findall("[A-Za-z]", text), re.findall("[A-Z]", text)
    if len(re.findall("[A-Za-z]+", text)) < 4 or len(letters) < 12 or len(capitals) < 0.9 * len(letters):
        return text
    out = re.sub("[A-Za-z]+", lambda m: m[0].lower() if words.known(m[0].lower()) else m[0], text)
    out = re.sub(r"(^|[.!?]\s+)([a-z])", lambda m: m[1] + m[2].upper(), out)
    return re.sub(r"\bi\b", "I", out, flags=re.A)


def unstray(text: str, words: Dictionary) -> str:
    """A digit inside a word read as nothing or as a letter it looks like, where that makes a known word."""
    real = lambda w: words.known(w) or words.inflected(w)

    def one(m: re.Match) -> str:
        left, digit, right = m.groups()
        size = len(left) + len(right)
        if size < 3 or len(right) == 1 or (left[0].isupper() and (b := m.string[: m.start()].rstrip()) and b[-1] not in ".!?:"):
            return m[0]
        looks = [left + c + right for c in LOOKALIKES.get(digit, "")]
        for w in looks if size == 3 else [left + right, *looks]:
            if words.known(w.lower()) if size == 3 else real(w.lower()):
                return w
        return m[0] if size == 3 else words.correct((left + right).lower()) or m[0]

    return re.sub(r"\b([A-Za-z]+)(\d)([A-Za-z]+)\b", one, text, flags=re.A)


_REPEAT = re.compile(r"\b(?!\d)((?:[\w'-]+[ \t]+){0,5}?[\w'-]+)(?:,?[ \t]+\1\b)+", re.A | re.I)
_CLAUSE = re.compile(r"[ \t]+(?:can|could|should|will|would|must|may|might|are|is|was|were|have|has|need|want|get)\b", re.I)


def collapse_repeats(text: str) -> str:
    """A phrase of up to six words said twice or more in a row said once."""

    def one(m: re.Match) -> str:
        single = not re.search(r"\s", m[1])
        keep = m[1].lower() in KEPT_DOUBLES or (single and ("," in m[0] or _CLAUSE.match(m.string, m.end())))
        return m[0] if keep else m[1]

    return _REPEAT.sub(one, text)
