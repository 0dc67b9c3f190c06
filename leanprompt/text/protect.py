"""Protected spans: masking of code, locators, quotes and literals by numbered placeholders, and what brings them back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

from . import automaton

OPEN, CLOSE = "\ue000", "\ue001"
PLACEHOLDER = re.compile(f"{OPEN}([0-9]+){CLOSE}")
DEPTH = 12  # passes of unmasking; spans nest, each pass reveals lower numbers only

# The names and patterns of protected spans in their order of precedence, for texts by ASCII classes.
_I, _M, _IM = re.A | re.I, re.A | re.M, re.A | re.I | re.M
_FILES = "js|jsx|ts|tsx|mjs|cjs|py|java|c|cpp|cc|h|hpp|cs|rb|go|rs|php|swift|kt|html|css|scss|json|ya?ml|toml|ini|xml|sql|sh|bash|ps1|bat|md|txt|csv|tsv|log|env|lock|pem|key|crt|cer|pfx|p12|pub|wav|mp3|mp4|mkv|mov|png|jpe?g|gif|svg|webp|pdf|docx?|xlsx?|pptx?|zip|tar|gz|rar|7z|exe|dll|so|apk|ipynb|r|dart|vue|svelte|lua|pl|scala|gradle|tf|proto|db|sqlite|parquet|pkl|h5|onnx|pt|bin|iso|dmg|msi|deb|rpm|conf|cfg|properties|jar|war|class|o|a"
_COMMANDS = r"sudo|pip3?|npm|npx|yarn|pnpm|git|mkdir|apt(?:-get)?|brew|docker|kubectl|gcc|g\+\+|wget|chmod|chown|ssh|scp|conda|systemctl|msfdb|msfconsole|nmap"
_UNITS = "ms|ns|us|kb|mb|gb|tb|hz|khz|mhz|ghz|px|em|rem|vh|vw|kg|mg|lb|km|cm|mm|mi|ft|in"
PATTERNS: list[tuple[str, str, int]] = [
    ("fenced-code", r"```[\s\S]*?```", re.A),
    ("fenced-code-tilde", r"~~~[\s\S]*?~~~", re.A),
    ("triple-single", r"'''[\s\S]*?(?:'''|\Z)", re.A),
    ("triple-double", r'"""[\s\S]*?(?:"""|\Z)', re.A),
    ("inline-code", r"`[^`\n]+`", re.A),
    ("emoticon", r"(?<![^ \t\n])[:;]['-^o]?[)(\]\[DPpO3|*]+(?=[ \t]|$)", _M),
    ("indented-code", r"^(?:[ ]{4,}|\t)[^\n]*(?:\n(?:[ ]{4,}|\t)[^\n]*)*", _M),
    ("traceback", r"Traceback \(most recent call last\):[\s\S]*?(?=\n[ \t]*\n|\Z)", re.A),
    ("stack-frame", r"^[ \t]*at\s+\S[^\n]*?(?:\([^)\n]*\)|:\d+(?::\d+)?)[ \t]*$", _M),
    ("exception", r"\b[A-Z]\w*(?:Error|Exception|Warning)\b[^\n]*", re.A),
    ("abbreviation", r"\b(?:i\.e\.|e\.g\.|etc\.|vs\.|cf\.|a\.m\.|p\.m\.|approx\.|incl\.|u\.s\.|u\.k\.|ph\.d\.|dr\.|mr\.|mrs\.|ms\.|st\.|fig\.)(?=\s|,|\)|\Z)", _I),
    ("url", r"\b(?:https?|ftp|file|ws|wss)://[^\s<>\"']+", _I),
    ("bare-domain", r"\bwww\.[^\s<>\"']+", _I),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", re.A),
    ("windows-path", r"\b[A-Za-z]:\\[^\s\"'<>|]*", re.A),
    ("unix-path", r"(?<![^\s(])(?:~|\.{1,2})?/[\w.\-]+(?:/[\w.\-]+)*/?", _M),
    ("relative-path", r"\b[\w.-]+(?:/[\w.-]+)*/[\w-]+\.\w{1,6}\b", re.A),
    ("filename", rf"\b[\w.-]+\.(?:{_FILES})\b", _I),
    ("shell-line", rf"^[ \t]*(?:[!$][ \t]?[A-Za-z][\w.+-]*|(?:{_COMMANDS})[ \t])[^\n]*$", _M),
    ("code-line", r"^[ \t]*(?:#include\b|#define\b|using\s+namespace\b|from\s+[\w.]+\s+import\b|def\s+\w+\s*\(|function\s+\w+\s*\(|(?:public|private|protected|static)\s+[\w<>\[\]]+|[^\n]*;[^\n]*[{}=][^\n]*$|[^\n]*[{}=][^\n]*;\s*$)[^\n]*$", _M),
    ("command-chain", r"\b[\w.-]+(?:[ \t][\w.-]+)*;[\w.-]+(?:[ \t;][\w.-]+)*", re.A),
    ("dot-name", r"(?<![\w.])\.(?=[A-Za-z])[A-Za-z0-9]{1,10}\b", re.A),
    ("double-quoted", r'"[^"\n]{1,300}"', re.A),
    ("smart-quoted", "“[^”\\n]{1,300}”", re.A),
    ("single-quoted", "(?<![\\w'’])'[^'\\n]{3,300}'(?![\\w'’])", re.A),
    ("handlebars", r"\{\{[^}\n]+\}\}", re.A),
    ("shell-interp", r"\$\{[^}\n]+\}", re.A),
    ("windows-env", r"%[A-Za-z_][A-Za-z0-9_]*%", re.A),
    ("shell-var", r"\$[A-Za-z_][A-Za-z0-9_]*\b", re.A),
    ("cli-flag", r"(?<!\S)--?[A-Za-z][\w-]*", _M),
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", re.A),
    ("version", r"\bv?\d+\.\d+(?:\.\d+)*(?:-[\w.]+)?\b", re.A),
    ("hex-literal", r"\b0[xX][0-9a-fA-F]+\b", re.A),
    ("hash", r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b", re.A),
    ("measurement", rf"\b\d+(?:\.\d+)?\s?(?:{_UNITS})\b", _I),
    ("tag", r"</?[A-Za-z][\w.-]*(?:\s[^<>\n]*)?/?>", re.A),
    ("call", r"\b[A-Za-z_$][\w$]*\((?:[^()\n]{0,120})\)", re.A),
    ("dotted-path", r"\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]+)+\b", re.A),
    ("snake-case", r"\b[A-Za-z]+(?:_[A-Za-z0-9]+)+\b", re.A),
    ("camel-case", r"\b[a-z]+[A-Z][\w]*\b", re.A),
    ("null-device", r"[12]?>>?\s*nul\b", _I),
    ("sql-inline", r"\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE|ALTER\s+TABLE|DROP\s+TABLE)\b(?=[^;]*?\b(?:FROM|INTO|SET|WHERE|VALUES|TABLE)\b)[\s\S]*?(?:;|(?=\n[ \t]*\n)|\Z)", re.A),
]
# Dotted words that are prose, the shape of a line of code, and that of a line of prose.
DOTTED_PROSE = {"e.g", "i.e", "a.m", "p.m", "etc", "vs", "u.s", "u.k", "u.s.a", "dr", "mr", "mrs", "ms", "st", "jr", "sr", "no", "fig", "approx"}
CODE_LINE = re.compile(
    r"(?:[{}();]\s*\Z|^\s*[}\])]|=>|:=|==|!=|\+\+|--|^\s*(?:function|const|let|var|class|def|return|if|else|elif|for|while|switch|case|try|catch|except|import|from|public|private|static|void|int|string|bool|async|await|package|use|fn|impl|struct|enum)\b|^\s*[\w$.]+\s*=[^=]|^\s*[-*]\s|^\s{2,}[\w$\"'#.@<-]|^\s*#(?:include|define|undef|ifn?def|if|elif|endif|pragma|!)|^\s*</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|^\s*@\w|%~[a-z]*\d|%\w+%|>\s*nul\b|^\s*(?:rem|setlocal|endlocal|pause|goto|cls)\b|^\s*cd\s+/d\b)",
    _I,
)
PROSE_LINE = re.compile(r"^[^\n]*[a-z]{3,}\s+[a-z]{3,}\s+[a-z]{3,}[^\n]*[.!?]?\s*\Z", _I)
LEAST_LINES = 2

#: What a text must hold for a pattern to be worth a search; several patterns take time with the square of a long text.
NEEDED = {
    "fenced-code": "```", "fenced-code-tilde": "~~~", "triple-single": "'''", "triple-double": '"""', "inline-code": "`", "traceback": "Traceback", "url": "://", "bare-domain": ".", "email": "@",
    "windows-path": ":\\", "unix-path": "/", "relative-path": "/", "filename": ".", "command-chain": ";", "dot-name": ".", "double-quoted": '"', "smart-quoted": "“", "single-quoted": "'",
    "handlebars": "{{", "shell-interp": "${", "windows-env": "%", "shell-var": "$", "cli-flag": "-", "uuid": "-", "version": ".", "tag": "<", "call": "(", "dotted-path": ".", "snake-case": "_", "null-device": ">",
}
_COMPILED = [(name, re.compile(p, flags)) for name, p, flags in PATTERNS]
_OPTION = re.compile(r"[ \t]*[\"'“‘]?(?:\(([A-Za-z])\)|([A-Za-z])[).:])[ \t]+\S")
_OPTION_INSIDE = re.compile(r"\s([\"'“‘]?\(?[A-Za-z]\)[ \t]+\S)")
_OPTIONS_INLINE = re.compile(r"(?:^|[\s\"'“(])\(?[A-Ea-e]\)[ \t]+\S")
_FIRST_INLINE = re.compile(r"\(?[A-Ea-e]\)[ \t]+\S")
#: For batches: what a text must hold to have a line of code, or an answer option; and the loosened pattern of each span.
_CODE_SIGN = automaton.loosened(re.compile(CODE_LINE.pattern.replace(r"\Z", "$"), _IM))
_OPTION_SIGN = "(?m)^[ \\t]*[\"'“‘]?\\(?[A-Za-z][).:][ \\t]+\\S|(?:^|[\\s\x0b\"'“(])\\(?[A-Ea-e]\\)[ \\t]+\\S"
_LOOSE = [automaton.loosened(pattern) for _, pattern in _COMPILED]


class Mask:
    """A text under way to its masked form: what was taken out so far, by number and by the name of what took it."""

    def __init__(self, text: str):
        self.masked, self.spans, self.names = text, [], []

    def stash(self, span: str, name: str) -> str:
        self.spans.append(span)
        self.names.append(name)
        return f"{OPEN}{len(self.spans) - 1}{CLOSE}"

    def hide(self, name: str, pattern: re.Pattern) -> None:
        def take(m: re.Match) -> str:
            s = m[0]
            plain = name == "dotted-path" and (len(s) < 6 or s.lower() in DOTTED_PROSE)
            return s if not s or plain or PLACEHOLDER.fullmatch(s) else self.stash(s, name)

        self.masked = pattern.sub(take, self.masked)


def code_runs(lines: list[str]) -> Iterator[tuple[int, int]]:
    """First and past-the-last lines of runs of code: code lines that are no prose, blank lines between them allowed."""
    kind = ["blank" if not x.strip() else "code" if CODE_LINE.search(x) and not PROSE_LINE.search(x) else "prose" for x in lines]
    k = 0
    while k < len(lines):
        # a blank line can be code-shaped only by its own text, so a run begins at a code line
        if kind[k] != "code":
            k += 1
            continue
        end = last = k
        while end < len(lines) and kind[end] != "prose":
            if kind[end] == "code":
                last = end
            end += 1
        if last + 1 - k >= LEAST_LINES:
            yield k, last + 1
            k = last + 1
        else:
            k += 1


def _hide_code(mask: Mask) -> None:
    lines = mask.masked.split("\n")
    out, done = [], 0
    for a, b in code_runs(lines):
        out += [*lines[done:a], mask.stash("\n".join(lines[a:b]), "code-block")]
        done = b
    mask.masked = "\n".join([*out, *lines[done:]])


def _hide_options(mask: Mask) -> None:
    """Lettered answer options: whole lines and mid-line ones if two letters occur, else two or more in one line."""
    lines = mask.masked.split("\n")
    marks = [_OPTION.match(x) for x in lines]
    block = len({(m[1] or m[2]).lower() for m in marks if m}) >= 2
    for k, (line, mark) in enumerate(zip(lines, marks)):
        if PLACEHOLDER.fullmatch(line.strip()):
            continue
        at = None
        if block and mark:
            at = len(line) - len(line.lstrip(" \t"))
        elif block and (inside := _OPTION_INSIDE.search(line)):
            at = inside.start(1)
        elif len(_OPTIONS_INLINE.findall(line)) >= 2:
            at = _FIRST_INLINE.search(line).start()
        if at is not None:
            lines[k] = line[:at] + mask.stash(line[at:], "answer-option")
    mask.masked = "\n".join(lines)


def mask(text: str | None) -> Mask:
    """The text with protected spans out: runs of code first, then answer options, then the patterns in order."""
    m = Mask(text or "")
    steps: list[Callable[[Mask], None]] = [_hide_code, _hide_options]
    for step in steps:
        step(m)
    for name, pattern in _COMPILED:
        if NEEDED.get(name, "") in m.masked:
            m.hide(name, pattern)
    return m


def mask_all(texts: list[str | None]) -> list[Mask]:
    """mask() of each text. A pattern is searched for only in texts that an automaton does not rule out."""
    masks = [Mask(t or "") for t in texts]
    masked = pa.array([m.masked for m in masks], pa.large_string())
    for step, sign in ((_hide_code, _CODE_SIGN), (_hide_options, _OPTION_SIGN)):
        for k in (found := automaton.hits(masked, sign)):
            step(masks[k])
        masked = pa.array([m.masked for m in masks], pa.large_string()) if found else masked
    for (name, pattern), loose in zip(_COMPILED, _LOOSE):
        changed = False
        for k in automaton.hits(masked, loose):
            if NEEDED.get(name, "") in masks[k].masked:
                before = len(masks[k].spans)
                masks[k].hide(name, pattern)
                changed |= len(masks[k].spans) > before
        masked = pa.array([m.masked for m in masks], pa.large_string()) if changed else masked
    return masks


def unmask(text: str, spans: list[str]) -> str:
    """Placeholders replaced by their spans, nested ones too; a number without a span stays as it is."""
    for _ in range(DEPTH):
        if not spans or OPEN not in text:
            break
        text = PLACEHOLDER.sub(lambda m: spans[int(m[1])] if int(m[1]) < len(spans) else m[0], text)
    return text


def strip(masked: str) -> str:
    """What is left for editing: the masked text without its placeholders."""
    return PLACEHOLDER.sub("", masked).strip()


def prose(text: str | None) -> str:
    return strip(mask(text).masked)
