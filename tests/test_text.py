"""Text kernels on literal cases, and their operators over DataFrames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leanprompt.operators import text as T
from leanprompt.text import compress as C
from leanprompt.text import diff, findings, language, protect, scoring
from leanprompt.text import words as W

RANKED = "the a and of to in is you that it for on with as are this write explain story about dog make short please how works hello thanks could learn python list steps simple recursion give me should because receive world code what does function sort order help my prompt".split()


@pytest.fixture(scope="module")
def words():
    return W.Dictionary(RANKED)


def test_spans_by_name():
    m = protect.mask('Run `x = 1` at https://a.b/c in src/app/main.py with --force on v1.2.3, "as is", my_var fooBar e.g. 0xFF 10 ms')
    assert m.names == ["inline-code", "abbreviation", "url", "relative-path", "double-quoted", "cli-flag", "version", "hex-literal", "measurement", "snake-case", "camel-case"]


def test_masking_gives_back_every_text():
    r = random.Random(1)
    parts = ["`a`", "```\nx\n```", "if (x) {", "}", "A) one", "B) two", "http://x.y/z", '"q"', "\n", " ", "word", "a_b", "e.g. ", "'''", "SELECT a FROM b;", "at f (x:1)", "\t", "1.2.3", "(", "$x", "--flag", ":)"]
    for _ in range(3_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 20)))
        m = protect.mask(text)
        assert protect.unmask(m.masked, m.spans) == text
        assert protect.OPEN not in protect.strip(m.masked)


def test_code_runs_and_options():
    assert protect.mask("please fix\nif (x) {\n  return 2;\n\n}\nthanks a lot my friend").names == ["code-block"]
    assert protect.mask("one line {").names == []
    assert protect.mask("Which is right?\nA) recieve\nB) receive").names == ["answer-option"] * 2
    assert protect.mask("Which: A) recieve B) receive").names == ["answer-option"]


def test_distances_and_indexes():
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                c = a[i - 1] != b[j - 1]
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + c)
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + c)
        return d[len(a), len(b)]

    r = random.Random(2)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(2))
        assert W.distance(a, b) == plain(a, b)
    assert W.distance("ca", "abc") == 3 and W.budget("cat", "cats") == 1 and W.budget("abcdefghi", "x") == 3
    assert W.skeleton("balloon") == "bln" and W.deletions("abc") == ["abc", "bc", "ac", "ab"] and len(W.deletions("a" * 13)) == 1
    assert W.neighbour_slip("wprld", "world") and not W.neighbour_slip("qorld", "world")


def test_corrections(words):
    assert [words.correct(w) for w in ("recieve", "becuase", "shuold", "wrold", "zzz", "story", "works", "learning")] == ["receive", "because", "should", "world", None, None, None, None]
    assert W.unstretch("heeeello wooorld", words) == "hello world" and W.unstray("wr1te 2nd h2o", words) == "write 2nd h2o"
    assert W.unshout("PLEASE WRITE THE STORY FOR NASA", words) == "Please write the story for NASA"
    assert W.unshout("NASA API", words) == "NASA API"
    assert W.collapse_repeats("the the cat had had it, so so good, 1 1") == "the cat had had it, so so good, 1 1"
    assert W.replace_words("Thx gimme it", {**W.POLITENESS, **W.SLANG}, True) == "Thanks give me it"
    assert W.replace_words("thx", W.POLITENESS, preserve=frozenset({"thx"})) == "thx"
    assert W.gated_acronyms("a rest api, take a rest") == "a REST api, take a rest"


def test_language_and_code(words):
    assert language.looks_english("please explain how this works", words) and not language.looks_english("wie geht es dir heute mein freund", words)
    assert not language.looks_english("日本語のテキストです", words) and not language.looks_english("", words)
    assert language.looks_english_vocabulary("explian teh story", words)
    for code in ("if (x > 1) { return 2; }", "SELECT a FROM b", "const x = 1", "Traceback (most recent call last):", "<div>", '{"a": 1}'):
        assert language.is_code(code), code
    for plain in ("let me know what you think", "Create an education platform", "Update the README", "for each student calculate the average"):
        assert not language.is_code(plain), plain


def test_efficiency(words):
    assert scoring.efficiency("  ", words) == (None, []) and scoring.efficiency("`x`", words) == (100, [])
    score, flags = scoring.efficiency("Hello, could you please write the story about the dog? Thanks!!", words)
    assert dict((label, p) for _, label, p in flags) == {"Greetings detected": 5, "Over-politeness/emotional padding detected": 24, "Excessive punctuation & symbol spam detected": 10, "Sign-off & gratitude padding detected": 6, "missing-output-format": 8}
    assert score == 47 and scoring.efficiency("Explain recursion in 3 steps.", words)[0] == 100
    assert scoring.efficiency("Explain recursion in 3 steps.", words, grammar=7)[0] == 85
    assert [(i, p) for i, _, p in scoring.scope("Write " + ", ".join(f"part {k}" for k in range(17)))] == [("list-items", 3)]
    assert [(i, p) for i, _, p in scoring.scope("Build and design it, test and deploy it from scratch")] == [("deliverables", 2), ("from-scratch", 0)]
    assert scoring.quality("Summarise this and", True)[-1] == ("truncated-instruction", 1, 10)


def test_findings():
    got = findings.analyze("Write a brief but detailed website. Explain everything in exactly 3 words with 5 examples.")
    assert [f.category for f in got] == ["contradiction", "contradiction", "scope", "missing-context"]
    assert findings.classify([("redundancy", "Twice"), ("spelling", "twice"), ("phrasing", "x")]) == [("spelling", "Twice", "error", 2), ("phrasing", "x", "suggestion", 1)]
    a = findings.Finding("scope", "improvement", "one", 0.5, "abc", 3)
    b = findings.Finding("scope", "error", "two", 0.9, "bcd", 4)
    c = findings.Finding("scope", "error", "three", 0.9, "xyz", 30)
    merged = findings.merge([a, b, c])
    assert [(f.severity, f.explanation, f.start) for f in merged] == [("error", "two", 4), ("error", "three", 30)]
    extra = findings.analyze("plain", lambda p: [{"category": "scope", "explanation": "big", "confidence": 1.0}])
    assert (extra[0].confidence, extra[0].source) == (0.9, "semantic")
    assert findings.analyze("a a", lambda p: 1 / 0) == findings.analyze("a a")


def test_parts_names_and_repeats():
    p = C.parts("Write a 300 words essay in Python. Must not use JSON.")
    assert p.objective.startswith("Write") and p.constraints == ["300 words", "Must not use", "in Python."] and p.format == ["essay", "json"]
    assert C.names("I use React with NASA data. Hello Bob, in Paris, iPhone") == ["React", "NASA", "Bob", "Paris", "iPhone"]
    assert C.drop_repeats("write a poem on cats write a poem on cats now") == "write a poem on cats now"
    assert C.drop_repeats("first line here\nfirst line here\nend") == "first line here\nend"
    assert C.thin_modifiers("a beautiful simple easy short guide") == "a simple short guide"
    assert C.payload("Translate the following text: guten Tag\nBest regards, Bob") == "guten Tag"
    assert C.drop_restated("Explain sorting lists. It must be quick. I want to understand sorting lists.") == "Explain sorting lists. It must be quick."


@pytest.mark.parametrize("rule,candidate", [("empty", " "), ("name", "Explain 12 sorts, use `x` as a list"), ("numbers", "Explain sorts for Bob, use `x` as a list"), ("verbatim", "Explain 12 sorts for Bob as a list"), ("format", "Explain 12 sorts for Bob, use `x`"), ("task", "12 sorts for Bob, use `x` as a list"), ("invention", "Explain 12 sorts for Bob, use `x` as a list of animals")])
def test_validator(words, rule, candidate):
    original = "Please explain 12 sorts for Bob, use `x` as a list"
    assert rule in {r for r, _ in C.validate(original, candidate, words)}
    assert not C.validate(original, "Explain 12 sorts for Bob, use `x` as a list", words)


def test_compression_keeps_what_matters(words):
    r = C.compress("Hello, could you please explain recursion in order to learn Python 3.11? Thanks!!", words)
    assert (r.status, r.text) == ("successful", "Explain recursion to learn Python 3.11?") and r.after < r.before
    assert C.compress("wie geht es dir heute mein freund", words).status == "unsupported_language"
    assert C.compress("Explain recursion.", words).status == "already_optimal"
    assert C.compress("Please explain it", words, "fixes").mode in ("none", "conservative")
    r = random.Random(4)
    parts = ["Hello, ", "please ", "explain ", "the story ", "about recursion ", "in order to ", "learn it ", "3 steps ", "`code` ", "https://a.b/c ", "Thanks! ", "simple easy ", "Bob ", "and and "]
    for _ in range(200):
        text = "".join(r.choice(parts) for _ in range(r.randrange(2, 12))).strip()
        out = C.compress(text, words).text
        assert out.strip() and protect.OPEN not in out and len(out) <= 1.25 * len(text) + 20
        for p in (r"\d+", r"`[^`]+`", r"https?://\S+"):
            assert set(re.findall(p, text)) <= set(re.findall(p, out)), (text, out)


def test_word_diff():
    before, after = diff.word_diff("a b c d", "a c d e")
    assert before == [("a ", False), ("b ", True), ("c ", False), ("d", False)] and after == [("a ", False), ("c ", False), ("d ", False), ("e", True)]
    assert diff.word_diff("x " * 1500, "y " * 1500) is None and diff.losses("1 2 2 `x`", "2") == {"numbers": ["1", "2"], "code": ["`x`"]}

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        return t[0][0]

    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        left, right = diff.word_diff(" ".join(a), " ".join(b))
        assert [w.strip() for w, c in left if not c] == [w.strip() for w, c in right if not c] and sum(not c for _, c in left) == plain(a, b)


def test_operators_over_odd_rows(spark):
    rows = [(1, "Hello, please explain recursion in order to learn python!!"), (2, None), (3, ""), (4, "Hello, please explain recursion in order to learn python!!"), (5, "fix `x` and\n" + "word " * 300)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("mask", F.lit("clash"))
    df = df.drop("mask")
    m = T.masks(df)
    assert {r.id: r.text for r in T.unmasked(m.select("id", "mask.masked", "mask.spans")).collect()} == {i: t or "" for i, t in rows}
    s = {r.id: r.efficiency for r in T.scores(df, RANKED).collect()}
    assert s[1] == s[4] and s[2].score is None and s[3].score is None and len(s) == 5
    assert {r.flag: r.n for r in T.flag_frequency(T.scores(df, RANKED)).collect()}["waste: Greetings detected"] == 2
    done = T.compressed(df, RANKED).persist()
    assert {r.id: r.compression.status for r in done.collect()}[1] == "successful"
    assert T.benchmark(done).where("size is null").first().n == 5 and T.rejections(done).count() > 0 and T.examples(done, "id").count() >= 1
    assert T.found(df).count() == 5 and T.languages(df, RANKED).where("language.english").count() >= 2
    assert {r.name for r in T.span_census(df).collect()} == {"inline-code"}
    assert T.masks(df.limit(0)).count() == 0
    assert T.word_diffs(df.withColumn("b", F.lit("x")), "text", "b").where("id = 1").first().diff.after[0].changed
