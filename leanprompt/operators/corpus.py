"""Corpus cleaning, findings and evaluation."""

from __future__ import annotations

from leanprompt.functions.dialect import Dialect
from leanprompt.functions.measures import js_round, token_estimate, words

SHORT, LONG = 8, 8_000
#: What a rule counts, points a hit, most points.
WASTE = [
    ("greeting", r"(?i)\b(hello|hi there|good morning)\b", 5, 15),
    ("politeness", r"(?i)\b(please|thank you|kindly)\b", 8, 25),
    ("hedging", r"(?i)\b(maybe|perhaps|sort of)\b", 6, 18),
    ("punctuation", r"[!?][!?]+", 10, 10),
    ("table_bars", r"\|", 1, 12),
    ("urgency", r"(?i)\b(asap|urgent)\b", 6, 6),
]
SPANS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"), ("number", r"[0-9]+"), ("caps", r"[A-Z][A-Z]+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("snake", r"[a-z]+_[a-z]+")]
ZERO_WIDTH = "[\u200b-\u200f\u2060\ufeff\ufffd]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def sanitised(d: Dialect, x: str) -> str:
    control = CONTROL if d.spark else r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
    return d.replace(d.replace(x, ZERO_WIDTH, ""), control, "")


def dedupe_key(d: Dialect, x: str) -> str:
    """Lower case, white space squeezed, no space before and no run of punctuation at the end."""
    squeezed = d.trim(d.replace(f"lower({x})", r"\s+", " "))
    return d.replace(d.replace(squeezed, r" [?]", "?"), r"[\s?!.,;:/]+$", "")


def reason(d: Dialect) -> str:
    return f"case when text is null or {d.trim('text')} = '' then 'empty' when length(text) < {SHORT} then 'too_short' when length(text) > {LONG} then 'too_long' when {d.trim(sanitised(d, 'text'))} = '' then 'empty_after_sanitise' else 'kept' end"


def sanitise_counts(d: Dialect) -> str:
    return f"select doc_id, length(text) - length({sanitised(d, 'text')}) as removed, md5({sanitised(d, 'text')}) as clean_md5 from documents"


def label_audit(d: Dialect) -> str:
    return "select quality, toxic, count(*) as n, count(distinct doc_id) as docs from labels group by quality, toxic"


def phrase_conflicts(d: Dialect) -> str:
    return f"""with k as (select md5({dedupe_key(d, 'text')}) as key, quality from documents join labels using (doc_id)) select key, count(*) - 1 as repeats, count(distinct quality) as labels from k group by key having count(*) > 1"""


def corpus_stats(d: Dialect) -> str:
    return "select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by source, lang"


def script_ratio(d: Dialect) -> str:
    latin = r"\p{IsLatin}" if d.spark else r"\p{Latin}"
    return f"with c as (select doc_id, {d.hits('text', latin)} as latin, {d.hits('text', chr(92) + 'p{L}')} as letters from documents) select doc_id, latin, letters, case when letters = 0 then 0.0 else round(1.0 * latin / letters, 6) end as ratio from c".replace("0.0 else", "cast(0 as double) else cast(").replace(", 6) end", ", 6) as double) end")


def word_overuse(d: Dialect) -> str:
    return f"""with w as (select doc_id, {d.explode(d.all('lower(text)', '[a-z]{5,}'))} as word from documents) select doc_id, count(*) as overused from (select doc_id, word from w group by doc_id, word having count(*) >= 3) x group by doc_id"""


def span_pattern_hits(d: Dialect) -> str:
    """One scan: sums of all patterns side by side, then a row for each."""
    sums = ", ".join(f"cast(sum({d.hits('text', p)}) as bigint) as h{k}, cast(sum(case when {d.has('text', p)} then 1 else 0 end) as bigint) as d{k}" for k, (_, p) in enumerate(SPANS))
    if d.spark:
        return f"select stack({len(SPANS)}, {', '.join(f'{chr(39)}{n}{chr(39)}, h{k}, d{k}' for k, (n, _) in enumerate(SPANS))}) as (pattern, hits, docs) from (select {sums} from documents)"
    return f"with s as (select {sums} from documents) " + " union all ".join(f"select '{n}' as pattern, h{k} as hits, d{k} as docs from s" for k, (n, _) in enumerate(SPANS))


def finding_dedupe(d: Dialect) -> str:
    """One scan: the rules that hit a text as an array, a row for each."""
    if d.spark:
        each = ", ".join(f"case when {d.has('text', p)} then named_struct('label', '{n}', 'severity', {per}, 'ord', {k}) end" for k, (n, p, per, _) in enumerate(WASTE))
        found = f"select doc_id, inline(array_compact(array({each}))) from documents"
    else:
        found = " union all ".join(f"select doc_id, '{n}' as label, {per} as severity, {k} as ord from documents where {d.has('text', p)}" for k, (n, p, per, _) in enumerate(WASTE))
    return f"with f as ({found}) select doc_id, lower(label) as label, max(severity) as severity, min(ord) as ord, count(*) as n from f group by doc_id, lower(label)"


def preservation_loss(d: Dialect) -> str:
    """Numbers that the card, address and mail rules of redaction take out, as a multiset difference."""
    after = d.replace("text", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "")
    item = lambda x: f"select doc_id, {d.explode(d.all(x, '[0-9]+'))} as item from documents"
    return f"""with b as (select doc_id, item, count(*) as n from ({item('text')}) x group by doc_id, item), a as (select doc_id, item, count(*) as n from ({item(after)}) x group by doc_id, item)
select b.doc_id, count(*) as items, cast(sum(b.n - coalesce(a.n, 0)) as bigint) as lost from b left join a on a.doc_id = b.doc_id and a.item = b.item where b.n > coalesce(a.n, 0) group by b.doc_id"""


def floor_quantiles(d: Dialect) -> str:
    return """with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as k, count(*) over (partition by lang) as n from documents)
select lang, min(n_chars) as least, max(case when k = floor(n * 0.1) then n_chars end) as p10, max(case when k = floor(n * 0.5) then n_chars end) as p50, max(case when k = floor(n * 0.9) then n_chars end) as p90, max(n_chars) as most from r group by lang"""


def by_length(d: Dialect) -> str:
    squeezed = d.trim(d.replace("text", r"\s+", " "))
    return f"""with t as (select {token_estimate(d, 'text')} as before, {token_estimate(d, squeezed)} as after, lang from documents), b as (select *, case when before < 30 then 'short' when before < 120 then 'medium' else 'long' end as size from t)
select size, lang, count(*) as n, cast(sum(before) as bigint) as before_tokens, cast(sum(after) as bigint) as after_tokens, sum(case when after < before then 1 else 0 end) as smaller, sum(case when after = before then 1 else 0 end) as same from b group by grouping sets ((size), (lang), ())"""


def lexicon_tfidf(d: Dialect) -> str:
    """L2 norm and number of the tf-idf weights of each benchmark item: tf = 1 + ln n, idf from document frequency."""
    return f"""with w as (select item_id, {d.explode(d.all('lower(text)', '[a-z]+'))} as term from benchmark), tf as (select item_id, term, 1 + ln(count(*)) as tf from w group by item_id, term),
df as (select term, count(*) as df from tf group by term), n as (select count(*) as n from benchmark)
select item_id, count(*) as terms, cast(round(sqrt(sum(power(tf * (ln((1.0 + n) / (1.0 + df)) + 1), 2))), 6) as double) as norm from tf join df using (term) cross join n group by item_id"""


def confusion_metrics(d: Dialect) -> str:
    return """with p as (select case when contains(text, '|') or contains(text, '!!') then 0 else 1 end as predicted, quality as label from documents join labels using (doc_id)) select label, predicted, count(*) as n from p group by label, predicted"""


def first_user_turn(d: Dialect) -> str:
    return """with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'user') select conv_id, turn, length(text) as chars from r where k = 1"""


def template_augmentation(d: Dialect) -> str:
    return """with t as (select * from (values (1, 'Explain '), (2, 'Compare '), (3, 'List ')) as v(k, template)), x as (select distinct lang from documents) select k, concat(template, lang) as phrase from t cross join x where concat(template, lang) not in (select text from benchmark)"""


QUERIES = [sanitise_counts, label_audit, phrase_conflicts, corpus_stats, script_ratio, word_overuse, span_pattern_hits, finding_dedupe, preservation_loss, floor_quantiles, by_length, lexicon_tfidf, confusion_metrics, first_user_turn, template_augmentation]
