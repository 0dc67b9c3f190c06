"""History analytics (turns and scored events)."""

from __future__ import annotations

from leanprompt.functions.dialect import Dialect
from leanprompt.functions.measures import carbon, energy, grams, headroom_level, js_round, rating, token_estimate
from leanprompt.sources.tables import AS_OF, scored_events, turns

LIMIT, RESERVED, CAP = 128_000, 4_096, 500


def turn_token_footprint(d: Dialect) -> str:
    return f"""with {turns(d)} select conv_id, count(*) as n_turns, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(response_tokens) as bigint) as response_tokens,
  cast(round(sum({energy('prompt_tokens + response_tokens')}), 4) as double) as electricity, cast(round(sum({carbon('prompt_tokens + response_tokens')}), 4) as double) as carbon from turns group by conv_id"""


def history_aggregate(d: Dialect) -> str:
    return f"""with {scored_events()} select user_id, count(*) as n, cast(round(sum(coalesce(value, 0)), 4) as double) as total, {js_round('avg(coalesce(score, 100))')} as mean_score,
  {rating(js_round('avg(coalesce(score, 100))'))} as rating from scored group by user_id"""


def headroom_running(d: Dialect) -> str:
    usable = LIMIT - RESERVED
    return f"""with t as (select conv_id, turn, {token_estimate(d, 'text')} as tokens from conversations),
r as (select conv_id, turn, cast(sum(tokens) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as used from t)
select conv_id, turn, used, {usable} - used as remaining, least(100, {js_round(f'100.0 * used / {usable}')}) as percent_used, {headroom_level(f'({usable} - used)', str(usable))} as level from r"""


def streak(d: Dialect) -> str:
    today = f"cast({AS_OF} as date)"
    return f"""with {scored_events()}, daily as (select user_id, day, max(case when score >= 90 then 1 else 0 end) as credit from scored where day <= {today} group by user_id, day),
anchor as (select user_id, case when max(case when day = {today} then credit end) = 1 then {today} when max(case when day = {d.days(today, '1')} then 1 end) = 1 then {d.days(today, '1')} end as a from daily group by user_id),
isle as (select user_id, day, {d.days('day', 'row_number() over (partition by user_id order by day)')} as g from daily where credit = 1),
span as (select user_id, g, max(day) as last, count(*) as n from isle group by user_id, g)
select anchor.user_id, coalesce(max(case when span.last >= anchor.a then (select_n) end), 0) as streak from (select s.*, s.n as select_n from span s) span right join anchor on span.user_id = anchor.user_id and span.last = anchor.a group by anchor.user_id"""


def weekly_challenge(d: Dialect) -> str:
    """A week's tokens. Values are added in the order of their events, as the oracle adds them on one thread: floor() tells
    apart sums that only the order of adding does. A window keeps that order and spills; a plain sum is of no order."""
    if d.spark:
        total = "max_by(running, k)"
        return f"""with {scored_events()}, ordered as (select user_id, sum(value) over w as running, row_number() over w as k from scored where ts >= {AS_OF} - interval '7' day window w as (partition by user_id order by event_id, value rows unbounded preceding))
select user_id, cast(floor({total}) as bigint) as tokens, least(100, {js_round(f'floor({total}) / 500.0 * 100')}) as progress from ordered group by user_id"""
    return f"""with {scored_events()} select user_id, cast(floor(sum(value)) as bigint) as tokens, least(100, {js_round('floor(sum(value)) / 500.0 * 100')}) as progress from scored where ts >= {AS_OF} - interval '7' day group by user_id"""


def _series(bucket: str) -> str:
    return f"""with {scored_events()}, b as (select user_id, {bucket} as bucket, value, event_id from scored) select user_id, bucket, count(*) as n, cast(round(sum(value), 4) as double) as total, min(event_id) as first_seen from b group by user_id, bucket"""


def daily_series(d: Dialect) -> str:
    return _series("day")


def weekly_series_sunday(d: Dialect) -> str:
    return _series(d.sunday("day"))


def monthly_series(d: Dialect) -> str:
    return _series(d.month("day"))


def duplicate_prompts(d: Dialect) -> str:
    return f"""with t as (select doc_id, {d.trim('text')} as key from documents), k as (select doc_id, md5(key) as key_md5, substr(key, 1, 30) as sample from t where key is not null) select key_md5, count(*) - 1 as repeats, max(doc_id) as last_seen, min(sample) as sample from k group by key_md5 having count(*) > 1"""


def rapid_regenerations(d: Dialect) -> str:
    return f"""with l as (select user_id, event_id, event_type, ts, lag(event_type) over (partition by user_id order by event_id) as before, lag(ts) over (partition by user_id order by event_id) as was from events)
select user_id, count(*) as rapid from l where event_type = before and {d.seconds('ts')} - {d.seconds('was')} < 180 group by user_id"""


def history_penalty(d: Dialect) -> str:
    return f"""with l as (select user_id, event_id, event_type, ts, lag(event_type) over (partition by user_id order by event_id) as before, lag(ts) over (partition by user_id order by event_id) as was from events)
select event_id, case when event_type = before then case when {d.seconds('ts')} - {d.seconds('was')} < 180 then 15 else 10 end else 0 end as penalty from l"""


def daily_value_alert(d: Dialect) -> str:
    return f"""with {scored_events()} select user_id, cast(round(sum(value) * 0.36, 4) as double) as carbon, sum(value) * 0.36 > 5.0 as warn from scored where day = cast({AS_OF} as date) group by user_id"""


def fifo_cap(d: Dialect) -> str:
    return f"""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) select user_id, count(*) as kept, min(event_id) as oldest from r where k <= {CAP} group by user_id"""


def delete_by_time(d: Dialect) -> str:
    return "select count(*) as left_over from events where ts is distinct from (select max(ts) from events)"


def search_history(d: Dialect) -> str:
    hit = "contains(lower(prompt), 'the') or contains(lower(response), 'the')"
    return f"with {turns(d)} select conv_id, turn, prompt, response from turns where {hit}"


def csv_export(d: Dialect) -> str:
    guarded = "case when substr(text, 1, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then concat('''', text) else coalesce(text, '') end"
    guarded = guarded.replace("''''", "chr(39)")
    return f"""select doc_id, concat(chr(34), replace({guarded}, chr(34), concat(chr(34), chr(34))), chr(34), ',', chr(34), coalesce(lang, ''), chr(34), chr(13), chr(10)) as line from documents"""


def log_lines(d: Dialect) -> str:
    stamp = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')" if d.spark else "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    return f"select event_id, concat({stamp}, '  ', rpad(upper(event_type), 8, ' '), '  ', coalesce(props, '')) as line from events"


def gram_labels(d: Dialect) -> str:
    return f"select doc_id, {grams(f'({token_estimate(d, chr(116) + chr(101) + chr(120) + chr(116))}) * 0.00036')} as label from documents"


def nearest_user_turn(d: Dialect) -> str:
    ignore = "last(case when role = 'user' then turn end, true)" if d.spark else "last_value(case when role = 'user' then turn end ignore nulls)"
    return f"""with p as (select conv_id, turn, role, {ignore} over (partition by conv_id order by turn rows between unbounded preceding and current row) as user_turn from conversations) select conv_id, turn, user_turn from p where role = 'assistant'"""


QUERIES = [turn_token_footprint, history_aggregate, headroom_running, streak, weekly_challenge, daily_series, weekly_series_sunday, monthly_series, duplicate_prompts, rapid_regenerations, history_penalty, daily_value_alert, fifo_cap, delete_by_time, search_history, csv_export, log_lines, gram_labels, nearest_user_turn]
