"""Capture of prompts and replies from a stream of page events, by Structured Streaming.

Policy, where the engine has timers and a stream needs a bound: event time with a watermark of LATENESS; a reply is final
QUIET after its last change, input DEBOUNCE after its last keystroke (session windows); repeats are dropped within the
watermark and not for ever; rows later than the watermark are not counted in again (late_rows tells how many there were).
All functions take batch DataFrames too, with the same result once everything has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leanprompt.operators.native import carbon, energy, token_estimate, trim

# Fixed values.
LATENESS, QUIET, DEBOUNCE_FIRST, DEBOUNCE_OPEN, THROTTLE = "10 minutes", "800 milliseconds", "120 milliseconds", "220 milliseconds", "400 milliseconds"
LEAST_INPUT, KEY_CLIP, ERROR_LENGTH, UNDO = 5, 100, 200, 5
ERROR_REPLY = r"(?i)couldn'?t load|something went wrong|network error|error in (?:message|body) stream|an error occurred|there was an error generating|request timed out|too many requests"


def debounced_input(events: DataFrame, first: bool = True) -> DataFrame:
    """(conv_id, ts, text): the last text of each burst of input events(conv_id, ts, text), if it is long enough."""
    gap = DEBOUNCE_FIRST if first else DEBOUNCE_OPEN
    bursts = events.withWatermark("ts", LATENESS).groupBy("conv_id", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", "text")).alias("last"))
    return bursts.select("conv_id", F.col("last.ts").alias("ts"), F.col("last.text").alias("text")).where(F.length("text") >= LEAST_INPUT)


def throttled(events: DataFrame) -> DataFrame:
    """(conv_id, start, changes): page changes by tumbling windows of THROTTLE, one look at the page each."""
    return events.withWatermark("ts", LATENESS).groupBy("conv_id", F.window("ts", THROTTLE).alias("w")).agg(F.count("*").alias("changes")).select("conv_id", F.col("w.start").alias("start"), "changes")


def final_replies(events: DataFrame) -> DataFrame:
    """(conv_id, turn, ts, prompt, response): the text of each reply once it has been quiet, its last one.

    events(conv_id, turn, ts, prompt, response, streaming): states of a growing reply; one that still streams restarts the
    wait. A reply that ends in streaming is not final.
    """
    states = events.withWatermark("ts", LATENESS).groupBy("conv_id", "turn", F.session_window("ts", QUIET).alias("w")).agg(F.max(F.struct("ts", "streaming", "prompt", "response")).alias("last"))
    out = states.where("not last.streaming").select("conv_id", "turn", F.col("last.ts").alias("ts"), trim(F.col("last.prompt")).alias("prompt"), trim(F.col("last.response")).alias("response"))
    return out.where("prompt <> '' and response <> ''")


def usable(replies: DataFrame) -> DataFrame:
    """Replies without the short ones that are error messages."""
    return replies.where(~((F.length("response") < ERROR_LENGTH) & F.col("response").rlike(ERROR_REPLY)))


def keyed(replies: DataFrame) -> DataFrame:
    return replies.withColumn("capture_key", F.concat_ws("_", F.substring("prompt", 1, KEY_CLIP), F.substring("response", 1, KEY_CLIP)))


def once(replies: DataFrame) -> DataFrame:
    """One row for each conversation's key of clipped prompt and reply; in a stream within the watermark."""
    rows = keyed(replies)
    return rows.dropDuplicatesWithinWatermark(["conv_id", "capture_key"]) if rows.isStreaming else rows.dropDuplicates(["conv_id", "capture_key"])


def measured(replies: DataFrame) -> DataFrame:
    """Replies as turns: tokens of both sides and links, and their footprint."""
    links = F.regexp_count("prompt", F.lit(r"https?://[^\s]+"))
    rows = replies.withColumns({"promptTokens": token_estimate(F.col("prompt")) + links * 2000, "responseTokens": token_estimate(F.col("response")), "attachedLinks": links})
    rows = rows.withColumn("totalTokens", F.col("promptTokens") + F.col("responseTokens"))
    return rows.withColumns({"electricity": energy(F.col("totalTokens")), "carbon": carbon(F.col("totalTokens"))})


def capture(events: DataFrame) -> DataFrame:
    """From page events to turns: final, no error, once, measured."""
    return measured(once(usable(final_replies(events))))


def fresh(replies: DataFrame, sent: DataFrame) -> DataFrame:
    """Replies (conv_id, turn, ts) that came after the last prompt sent(conv_id, turn, ts) before them: those of turns the
    page did not show when it was sent."""
    last = sent.select("conv_id", F.col("turn").alias("sent_turn"), F.col("ts").alias("sent_ts"))
    return replies.join(last, (replies["conv_id"] == last["conv_id"]) & (replies["turn"] > last["sent_turn"]) & (replies["ts"] >= last["sent_ts"]), "left_semi")


def running_total(turns: DataFrame) -> DataFrame:
    """turns with the tokens of their conversation so far (batch)."""
    so_far = Window.partitionBy("conv_id").orderBy("ts", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("conversationTokens", F.sum("totalTokens").over(so_far))


def undo_stack(edits: DataFrame) -> DataFrame:
    """(conv_id, stack): the last UNDO texts of edits(conv_id, ts, text, sent) since the conversation last sent a prompt."""
    sent = edits.where("sent").groupBy("conv_id").agg(F.max("ts").alias("sent_ts"))
    open_ = edits.where("not sent").join(sent, "conv_id", "left").where("sent_ts is null or ts > sent_ts")
    recent = open_.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("ts")))).where(F.col("k") <= UNDO)
    return recent.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "text"))), lambda e: e["text"]).alias("stack"))


def late_rows(events: DataFrame, lateness_seconds: int = 600) -> DataFrame:
    """(late, n) of events(arrival, ts) in order of arrival: rows older than the newest so far by more than the lateness
    (a batch measure over what a stream recorded)."""
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hourly = events.groupBy(F.date_trunc("hour", "arrival").alias("hour")).agg(F.max("ts").alias("top"))
    ahead = hourly.select("hour", F.max("top").over(before).alias("ahead"))
    inside = Window.partitionBy("hour").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("hour", F.date_trunc("hour", "arrival")).withColumn("inside", F.max("ts").over(inside)).join(ahead, "hour")
    newest = F.greatest("inside", "ahead")
    late = F.coalesce(newest.cast("double") - F.col("ts").cast("double") > lateness_seconds, F.lit(False))
    return rows.groupBy(late.alias("late")).agg(F.count("*").alias("n"))
