"""Views over the input tables, and the views derived from them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leanprompt.functions.dialect import Dialect
from leanprompt.functions.measures import token_estimate

TABLES = ("documents", "benchmark", "labels", "conversations", "events", "pages", "embeddings")
AS_OF = "timestamp '2024-01-30 12:00:00'"


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Lazy views; a query reads only the columns it names."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def turns(d: Dialect) -> str:
    """Each user turn with the assistant turn right after it; unpaired and system turns drop."""
    return f"""turns as (
  select u.conv_id, u.turn, u.text as prompt, a.text as response, {d.later("timestamp '2024-01-01 00:00:00'", "u.conv_id", "u.turn")} as ts,
    {token_estimate(d, 'u.text')} as prompt_tokens, {token_estimate(d, 'a.text')} as response_tokens
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"""


def scored_events() -> str:
    """Events as a scored history: the score is a deterministic surrogate made from value."""
    return "scored as (select event_id, user_id, ts, cast(ts as date) as day, event_type, value, cast(floor(value) as bigint) % 101 as score from events)"
