"""Server-sent-event chunk streams: parse lines, assemble finished messages.

A model streams one SSE line per token: ``data: {json}`` with
``choices[0].delta.content`` and a ``finish_reason``, then ``data: [DONE]``.
Only messages that saw a finish marker are emitted; malformed lines are
skipped and counted, valid JSON without choices is skipped.  Text on the chunk
that carries the finish reason belongs to the message; chunks after it do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# SSE framing of the reference model server.
SSE_PREFIX = "data: "
SSE_DONE = "[DONE]"
CHUNK_SCHEMA = "choices array<struct<delta: struct<content: string>, finish_reason: string>>, _broken string"
_KEEP_BROKEN = {"columnNameOfCorruptRecord": "_broken"}


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """(message_id, seq, line) → typed chunk columns.

    ``kind``: 'content', 'finish', 'done', 'malformed' (bad JSON) or 'ignored'
    (no ``data: `` prefix, e.g. blank keep-alives, or no choices).
    The JSON of a line is parsed once; the later projections only read the
    parsed struct (Catalyst keeps the projections apart because ``from_json``
    is not cheap to duplicate).
    """
    line = F.col("line")
    has_prefix = line.startswith(SSE_PREFIX)
    payload = F.when(has_prefix, F.substr(line, F.lit(len(SSE_PREFIX) + 1)))
    p1 = chunks.select("message_id", "seq", has_prefix.alias("_has"), payload.alias("_payload"),
                       F.from_json(payload, CHUNK_SCHEMA, _KEEP_BROKEN).alias("_json"))
    p2 = p1.select("message_id", "seq", "_has", "_payload", F.get(F.col("_json.choices"), 0).alias("_first"),
                   (F.col("_json").isNull() | F.col("_json._broken").isNotNull()).alias("_bad"))
    kind = (F.when(~F.coalesce(F.col("_has"), F.lit(False)), "ignored")
             .when(F.col("_payload") == SSE_DONE, "done")
             .when(F.col("_bad"), "malformed")
             .when(F.col("_first").isNull(), "ignored")
             .when(F.col("_first.finish_reason").isNotNull(), "finish")
             .otherwise("content"))
    p3 = p2.select("message_id", "seq", kind.alias("kind"), "_first")
    return p3.select("message_id", "seq", "kind",
                     F.when(F.col("kind").isin("content", "finish"), F.col("_first.delta.content")).alias("content"),
                     F.when(F.col("kind") == "finish", F.col("_first.finish_reason")).alias("finish_reason"))


def assemble_chunks(chunks: DataFrame, flag_gaps: bool = False) -> DataFrame:
    """Finished messages: the pieces in sequence order up to and including the
    first finish / done marker; unfinished messages are not emitted.  Of lines
    sent twice (equal sequence number) the one with the greatest text counts.
    ``flag_gaps`` adds ``has_gaps``: whether a line from 0 to the end is missing.

    One parse and one aggregation per message: the end position (first
    finish/done) and the pieces are gathered together, then the pieces up to
    the end are joined in order.  The text is the output row itself, so one
    message's pieces meet in one task by definition (partial aggregation
    still combines map-side).
    """
    p = parse_chunks(chunks)
    is_end = F.col("kind").isin("finish", "done")
    is_piece = F.col("kind").isin("content", "finish") & F.col("content").isNotNull()
    gaps = [F.collect_set("seq").alias("seqs")] if flag_gaps else []
    g = p.groupBy("message_id").agg(
        F.min(F.when(is_end, F.col("seq"))).alias("end_seq"),
        F.collect_list(F.when(is_piece, F.struct("seq", "content"))).alias("pieces"), *gaps)
    ordered = F.array_sort(F.filter("pieces", lambda x: x["seq"] <= F.col("end_seq")))
    g = g.filter(F.col("end_seq").isNotNull()).withColumn("pieces", ordered)
    # Equal numbers stand together, the greatest text last.
    once = F.filter("pieces", lambda x, i: F.coalesce(F.get("pieces", i + 1)["seq"] != x["seq"], F.lit(True)))
    met = F.size(F.filter("seqs", lambda q: (q >= 0) & (q <= F.col("end_seq")))) if flag_gaps else None
    flag = [(met < F.col("end_seq") + 1).alias("has_gaps")] if flag_gaps else []
    return g.select("message_id", F.array_join(F.transform(once, lambda x: x["content"]), "").alias("content"), *flag)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per message: lines by kind (malformed lines are counted, not dropped)."""
    p = parse_chunks(chunks)
    return p.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("kind") == "malformed").cast("bigint").alias("n_malformed"),
        F.max(F.col("kind").isin("finish", "done")).alias("finished"))


def build_sse_lines(messages: DataFrame, finished_when=None, malformed_when=None, empty_when=None,
                    last_text_when=None) -> DataFrame:
    """Render assistant messages as the SSE stream the model server would send:
    one line per word, then a finish line and ``[DONE]`` (unless
    ``finished_when`` is false for the message).  ``malformed_when`` replaces
    matching word lines by a broken payload, ``empty_when`` by JSON without
    choices; where ``last_text_when`` holds, the finish line carries text.
    All lines of a message come from one explode of its words."""
    w = messages.filter(F.col("role") == "assistant").select(F.col("id").alias("message_id"), F.split("content", " ").alias("ws"))
    finished = F.lit(True) if finished_when is None else F.coalesce(finished_when, F.lit(False))
    ends = F.when(finished, F.array(F.lit("finish"), F.lit("done"))).otherwise(F.array().cast("array<string>"))
    item = "struct<kind:string,word:string>"
    items = F.concat(F.transform("ws", lambda x: F.struct(F.lit("word").alias("kind"), x.alias("word")).cast(item)),
                     F.transform(ends, lambda k: F.struct(k.alias("kind"), F.lit(None).cast("string").alias("word")).cast(item)))
    rows = w.select("message_id", F.posexplode(items).alias("seq", "i")).select(
        "message_id", F.col("seq").cast("bigint").alias("seq"), "i.kind", "i.word")

    def line(delta, reason):
        return F.concat(F.lit('data: {"choices":[{"delta":'), delta, F.lit(f',"finish_reason":{reason}}}]}}'))

    word = line(F.to_json(F.struct(F.concat("word", F.lit(" ")).alias("content"))), "null")
    if empty_when is not None:
        word = F.when(empty_when, F.lit('data: {"usage":{"total":1}}')).otherwise(word)
    if malformed_when is not None:
        word = F.when(malformed_when, F.lit("data: {bad")).otherwise(word)
    finish = line(F.lit("{}"), '"stop"')
    if last_text_when is not None:
        finish = F.when(last_text_when, line(F.lit('{"content":"THE END"}'), '"stop"')).otherwise(finish)
    return rows.select("message_id", "seq", F.when(F.col("kind") == "word", word).when(F.col("kind") == "finish", finish)
                       .otherwise(F.lit("data: [DONE]")).alias("line"))


def token_usage(messages: DataFrame) -> DataFrame:
    """Whitespace-token usage per conversation and model: prompt tokens (user
    and system text), completion tokens (assistant text) and their total.

    Prompt rows carry no model of their own; they count for the model that the
    conversation's assistant messages name (the smallest, if they name several,
    whose other models then have completions alone)."""
    n = T.token_count("content")
    asst = F.col("role") == "assistant"
    own = messages.select("conversation_id", F.when(asst, F.col("model_version")).alias("model"), F.coalesce(asst, F.lit(False)).alias("answers"),
                          n.alias("tokens"), F.length("content").alias("chars"))
    # A few sums for each conversation; its prompts' sums then go to its first model.
    sums = own.groupBy("conversation_id", "answers", "model").agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))
    gathered = sums.groupBy("conversation_id").agg(F.min("model").alias("first"), F.collect_list(F.struct("answers", "model", "tokens", "chars")).alias("s"))
    each = gathered.select("conversation_id", "first", F.inline("s"))
    model = F.when(F.col("answers"), F.col("model")).otherwise(F.col("first")).alias("model_version")
    return (each.select("conversation_id", model, "answers", "tokens", "chars").groupBy("conversation_id", "model_version").agg(
        F.sum(F.when(~F.col("answers"), F.col("tokens")).otherwise(0)).cast("bigint").alias("prompt_tokens"),
        F.sum(F.when(F.col("answers"), F.col("tokens")).otherwise(0)).cast("bigint").alias("completion_tokens"),
        F.sum("chars").cast("bigint").alias("characters"))
        .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))


def latency_by_model(messages: DataFrame, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Inference latency per model: count, mean, p95 (exact, or approximate
    with bounded memory per group for very large groups)."""
    x = F.col("inference_time_ms").cast("double")
    p95 = F.percentile(x, F.lit(0.95)) if exact else F.percentile_approx(x, 0.95, accuracy).cast("double")
    return (messages.filter(F.col("inference_time_ms").isNotNull())
                    .groupBy("model_version")
                    .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean_ms"),
                         F.round(p95, 6).alias("p95_ms")))


# ------------------------------------------------------------ quantiles that merge

#: Size of the quantile sketches, and a bound of their error in rank (as a share
#: of the rows) that holds with a probability of at least 99 %, merged or not.
SKETCH_K, RANK_ERROR = 200, 0.0165


def latency_sketches(rows: DataFrame, keys: list[str], value: str = "inference_time_ms", k: int = SKETCH_K) -> DataFrame:
    """(keys, n, sketch): a KLL sketch of a few kB for each key; sketches of finer
    keys (a minute, a model) roll up into coarser ones by ``merge_sketches``."""
    x = F.col(value).cast("bigint")
    return rows.filter(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(x, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def sketch_quantile(q: float, sketch: str = "sketch"):
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(q))
