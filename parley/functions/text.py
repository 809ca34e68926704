"""Per-row text functions as pure Column expressions (JVM side, codegen-able).

None of these is a Python UDF: each is built from Spark's built-in string,
regex and higher-order array functions so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as Python's str.split()/strip() and Go's
# strings.Fields see it (Java needs the (?U) flag for non-ASCII spaces).
WS_RUN = r"(?U)\s+"
_EDGE_WS = r"(?U)^\s+|\s+$"

# Keywords of the reference's toxicity check (substring match on
# the lower-cased text) and its two confidences.
TOXIC_KEYWORDS = ("hate", "toxic", "offensive")
TOXIC_CONFIDENCE, CLEAN_CONFIDENCE = 0.95, 0.05
HALLUCINATION_CONFIDENCE = 0.8

# Prompt template of the reference model server.
PROMPT_SYSTEM = "{content}\n\n"
PROMPT_USER = "### Instruction:\n{content}\n\n"
PROMPT_ASSISTANT = "### Response:\n{content}\n\n"
PROMPT_TAIL = "### Response:\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Whitespace-separated tokens (no empty strings), like Python ``split()``."""
    return F.filter(F.split(_c(text), WS_RUN), lambda w: w != "")


def token_count(text) -> Column:
    """Number of whitespace tokens; the reference's usage counters."""
    return F.size(words(text)).cast("bigint")


def strip(text) -> Column:
    """Trim Unicode whitespace at both ends (Spark's ``trim`` trims spaces only)."""
    return F.regexp_replace(_c(text), _EDGE_WS, "")


def title(text, max_words: int = 5, max_chars: int = 50) -> Column:
    """Conversation title: the first ``max_words`` words joined by one space,
    with "..." if there were more; then cut at ``max_chars`` characters plus
    "...".  Text without words keeps its original value."""
    t = _c(text)
    w = words(t)
    n = F.size(w)
    base = (F.when(n > max_words, F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.lit("...")))
             .when(n > 0, F.array_join(w, " "))
             .otherwise(t))
    return F.when(F.length(base) > max_chars,
                  F.concat(F.substring(base, 1, max_chars), F.lit("..."))).otherwise(base)


def format_duration(ms) -> Column:
    """``1m 5s`` / ``2m`` / ``12s`` / ``345ms`` as the chat UI shows latency."""
    m = _c(ms).cast("bigint")
    minutes = F.floor(m / 60000).cast("bigint")
    secs_in_min = F.floor((m % 60000) / 1000).cast("bigint")
    secs = F.floor(m / 1000).cast("bigint")
    return (F.when(m >= 60000,
                   F.when(secs_in_min > 0,
                          F.concat(minutes.cast("string"), F.lit("m "), secs_in_min.cast("string"), F.lit("s")))
                    .otherwise(F.concat(minutes.cast("string"), F.lit("m"))))
             .when(m >= 1000, F.concat(secs.cast("string"), F.lit("s")))
             .otherwise(F.concat(m.cast("string"), F.lit("ms"))))


def prompt_piece(role, content) -> Column:
    """One message rendered for the model prompt; unknown roles render empty."""
    r, c = _c(role), _c(content)

    def render(template: str) -> Column:
        head, tail = template.split("{content}")
        return F.concat(F.lit(head), c, F.lit(tail))

    return (F.when(r == "system", render(PROMPT_SYSTEM))
             .when(r == "user", render(PROMPT_USER))
             .when(r == "assistant", render(PROMPT_ASSISTANT))
             .otherwise(F.lit("")))


def pair_text(query, response) -> Column:
    """Reward-model input text for a (query, response) pair."""
    return F.concat(F.lit("Query: "), _c(query), F.lit("\nResponse: "), _c(response))


def is_toxic(text, keywords=TOXIC_KEYWORDS) -> Column:
    low = F.lower(_c(text))
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(low, F.lit(k))
    return found


def is_hallucination(response, context, ratio: int = 2) -> Column:
    return F.length(_c(response)) > F.length(_c(context)) * ratio


def feedback_type_score(ftype) -> Column:
    """UI rating → score: thumbs up 1.0, thumbs down −1.0, anything else null."""
    t = _c(ftype)
    return F.when(t == "thumbs_up", F.lit(1.0)).when(t == "thumbs_down", F.lit(-1.0))


def preview(text, n: int = 100) -> Column:
    return F.substring(strip(text), 1, n)


def display_title(title_col, fallback: str = "New Conversation") -> Column:
    t = _c(title_col)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def initial(name) -> Column:
    return F.upper(F.substring(_c(name), 1, 1))


def is_blank(text) -> Column:
    """True for null or whitespace-only input (the chat box refuses to send it)."""
    return F.coalesce(strip(text) == "", F.lit(True))


def record_id(*parts) -> Column:
    """A stable id in UUID form from the values that identify a record: a
    re-run gives a record the same id, which a random one would not."""
    h = F.md5(F.to_json(F.array(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])))
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in cut])


def composite_key(*parts) -> Column:
    """Cache / counter key such as ``rate_limit:<user>:<path>``."""
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
