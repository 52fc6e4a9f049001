"""The request cycle between batch-inference runs.

A model answers in steps: 1 first reading, 2 refinement, 3 preferences (generic requests
only), 4 offer text. Answers collect in a table ``responses(request_id, step, content)``.
``due_prompts`` reads requests and answers and gives every prompt that can be written by
now and has no answer yet, each from the answers *decoded* so far. Nothing else is kept:
a run repeated after a failure gives the same prompts, a request whose answer is missing is
asked again, and answered steps are never asked twice.

Plan: one aggregation of the answers by request (map-side combine) and one join on the
request id; a request is one row on both sides.

Defined cases: an answer without text counts as answered (its step decodes to nothing: the
default intent, no preferences); several answers of a step count as the greatest text; an
intent the source application could not use (``intent_status`` not ``ok``) gets steps 1 and
2 only; requests without a profile (unknown customers) are not asked anything; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgrid.operators import decode, render
from dealgrid.operators.intent import OK, r1_flag

STEP_OFFER = 4
_STEPS = (decode.STEP_EXTRACT, decode.STEP_REFINE, decode.STEP_PREFERENCES, STEP_OFFER)


def answers(responses: DataFrame) -> DataFrame:
    """``request_id``, texts ``c1..c3`` and flags ``a1..a4`` of the answered steps."""
    step = F.col("step")
    return responses.groupBy("request_id").agg(
        *[F.max(F.when(step == k, F.col("content"))).alias(f"c{k}") for k in _STEPS[:3]],
        *[F.coalesce(F.bool_or(step == k), F.lit(False)).alias(f"a{k}") for k in _STEPS],
    )


def due_prompts(requests: DataFrame, responses: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """``request_id, step, text`` of the prompts due. ``requests``: ``request_id,
    user_request, profile, offer_profile`` (profile texts with and without amounts);
    ``offers``: ``request_id, summary`` of the requests matched so far, if any."""
    flags = [f"a{k}" for k in _STEPS]
    keep = ("user_request", "profile", "offer_profile", *flags)
    asked = requests.filter(F.col("profile").isNotNull()).join(answers(responses), "request_id", "left")
    asked = asked.withColumns({a: F.coalesce(a, F.lit(False)) for a in flags})
    read = decode.typed_intents(
        decode.resolved(asked, keep), "intent", keep=("request_id", "initial", "intent", *keep)
    )
    if offers is None:
        read = read.withColumn("summary", F.lit(None).cast("string"))
    else:
        read = read.join(offers.select("request_id", "summary"), "request_id", "left")
    a1, a2, a3, a4 = (F.col(a) for a in flags)
    text, profile = F.col("user_request"), F.col("profile")
    usable = a1 & a2 & (F.col("intent_status") == OK)
    r1 = r1_flag(F.col("is_generic"), F.col("is_ambiguous"), F.col("confidence"))
    ready = usable & (~r1 | a3) & F.col("summary").isNotNull()
    prompts = (
        F.when(~a1, render.extract_prompt(text)),
        F.when(a1 & ~a2, render.refine_prompt(text, render.variant_json(F.col("initial")), profile)),
        F.when(usable & r1 & ~a3, render.preference_prompt(F.col("category"), profile)),
        F.when(
            ready & ~a4,
            render.offer_prompt(
                F.col("offer_profile"), render.variant_json(F.col("intent")), F.col("summary"), text
            ),
        ),
    )
    steps = [F.struct(F.lit(k).alias("step"), p.alias("text")) for k, p in zip(_STEPS, prompts, strict=True)]
    due = read.select("request_id", F.explode(F.array(*steps)).alias("p"))
    return due.filter(F.col("p.text").isNotNull()).select("request_id", "p.step", "p.text")
