"""The generate, critic and refine loop in two forms with the same result.

run_loop() is for real models: one pass over the pages, each page's loop inside its partition with a bounded pool, so no
call is made twice because a later stage is computed again. unrolled() is for models that are column expressions: at
most 2 + 2 * max_cycles steps in one plan, guarded by whether a page is still active; Catalyst can see through all of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import geometry, text as X
from .model import Client, bounded, python_transcription

STATES = "accumulated_text string, iteration_count int, generation_history array<string>, critic_score int, critic_issues array<string>, reflect_iteration int, error string"


def initial(pages: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return pages.withColumns({"accumulated_text": F.lit(""), "iteration_count": F.lit(0), "generation_history": none, "critic_score": F.lit(0), "critic_issues": none, "reflect_iteration": F.lit(0)})


def unrolled(pages: DataFrame, generate: Callable[[], Column], critic: Callable[[Column, Column], Column], refine: Callable[[Column, Column, Column], Column], max_cycles: int = 2) -> DataFrame:
    """generate() gives the first reply, critic(text, cycle) JSON, refine(text, issues, cycle) the next reply."""
    df = initial(pages).withColumn("accumulated_text", X.extract_or_raw(generate()))
    df = df.withColumns({"iteration_count": F.lit(1), "generation_history": X.append_history(F.col("generation_history"), F.col("accumulated_text")), "active": F.lit(True)})
    for cycle in range(max_cycles + 1):
        judged = X.parse_critic(critic(F.col("accumulated_text"), F.lit(cycle)))
        df = df.withColumn("judged", F.when(F.col("active"), judged))
        lost = F.col("active") & F.col("judged").isNull()
        none = F.array().cast("array<string>")
        df = df.withColumns({
            "critic_score": F.when(lost, 0).otherwise(F.coalesce("judged.score", "critic_score")),
            "critic_issues": F.when(lost, none).otherwise(F.coalesce("judged.issues", "critic_issues")),
        })
        again = geometry.route(F.col("critic_score"), F.col("critic_issues"), F.col("reflect_iteration"), max_cycles) == "refine"
        df = df.withColumn("active", F.col("active") & ~lost & again)
        if cycle < max_cycles:
            new = X.extract_or_raw(refine(F.col("accumulated_text"), F.col("critic_issues"), F.lit(cycle)))
            df = df.withColumn("accumulated_text", F.when(F.col("active"), new).otherwise(F.col("accumulated_text")))
            df = df.withColumns({
                "generation_history": F.when(F.col("active"), X.append_history(F.col("generation_history"), F.col("accumulated_text"))).otherwise(F.col("generation_history")),
                "reflect_iteration": F.col("reflect_iteration") + F.col("active").cast("int"),
            })
    return df.drop("judged", "active")


#: Errors of the program or of its data, and those of a client that has tried often enough, are not tried again.
_FINAL = (ArithmeticError, ImportError, LookupError, NameError, RuntimeError, SyntaxError, TypeError, ValueError, FileNotFoundError, PermissionError)
NODE_ATTEMPTS, NODE_WAIT = 3, 2.0


def attempted(node: Callable, sleep: Callable[[float], None]):
    """A step of the loop, tried again as a whole after 2 and 4 seconds when what failed may pass, such as a connection."""
    for attempt in range(NODE_ATTEMPTS):
        try:
            return node()
        except _FINAL:
            raise
        except Exception:
            if attempt == NODE_ATTEMPTS - 1:
                raise
            sleep(NODE_WAIT * 2**attempt)


def reflect(client: Client, image_b64: str, mime: str, system_prompt: str | None, max_cycles: int) -> dict:
    """One page's loop against a model; returns its final state."""
    def text_of(user: str) -> str:
        reply = attempted(lambda: client.invoke(image_b64, mime, system_prompt=system_prompt or X.SYSTEM_PROMPT, user_prompt=user), client.sleep)
        raw = ((reply or {}).get("content") or "").strip()
        return python_transcription(raw) or raw

    said = text_of(X.USER_PROMPT)
    state = {"accumulated_text": said, "iteration_count": 1, "generation_history": [said], "critic_score": 0, "critic_issues": [], "reflect_iteration": 0}
    while True:
        asked = f"The text to judge:```\n{state['accumulated_text']}\n```"
        reply = attempted(lambda: client.invoke(image_b64, mime, system_prompt=X.CRITIC_PROMPT, user_prompt=asked, schema="critic", temperature=0.1), client.sleep)
        judged = check_critic((reply or {}).get("parsed"))
        state |= {"critic_score": judged["score"], "critic_issues": judged["issues"]} if judged else {"critic_score": 0, "critic_issues": []}
        if not judged or judged["score"] >= 9 or not judged["issues"] or state["reflect_iteration"] >= max_cycles:
            return state
        issues = "\n".join(f"- {i}" for i in judged["issues"]) or X.NO_ISSUES
        said = text_of(X.REFINE_PROMPT.format(issues=issues, current_output=state["accumulated_text"]))
        state |= {"accumulated_text": said, "generation_history": [*state["generation_history"], said], "reflect_iteration": state["reflect_iteration"] + 1}


def check_critic(parsed) -> dict | None:
    """A critic's judgement with a score of 0 to 10, or nothing."""
    try:
        got = json.loads(parsed) if isinstance(parsed, str) else parsed
        score = got["score"]
    except (TypeError, KeyError, ValueError):
        return None
    if not isinstance(score, int) or isinstance(score, bool) or not 0 <= score <= 10:
        return None
    return {"score": score, "issues": [str(i) for i in got.get("issues") or []], "needs_revision": bool(got.get("needs_revision"))}


def run_loop(pages: DataFrame, transport, config: EngineConfig) -> DataFrame:
    """Adds the final state to rows that have image_b64 and mime_type; a page that fails has its error instead."""
    names = [f.name for f in pages.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(transport, config)

        def one(pair) -> dict:
            try:
                return reflect(client, *pair, config.system_prompt, config.max_reflect_cycles) | {"error": None}
            except Exception as failure:  # noqa: BLE001 - one page's failure leaves the others alone
                return {"accumulated_text": None, "iteration_count": None, "generation_history": None, "critic_score": None, "critic_issues": None, "reflect_iteration": None, "error": f"{type(failure).__name__}: {failure}"}

        for batch in batches:
            done = bounded(one, list(zip(batch.column("image_b64").to_pylist(), batch.column("mime_type").to_pylist())), config.max_concurrency)
            kinds = {"accumulated_text": pa.string(), "iteration_count": pa.int32(), "generation_history": pa.list_(pa.string()), "critic_score": pa.int32(), "critic_issues": pa.list_(pa.string()), "reflect_iteration": pa.int32(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([d[k] for d in done], t) for k, t in kinds.items()]], [*names, *kinds])

    from ..shared import ship

    ship(pages.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema] + [STATES])
    return pages.mapInArrow(run, schema)
