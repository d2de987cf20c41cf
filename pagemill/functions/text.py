"""Column expressions over texts: model replies, ids, prompts, names, JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it; SQL's trim takes blanks only.
_SPACES = (("0009", "000d"), ("001c", "0020"), ("0085", ""), ("00a0", ""), ("1680", ""), ("2000", "200a"), ("2028", "2029"), ("202f", ""), ("205f", ""), ("3000", ""))
SPACES = "".join(chr(c) for a, b in _SPACES for c in range(int(a, 16), int(b or a, 16) + 1))
SPACE_RE2 = "[" + "".join(rf"\x{{{a}}}" + (rf"-\x{{{b}}}" if b else "") for a, b in _SPACES) + "]"
TAGGED = r"(?s)<transcription>(.*?)</transcription>"
SYSTEM_PROMPT = """You turn the image of a page into Markdown.
Write down exactly what is there, in reading order, the left column before the right one. Put [UNCLEAR] where you can't read it.
Tables become pipe tables with the same number of columns in every row; repeat a merged cell's text. Use at most three levels of headings.
Name charts, pictures and logos in one sentence inside <chart>, <image_desc> or <logo>.
Leave out page numbers, running heads and feet, and watermarks."""
USER_PROMPT = "Give the text of this page and nothing else, inside one transcription block."
TAG_PROMPT = "Put the whole result between <transcription> and </transcription>."
CRITIC_PROMPT = """You look only at the structure of a page's Markdown: tables that break off, wrong reading order, text that stops short, passages that come twice or loop.
Answer with JSON: score (0 to 10; 8 and more is good), issues (a list of short texts) and needs_revision (true or false)."""
REFINE_PROMPT = """Mend the text below. Change only what the list names.
Issues:
{issues}
Text:
{current_output}
Give the full mended text between <transcription> and </transcription>."""
NO_ISSUES = "- General repair of the structure"


def strip(text: Column | str) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(SPACES))


def extract_transcription(reply: Column | str) -> Column:
    """The body of the first tag pair, or the whole reply where there is no full pair; stripped."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    return F.when(reply.rlike(TAGGED), strip(F.regexp_extract(reply, TAGGED, 1))).otherwise(strip(reply))


def response_text(content: Column | str) -> Column:
    return F.coalesce(strip(content), F.lit(""))


def extract_or_empty(reply: Column) -> Column:
    """What the one-call mode takes from a reply."""
    return F.coalesce(extract_transcription(response_text(reply)), F.lit(""))


def extract_or_raw(reply: Column) -> Column:
    """What the reflect loop takes: an empty pair gives the reply itself."""
    raw = response_text(reply)
    return F.coalesce(F.nullif(extract_transcription(raw), F.lit("")), raw)


@F.pandas_udf(StringType())
def _sha3(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha3_256(t.encode("utf-8", "surrogatepass")).hexdigest())


def content_id(content: Column | str) -> Column:
    """SHA3-256 of the text, null as ''. Spark has no SHA3 of its own, so this one is Arrow-batched Python."""
    return _sha3(F.coalesce(content, F.lit("")))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def file_stem(path: Column | str) -> Column:
    """The name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*[^.]$", "")


def file_suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=[^.])(\.[^.]+)$", 1))


def is_json(content: Column | str) -> Column:
    """Whether a text looks like a JSON object or array and is one."""
    content = F.col(content) if isinstance(content, str) else content
    return F.coalesce(strip(content).rlike(r"^[\[{]") & F.try_parse_json(content).isNotNull(), F.lit(False))


def issue_list(issues: Column) -> Column:
    lines = F.array_join(F.transform(issues, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.coalesce(F.nullif(lines, F.lit("")), F.lit(NO_ISSUES))


def refine_prompt(issues: Column, text: Column) -> Column:
    head, rest = REFINE_PROMPT.split("{issues}")
    between, tail = rest.split("{current_output}")
    return F.concat(F.lit(head), issue_list(issues), F.lit(between), F.coalesce(text, F.lit("")), F.lit(tail))


def critic_prompt(text: Column) -> Column:
    return F.concat(F.lit("The text to judge:```\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))


def append_history(history: Column, text: Column) -> Column:
    return F.concat(history, F.array(text))


def retry_waits(retries: Column, delay: Column) -> Column:
    """Seconds to wait after each failed attempt but the last."""
    return F.when(retries < 2, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(retries - 1, F.lit(1))), lambda i: (i * delay).cast("double")))


def data_url(mime: Column, b64: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), b64)


def system_message(prompt: Column | None, structured: bool = False) -> Column:
    """The system prompt as it is sent. A structured call takes the caller's own as it stands, and there must be one."""
    if structured:
        if prompt is None:
            raise ValueError("a structured call needs a system prompt of its own")
        return prompt
    if prompt is None:
        return F.lit(SYSTEM_PROMPT)
    return F.when(F.coalesce(F.length(prompt), F.lit(0)) == 0, F.lit(SYSTEM_PROMPT)).otherwise(F.concat(prompt, F.lit(f"\n\n{TAG_PROMPT}")))


def build_message(b64: Column, mime: Column, system_prompt: Column | None = None, user_prompt: Column | None = None, structured: bool = False) -> Column:
    """The messages of one call as an array of (role, image url, text)."""
    user = F.lit(USER_PROMPT) if user_prompt is None else F.coalesce(F.nullif(user_prompt, F.lit("")), F.lit(USER_PROMPT))
    part = lambda role, url, text: F.struct(F.lit(role).alias("role"), url.alias("image_url"), text.alias("text"))
    return F.array(part("system", F.lit(None).cast("string"), system_message(system_prompt, structured)), part("user", data_url(mime, b64), user))


def parse_critic(raw: Column | str) -> Column:
    """A critic's JSON as a struct; null where it isn't one or the score lies outside 0 to 10."""
    c = F.from_json(raw, "score int, issues array<string>, needs_revision boolean")
    ok = c["score"].between(0, 10)
    issues = F.coalesce(c["issues"], F.array().cast("array<string>"))
    return F.when(ok, F.struct(c["score"].alias("score"), issues.alias("issues"), F.coalesce(c["needs_revision"], F.lit(False)).alias("needs_revision")))


def as_json(value) -> str:
    """JSON as the single-file sink writes it."""
    return json.dumps(value, indent=2, ensure_ascii=False)
