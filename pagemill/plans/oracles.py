"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

from ..functions import text as X

W = X.SPACE_RE2
TAG = "(?s)<transcription>(.*?)</transcription>"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def extract(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{TAG}') THEN {strip(f'regexp_extract({x}, {quoted(TAG)}, 1)')} ELSE {strip(x)} END"


REPLY = """CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'Here: <transcription>' || chr(10) || text || chr(10) || '</transcription> done'
WHEN 2 THEN '<transcription>' || text WHEN 3 THEN '<transcription> ' || text || ' </transcription><transcription>second</transcription>'
ELSE '<transcription>  </transcription>' END"""
MODE = "CASE doc_id % 3 WHEN 0 THEN 'ocr_engine' WHEN 1 THEN 'parse_with_vlm' ELSE 'parse_with_agent' END"
REPLIES = f"WITH r AS (SELECT doc_id, source, {MODE} AS mode, {REPLY} AS reply FROM documents), c AS (SELECT *, {strip('reply')} AS raw FROM r)"
SIZES = "SELECT *, CAST(300 + l_partkey % 4500 AS BIGINT) AS h, CAST(200 + (l_suppkey * 37 + l_orderkey) % 4300 AS BIGINT) AS w FROM lineitem"
SCORES = """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN -5 WHEN 3 THEN 85 WHEN 4 THEN -90 WHEN 5 THEN 90 WHEN 6 THEN -85 WHEN 7 THEN 176 ELSE 30 END AS DOUBLE) END AS angle,
CAST((event_id * 7) % 300 AS DOUBLE) / 100 AS cw, CAST((event_id * 11 + user_id) % 300 AS DOUBLE) / 100 AS ccw, CAST((event_id * 13 + user_id * 3) % 320 AS DOUBLE) / 100 AS original,
CAST(100 + user_id % 900 AS DOUBLE) AS h, CAST(100 + (event_id * 17) % 900 AS DOUBLE) AS w FROM events"""
RASTER = """WITH d AS (SELECT s_suppkey AS img, CAST(4 + (s_suppkey * 37) % 250 AS INT) AS h, CAST(8 + (s_suppkey * 13) % 33 AS INT) AS w FROM supplier),
px AS MATERIALIZED (SELECT img, y, x, CASE WHEN img % 11 = 0 THEN 255 WHEN img % 13 = 0 THEN 0
WHEN y % 4 < 2 AND NOT (y >= 20 AND y < 80 + img % 90) AND x >= img % 5 AND x < w - img % 7 THEN (x * 31 + y * 17 + img * 7) % 60
ELSE 200 + (x * 7 + y * 3 + img) % 40 END AS v FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM d)))"""


def otsu(px: str, out: str) -> str:
    return f"""{out}_q AS (SELECT img, v, CAST(sum(count(*)) OVER (PARTITION BY img ORDER BY v) AS DOUBLE) AS q, CAST(sum(count(*) * v) OVER (PARTITION BY img ORDER BY v) AS DOUBLE) AS c,
CAST(sum(count(*)) OVER (PARTITION BY img) AS DOUBLE) AS total, CAST(sum(count(*) * v) OVER (PARTITION BY img) AS DOUBLE) AS s FROM {px} GROUP BY img, v),
{out}_s AS (SELECT img, v, CASE WHEN q < total THEN (s * q - total * c) * (s * q - total * c) / (q * (total - q)) END AS spread FROM {out}_q),
{out}_r AS (SELECT img, v, spread, row_number() OVER (PARTITION BY img ORDER BY spread DESC NULLS LAST, v) AS place FROM {out}_s),
{out} AS (SELECT img, CASE WHEN spread > 0 THEN v ELSE 0 END AS threshold FROM {out}_r WHERE place = 1)"""


def ink(px: str, out: str) -> str:
    return f"{otsu(px, out + '_t')},\n{out} AS MATERIALIZED (SELECT p.* FROM {px} p JOIN {out}_t t ON t.img = p.img WHERE p.v <= t.threshold)"


def profiles(inked: str, dims: str, out: str) -> str:
    return f"""{out}_rows AS (SELECT a.img, a.y, coalesce(b.n, 0) AS n FROM (SELECT img, unnest(range(h)) AS y FROM {dims}) a LEFT JOIN (SELECT img, y, count(*) AS n FROM {inked} GROUP BY img, y) b ON a.img = b.img AND a.y = b.y),
{out}_columns AS (SELECT a.img, a.x, coalesce(b.n, 0) AS n FROM (SELECT img, unnest(range(w)) AS x FROM {dims}) a LEFT JOIN (SELECT img, x, count(*) AS n FROM {inked} GROUP BY img, x) b ON a.img = b.img AND a.x = b.x)"""


MASKED = "SELECT r.img, r.y, CASE WHEN trunc(h * 12.0 / 100) = 0 OR r.y >= h - trunc(h * 12.0 / 100) THEN 0 ELSE n END AS n FROM p_rows r JOIN d ON d.img = r.img"


def bounds(profile: str, at: str, other: str, ratio: str, dims: str) -> str:
    return f"SELECT p.img, min({at}) AS lo, max({at}) AS hi FROM {profile} p JOIN {dims} dd ON dd.img = p.img WHERE n > trunc(dd.{other} * CAST({ratio} AS DOUBLE)) GROUP BY p.img"


def blocks(rows: str) -> str:
    return f"""SELECT img, top, bottom, rows FROM (SELECT img, block, min(y) AS top, max(y) AS bottom, count(*) AS rows, row_number() OVER (PARTITION BY img ORDER BY count(*) DESC, block) AS place
FROM (SELECT img, y, sum(wide) OVER (PARTITION BY img ORDER BY y) AS block FROM (SELECT img, y, CASE WHEN y - lag(y) OVER (PARTITION BY img ORDER BY y) > 100 THEN 1 ELSE 0 END AS wide FROM {rows} WHERE n > 0)) GROUP BY img, block) WHERE place = 1"""


def guard(size: str, a: str, b: str) -> tuple[str, str]:
    percent = f"((CAST(1 AS DOUBLE) - CAST({b} - {a} AS DOUBLE) / {size}) * 100)"
    grow = f"CAST(trunc({size} * ({percent} - CAST(30 AS DOUBLE)) / 200) AS BIGINT)"
    return f"CASE WHEN {percent} > 30 THEN greatest(0, {a} - {grow}) ELSE {a} END", f"CASE WHEN {percent} > 30 THEN least({size}, {b} + {grow}) ELSE {b} END"


def _first_pass() -> str:
    (t, b), (le, r) = guard("h", "top", "bottom"), guard("w", "lo", "hi")
    return f"""{RASTER},
{ink('px', 'i')},
{profiles('i', 'd', 'p')},
m AS ({MASKED}),
tb AS ({bounds('m', 'y', 'w', '0.002', 'd')}),
lr AS ({bounds('p_columns', 'x', 'h', '0.01', 'd')}),
mb AS ({blocks('m')}),
f AS MATERIALIZED (SELECT d.img, d.h, d.w, mb.img IS NOT NULL AND tb.img IS NOT NULL AND lr.img IS NOT NULL AS cropped, top, bottom, lr.lo, lr.hi FROM d LEFT JOIN tb ON tb.img = d.img LEFT JOIN lr ON lr.img = d.img LEFT JOIN mb ON mb.img = d.img),
one AS MATERIALIZED (SELECT img, h, w, CAST(CASE WHEN cropped THEN greatest(0, ({t}) - 10) ELSE 0 END AS BIGINT) AS "top", CAST(CASE WHEN cropped THEN least(h, ({b}) + 10) ELSE h END AS BIGINT) AS bottom,
CAST(CASE WHEN cropped THEN greatest(0, ({le}) - 10) ELSE 0 END AS BIGINT) AS "left", CAST(CASE WHEN cropped THEN least(w, ({r}) + 10) ELSE w END AS BIGINT) AS "right", cropped FROM f)"""


def _crop_box() -> str:
    (a, b), (c, e) = guard("s.h", "tb2.lo", "tb2.hi"), guard("s.w", "lr2.lo", "lr2.hi")
    return f"""{_first_pass()},
s AS MATERIALIZED (SELECT img, bottom - "top" AS h, "right" - "left" AS w FROM one WHERE cropped AND bottom > "top" AND "right" > "left"),
px2 AS MATERIALIZED (SELECT px.img, px.y - o."top" AS y, px.x - o."left" AS x, v FROM px JOIN one o ON o.img = px.img JOIN s ON s.img = px.img WHERE px.y >= o."top" AND px.y < o.bottom AND px.x >= o."left" AND px.x < o."right"),
{ink('px2', 'i2')},
{profiles('i2', 's', 'p2')},
tb2 AS ({bounds('p2_rows', 'y', 'w', '0.002', 's')}),
lr2 AS ({bounds('p2_columns', 'x', 'h', '0.01', 's')}),
two AS (SELECT s.img, {a} AS a, {b} AS b, {c} AS c, {e} AS e FROM s JOIN tb2 ON tb2.img = s.img JOIN lr2 ON lr2.img = s.img)
SELECT one.img, CAST(coalesce("top" + a, "top") AS BIGINT) AS "top", CAST(coalesce("top" + b, bottom) AS BIGINT) AS bottom, CAST(coalesce("left" + c, "left") AS BIGINT) AS "left", CAST(coalesce("left" + e, "right") AS BIGINT) AS "right"
FROM one LEFT JOIN two ON two.img = one.img"""


INKED = f"{RASTER},\n{ink('px', 'i')},\n{profiles('i', 'd', 'p')}"
LYING = "CASE WHEN h / w < 0.85 THEN least((CAST(0.85 AS DOUBLE) - h / w) * 2, 1.0) ELSE 0.0 END"


def _rotation() -> str:
    def turn(bold: bool) -> tuple[str, str]:
        sure = "abs(a2) BETWEEN 85 AND 95" if bold else "false"
        agrees = "CASE WHEN a2 < 0 THEN ccw >= cw ELSE cw >= ccw END"
        towards = "CASE WHEN a2 < 0 THEN CASE WHEN ccw >= cw THEN -90 ELSE 90 END ELSE CASE WHEN cw >= ccw THEN 90 ELSE -90 END END"
        better = "CASE WHEN cw > ccw THEN 90 ELSE -90 END"
        to = f"CASE WHEN greatest(cw, ccw) - original > CAST(0.05 AS DOUBLE) THEN {better} WHEN {sure} THEN {towards} WHEN lying > 0.5 THEN {better} WHEN diff < CAST(0.15 AS DOUBLE) THEN 0 ELSE {better} END"
        conf = f"CASE WHEN greatest(cw, ccw) - original > CAST(0.05 AS DOUBLE) THEN least(diff + CAST(0.3 AS DOUBLE), 1.0) WHEN {sure} THEN CASE WHEN {agrees} THEN 0.7 ELSE 0.6 END WHEN lying > 0.5 THEN lying WHEN diff < CAST(0.15 AS DOUBLE) THEN 0.5 ELSE least(diff, 1.0) END"
        sideways = "CASE WHEN angle IS NULL THEN lying > 0 ELSE abs(angle) BETWEEN 85 AND 95 END"
        return f"CASE WHEN {sideways} THEN {to} WHEN abs(angle) > 175 THEN 180 ELSE 0 END", f"CAST(CASE WHEN {sideways} THEN {conf} ELSE 1.0 END AS DOUBLE)"

    (a, c), (ba, bc) = turn(False), turn(True)
    return f"""WITH e AS ({SCORES}), s AS (SELECT *, coalesce(angle, 90.0) AS a2, abs(cw - ccw) AS diff, CAST({LYING} AS DOUBLE) AS lying FROM e)
SELECT event_id, CAST({a} AS BIGINT) AS angle, {c} AS confidence, coalesce(angle, CAST(0 AS DOUBLE)) AS original_angle, ({a}) <> 0 AS applied_rotation, CAST({ba} AS BIGINT) AS bold_angle, {bc} AS bold_confidence FROM s"""


def critic(c: str) -> tuple[str, str, str]:
    """Whether the scripted critic's reply counts, its score and its number of issues."""
    return f"((doc_id + {c}) % 7 <> 0 AND (doc_id + {c}) % 11 <> 0)", f"((doc_id * 3 + {c} * 2) % 11)", "(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END)"


def _loop() -> str:
    ok, score, n = critic("c")
    again = f"({ok} AND {score} < 9 AND {n} > 0 AND k < 2)"
    raw = f"coalesce(nullif({extract('raw')}, ''), raw)"
    said = strip(f"'<transcription>' || text || ' +' || CAST({n} AS VARCHAR) || '</transcription>'")
    refined = f"coalesce(nullif({extract(said)}, ''), {said})"
    return f"""WITH RECURSIVE r AS (SELECT doc_id, {strip(REPLY)} AS raw FROM documents),
loop AS (SELECT doc_id, {raw} AS text, 1 AS generations, 0 AS k, 0 AS c, false AS over, CAST(0 AS BIGINT) AS score, 0 AS issues FROM r
UNION ALL SELECT doc_id, CASE WHEN {again} THEN {refined} ELSE text END, generations + CAST({again} AS INT), k + CAST({again} AS INT), c + 1, NOT {again},
CASE WHEN {ok} THEN {score} ELSE 0 END, CASE WHEN {ok} THEN {n} ELSE 0 END FROM loop WHERE NOT over)
SELECT doc_id, text AS accumulated_text, CAST(1 AS BIGINT) AS iteration_count, CAST(generations AS BIGINT) AS generations, score AS critic_score, CAST(issues AS BIGINT) AS issues, CAST(k AS BIGINT) AS reflect_iteration FROM loop WHERE over"""


_OK, _SCORE, _ISSUES = critic("0")
_HEAD, _REST = X.REFINE_PROMPT.split("{issues}")
_BETWEEN, _TAIL = _REST.split("{current_output}")
_WHOLE = "CAST(trunc({}) AS BIGINT)".format
_SCALE = {"resize": 1536, "analysis": 1500}


def _dims() -> str:
    def side(x: str, most: int, least: int) -> str:
        return f"CASE WHEN greatest(h, w) <= {most} THEN {x} ELSE greatest({least}, {_WHOLE(f'{x} * (CAST({most} AS DOUBLE) / greatest(h, w))')}) END"

    to = "CASE WHEN h < 800 THEN 800 WHEN h > 4000 THEN 4000 END"
    c, n = "CAST(0.9375 AS DOUBLE)", "CAST(0.3125 AS DOUBLE)"
    return f"""WITH s AS ({SIZES}) SELECT l_orderkey, l_linenumber, {side('h', 1536, 1)} AS resize_h, {side('w', 1536, 1)} AS resize_w, CAST(coalesce({to}, h) AS BIGINT) AS ocr_h,
CASE WHEN {to} IS NULL THEN w ELSE {_WHOLE(f'w * (CAST({to} AS DOUBLE) / h)')} END AS ocr_w, {side('h', 1500, 0)} AS analysis_h, {side('w', 1500, 0)} AS analysis_w,
{_WHOLE(f'h * {c} + w * {n}')} AS canvas_h, {_WHOLE(f'h * {n} + w * {c}')} AS canvas_w FROM s"""


_ASPECT = "CASE WHEN h / w > 1.1 THEN 1.0 WHEN h / w < 0.9 THEN 0.0 ELSE 0.5 END"
_GA, _GB = guard("h", "a", "b")
_CHANNELS = "SELECT img, y, x, v AS b, v * 7 // 8 AS g, (v * 3 + 20) // 4 AS r FROM px"
_PROMPT = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Read page ' || CAST(doc_id AS VARCHAR) END"
_BLANKED = "CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(9) || chr(10) || '\u2003' WHEN doc_id % 4 = 1 THEN '' ELSE text END"
_BALANCED = "CAST(CASE WHEN m{0} > 0 THEN least(floor({0} * (mid / m{0})), 255) ELSE {0} END AS BIGINT) AS {0}".format
_THIRDS = " , ".join(f"sum(CASE WHEN (CASE WHEN y < h // 3 THEN 0 WHEN y < (2 * h) // 3 THEN 1 ELSE 2 END) = {k} THEN 255 ELSE 0 END) AS s{k}" for k in range(3))
_EPS = "CAST(0.000001 AS DOUBLE)"
_DENSITY = [f"CAST(coalesce(s{k}, 0) AS DOUBLE) / ({size} + {_EPS})" for k, size in enumerate(("(h // 3) * w", "((2 * h) // 3 - h // 3) * w", "(h - (2 * h) // 3) * w"))]

ORACLES: dict[str, str] = {
    "page_contents": f"{REPLIES}, x AS (SELECT *, {extract('raw')} AS content FROM c) SELECT source || '.pdf' AS file_name, doc_id AS page_number, content, mode AS parsing_mode FROM x WHERE content <> '' OR mode = 'parse_with_vlm'",
    "transcription_extract": f"WITH r AS (SELECT doc_id, {REPLY} AS reply FROM documents) SELECT doc_id, {extract('reply')} AS content FROM r",
    "extract_modes": f"{REPLIES}, x AS (SELECT *, {extract('raw')} AS content FROM c) SELECT doc_id, content AS one_call, coalesce(nullif(content, ''), raw) AS loop FROM x",
    "identical_content": "SELECT md5(text) AS digest, count(*) AS pages, min(doc_id) AS first_page FROM documents GROUP BY 1",
    "page_plan": """WITH t AS (SELECT conv_id, count(*) AS total_pages FROM conversations GROUP BY conv_id),
r AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN total_pages + 1 ELSE 3 END AS a, CASE conv_id % 4 WHEN 2 THEN least(2, total_pages) ELSE total_pages END AS b FROM t)
SELECT conv_id, total_pages, unnest(range(a, b + 1)) AS page_number, CAST(NULL AS VARCHAR) AS error FROM r WHERE a <= total_pages
UNION ALL SELECT conv_id, total_pages, NULL, 'start_page=' || CAST(a AS VARCHAR) || ' exceeds total pages (' || CAST(total_pages AS VARCHAR) || ')' FROM r WHERE a > total_pages""",
    "drop_blank": f"WITH b AS (SELECT doc_id, {_BLANKED} AS content, {MODE} AS mode FROM documents) SELECT * FROM b WHERE {strip('content')} <> '' OR mode = 'parse_with_vlm'",
    "page_error_isolation": "SELECT doc_id, n_chars FROM documents WHERE doc_id % 17 <> 0",
    "metadata_precedence": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '.pdf' WHEN 1 THEN 'mine-' || CAST(doc_id AS VARCHAR) END AS file_name, CAST(length(lang) AS BIGINT) AS total_pages FROM documents",
    "page_order": "WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN NULL ELSE turn % 3 END AS page_number FROM conversations) SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(page_number, 0), turn) AS place FROM p",
    "markdown_text": """WITH p AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 = 3 THEN NULL ELSE turn + 1 END AS page_number FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(page_number, 0), turn) AS i FROM p)
SELECT conv_id, string_agg('<!-- page ' || CAST(coalesce(page_number, i) AS VARCHAR) || ' -->' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS markdown FROM n GROUP BY conv_id""",
    "json_content": f"""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN ' ' || props || ' ' WHEN 2 THEN '{{' || props ELSE event_type END AS t FROM events)
SELECT event_id, coalesce(regexp_matches({strip('t')}, '^[\\[{{]') AND json_valid(t), false) AS decoded FROM e""",
    "ocr_line_assembly": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
p AS (SELECT doc_id, place, {strip('t')} AS t, CASE WHEN place % 7 = 5 THEN 0 ELSE (place * 37 + doc_id) % 11 END AS top FROM l)
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY top, place) FILTER (t <> ''), '') AS content FROM p GROUP BY doc_id""",
    "mode_dispatch": """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ocr_engine' WHEN 1 THEN 'parse_with_vlm' ELSE 'parse_with_agent' END AS mode FROM events)
SELECT event_id, mode, CASE WHEN event_id % 2 = 0 AND mode = 'parse_with_agent' THEN 'agentic image' WHEN event_id % 7 = 0 AND mode <> 'parse_with_vlm' THEN 'schema without model' WHEN mode <> 'ocr_engine' AND event_id % 5 >= 3 THEN 'no client' ELSE 'run' END AS outcome FROM e""",
    "message_build": f"""WITH m AS (SELECT doc_id, text, {_PROMPT} AS p FROM documents)
SELECT doc_id, CASE WHEN coalesce(p, '') = '' THEN {quoted(X.SYSTEM_PROMPT)} ELSE p || chr(10) || chr(10) || {quoted(X.TAG_PROMPT)} END AS system_text, 'data:image/png;base64,' || md5(text) AS image_url, coalesce(nullif(p, ''), {quoted(X.USER_PROMPT)}) AS user_text FROM m""",
    "refine_prompts": f"""SELECT doc_id, {quoted(_HEAD)} || CASE doc_id % 3 WHEN 0 THEN {quoted(X.NO_ISSUES)} WHEN 1 THEN '- table {{cut}}' ELSE '- a' || chr(10) || '- b' END || {quoted(_BETWEEN)} || text || {quoted(_TAIL)} AS refine,
'The text to judge:```' || chr(10) || text || chr(10) || '```' AS critic FROM documents""",
    "retry_schedule": """SELECT event_id, CAST(i * (event_id % 3 + 1) AS DOUBLE) AS wait FROM (SELECT event_id, unnest(range(1, event_id % 5)) AS i FROM events)
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 < 2""",
    "file_names": """SELECT doc_id, 'p' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' ELSE '.md' END AS name,
'p' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 1 THEN '.tar' ELSE '' END AS stem, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.gz' WHEN 2 THEN '' ELSE '.md' END AS suffix FROM documents""",
    "page_dims": _dims(),
    "aspect": f"WITH s AS ({SIZES}) SELECT l_orderkey, l_linenumber, CAST({_ASPECT} AS DOUBLE) AS score, CAST({LYING} AS DOUBLE) AS lying FROM s",
    "rotation_decide": _rotation(),
    "orientation_total": f"WITH e AS ({SCORES}) SELECT event_id, cw * CAST(0.35 AS DOUBLE) + ccw * CAST(0.25 AS DOUBLE) + original * CAST(0.15 AS DOUBLE) + CAST({_ASPECT} AS DOUBLE) * CAST(0.25 AS DOUBLE) AS score FROM e",
    "line_angle": """WITH v AS (SELECT user_id AS img, (event_id * 7) % 180 AS theta, event_id % 40 AS rho, count(*) AS votes FROM events GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY votes DESC, theta, rho) AS place FROM v)
SELECT img, CAST(median(CASE WHEN theta - 90 > 90 THEN theta - 270 WHEN theta - 90 < -90 THEN theta + 90 ELSE theta - 90 END) AS DOUBLE) AS angle FROM t WHERE place <= 50 GROUP BY img""",
    "gray_pixels": f"{RASTER}, c AS ({_CHANNELS}) SELECT img, y, x, CAST((b * 1868 + g * 9617 + r * 4899 + 8192) // 16384 AS BIGINT) AS gray FROM c",
    "gray_histogram": f"{RASTER} SELECT img, v, count(*) AS n FROM px GROUP BY img, v",
    "otsu_threshold": f"{RASTER}, {otsu('px', 'o')} SELECT img, CAST(threshold AS BIGINT) AS threshold FROM o",
    "row_profile": f"{INKED}, m AS ({MASKED}) SELECT r.img, CAST(r.y AS BIGINT) AS y, r.n, CAST(m.n AS BIGINT) AS masked FROM p_rows r JOIN m ON m.img = r.img AND m.y = r.y",
    "column_profile": f"{INKED} SELECT img, x, n FROM p_columns",
    "profile_bounds": f"{INKED}, b AS ({bounds('p_rows', 'y', 'w', '0.002', 'd')}) SELECT img, lo AS first, hi AS last FROM b",
    "main_block": f"{INKED} {blocks('p_rows')}",
    "crop_guard": f"WITH s AS (SELECT *, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity * 5 + 20 AS BIGINT) AS b FROM ({SIZES})) SELECT l_orderkey, l_linenumber, {_GA} AS first, {_GB} AS last FROM s",
    "crop_first_pass": f"{_first_pass()} SELECT img, \"top\", bottom, \"left\", \"right\", cropped FROM one",
    "crop_box": _crop_box(),
    "kernel_crop_box": _crop_box(),
    "kernel_otsu": f"{RASTER}, {otsu('px', 'o')} SELECT img, CAST(threshold AS BIGINT) AS threshold FROM o",
    "top_heavy": f"{INKED}, t AS (SELECT i.img, {_THIRDS} FROM i JOIN d ON d.img = i.img GROUP BY i.img) SELECT d.img, least(({_DENSITY[0]} + {_DENSITY[1]} * 0.5) / ({_DENSITY[2]} + {_EPS}), 5.0) AS score FROM d LEFT JOIN t ON t.img = d.img",
    "row_variance": f"{INKED} SELECT img, round(var_pop(n * 255), 6) AS variance FROM p_rows GROUP BY img",
    "quarter_turn": f"""{RASTER}, q AS (SELECT px.*, h, w FROM px JOIN d ON d.img = px.img)
SELECT img, CAST(x AS BIGINT) AS y, CAST(h - 1 - y AS BIGINT) AS x, v, CAST(90 AS BIGINT) AS angle FROM q UNION ALL SELECT img, w - 1 - x, y, v, -90 FROM q UNION ALL SELECT img, h - 1 - y, w - 1 - x, v, 180 FROM q""",
    "white_balance": f"""{RASTER}, c AS ({_CHANNELS}), m AS (SELECT img, CAST(sum(b) AS DOUBLE) / count(*) AS mb, CAST(sum(g) AS DOUBLE) / count(*) AS mg, CAST(sum(r) AS DOUBLE) / count(*) AS mr FROM c GROUP BY img),
j AS (SELECT c.*, mb, mg, mr, (mb + mg + mr) / 3 AS mid FROM c JOIN m ON m.img = c.img) SELECT img, y, x, {_BALANCED('b')}, {_BALANCED('g')}, {_BALANCED('r')} FROM j""",
    "padded": f"""{RASTER}, f AS (SELECT img, h, w, y, unnest(range(w + 32)) AS x FROM (SELECT *, unnest(range(h + 32)) AS y FROM d))
SELECT f.img, f.y, f.x, CAST(coalesce(px.v, 255) AS BIGINT) AS v FROM f LEFT JOIN px ON px.img = f.img AND px.y = f.y - 16 AND px.x = f.x - 16""",
    "reflect_route": "SELECT event_id, CASE WHEN event_id % 11 < 9 AND event_id % 3 <> 0 AND user_id % 4 < 2 THEN 'refine' ELSE 'complete' END AS goto FROM events",
    "critic_parse": f"""SELECT doc_id, CASE WHEN {_OK} THEN {_SCORE} END AS score, CAST(CASE WHEN {_OK} THEN {_ISSUES} END AS BIGINT) AS issues, CASE WHEN {_OK} AND {_ISSUES} > 0 THEN 'row 0 is cut' END AS first_issue, CASE WHEN {_OK} THEN true END AS needs_revision FROM documents""",
    "reflect_loop": _loop(),
}
# The kernels have the SQL of the relational forms that they must agree with.
ORACLES["kernel_turns"] = ORACLES["quarter_turn"]
