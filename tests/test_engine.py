import base64
import json
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill import api, schemas
from pagemill.config import EngineConfig, ParsingMode, check_request
from pagemill.functions import kernels as K
from pagemill.functions import text as X
from pagemill.operators.model import Client, messages, python_transcription
from pagemill.operators.reflect import attempted, check_critic, reflect
from pagemill.sources import pdf, recognizer, sinks


class Script:
    """Answers from a list, and keeps what it was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def __call__(self, request):
        self.asked.append(request)
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return {"content": reply} if isinstance(reply, str) else {"content": None, "parsed": reply}


def critic(score, *issues):
    return {"score": score, "issues": list(issues), "needs_revision": bool(issues)}


@pytest.mark.parametrize(
    "reply, body",
    [("a <transcription> x </transcription> b", "x"), ("<transcription>a\nb</transcription>", "a\nb"), (" none ", "none"), ("<transcription x", "<transcription x"), ("<transcription>open", "<transcription>open"), ("<transcription>  </transcription>", ""), ("<transcription>1</transcription><transcription>2</transcription>", "1")],
)
def test_extraction(spark, reply, body):
    assert python_transcription(reply) == body
    assert spark.createDataFrame([(reply,)], "r string").select(X.extract_transcription("r")).first()[0] == body


def test_strip_equals_python(spark):
    texts = ["".join(chr(c) for c in range(a, a + 40)) + "x y" + chr(a) for a in (0, 20, 130, 155, 5750, 8180, 8220, 8270, 12280)] + ["", " 　"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip("t")).collect()]
    assert got == [t.strip() for t in texts]


def test_content_ids(spark):
    import hashlib

    rows = spark.createDataFrame([("",), (None,), ("Straße\n",)], "t string").select("t", X.content_id("t")).collect()
    assert all(i == hashlib.sha3_256((t or "").encode()).hexdigest() for t, i in rows)


@pytest.mark.parametrize("replies, calls, cycles", [(["t", critic(9)], 2, 0), (["t", critic(6, "cut"), "u", critic(10)], 4, 1), (["t", *[critic(5, "x"), "u"] * 2, critic(5, "x")], 6, 2), (["t", critic(3)], 2, 0), (["t", None], 2, 0), (["t", critic(11, "x")], 2, 0)])
def test_reflect_calls(replies, calls, cycles):
    model = Script(*replies)
    state = reflect(Client(model, EngineConfig(max_retries=1)), "b64", "image/png", None, 2)
    assert (len(model.asked), state["reflect_iteration"], len(state["generation_history"])) == (calls, cycles, cycles + 1)
    assert model.asked[1]["temperature"] == 0.1 and model.asked[1]["schema"] == "critic"


def test_empty_pair_gives_the_reply_in_the_loop():
    state = reflect(Client(Script("<transcription> </transcription>", critic(10)), EngineConfig()), "", "image/png", None, 2)
    assert state["accumulated_text"] == "<transcription> </transcription>"


def test_retries_wait_longer_each_time():
    waits = []
    client = Client(Script(ValueError("a"), ValueError("b"), "ok"), EngineConfig(), waits.append)
    assert client.invoke("", "")["content"] == "ok" and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        Client(Script(*[ValueError("x")] * 3), EngineConfig(), waits.append).invoke("", "")
    assert Client(Script(), EngineConfig(max_retries=0)).invoke("", "") is None


def test_messages():
    assert messages("B", "image/png")[0]["content"] == X.SYSTEM_PROMPT
    assert messages("B", "image/png", "mine")[0]["content"] == f"mine\n\n{X.TAG_PROMPT}"
    assert messages("B", "image/png", "mine", schema={})[0]["content"] == "mine"
    assert messages("B", "image/png")[1]["content"][0]["image_url"]["url"] == "data:image/png;base64,B"
    with pytest.raises(ValueError):
        messages("B", "image/png", schema={})


def test_critic_bounds():
    assert check_critic('{"score": 7, "issues": ["a"]}')["issues"] == ["a"]
    assert all(check_critic(x) is None for x in ('{"score": 11}', '{"score": -1}', '{"score": true}', "x", None, "{}"))


def test_guards(tmp_path):
    for args in ((ParsingMode.AGENTIC, True, None, "image"), (ParsingMode.BASIC_OCR, True, dict, "image"), (ParsingMode.VLM, False, None, "image")):
        with pytest.raises(ValueError):
            check_request(*args)
    with pytest.raises(FileNotFoundError):
        check_request(ParsingMode.VLM, False, None, "pdf", str(tmp_path / "none.pdf"))
    with pytest.raises(ValueError):
        EngineConfig(ocr_language="klingon")
    with pytest.warns(UserWarning):
        EngineConfig(max_reflect_cycles=3)
    assert not EngineConfig(base_url="x", model_name="y").has_client


def decode_png(raw):
    at, data = 8, b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack(">2I2B", body[:10])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    c = {0: 1, 2: 3, 6: 4}[colour]
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)[:, 1:].reshape(h, w, c)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([0, 3, 4]), st.integers(0, 9))
def test_png_round_trip(h, w, channels, seed):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, channels) if channels else (h, w), dtype=np.uint8)
    back = decode_png(K.encode_png(x))
    want = x[..., None] if x.ndim == 2 else x[..., [2, 1, 0, 3][:channels]]
    assert (back == want).all()


def test_encoding_kinds():
    x = np.zeros((4, 5, 3), np.uint8)
    b64, mime = K.encode_base64(x)
    assert mime == "image/png" and base64.b64decode(b64).startswith(b"\x89PNG") and "\n" not in b64
    with pytest.raises(ValueError):
        K.encode_base64(x, "BMP")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=300))
def test_otsu_by_definition(values):
    g = np.array([values], np.uint8)
    best, at = 0, 0
    for t in sorted(set(values)):
        a, b = g[g <= t].astype(float), g[g > t].astype(float)
        if len(b) and (v := len(a) * len(b) * (a.mean() - b.mean()) ** 2) > best * (1 + 1e-9):
            best, at = v, t
    assert abs(K.otsu(g) - at) == 0 or math.isclose(_between(g, K.otsu(g)), best, rel_tol=1e-9)


def _between(g, t):
    a, b = g[g <= t].astype(float), g[g > t].astype(float)
    return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(b) else 0


def page(h=700, w=500):
    rng = np.random.default_rng(3)
    x = np.full((h, w, 3), 255, np.uint8)
    for y in range(60, h - 150, 24):
        x[y : y + 10, 60 : w - int(rng.integers(60, 160))] = 20
    return x


def test_blank_images_stay():
    for shape in ((200, 150, 3), (100, 100, 3)):
        x = np.zeros(shape, np.uint8)
        assert not K.detect_rotation(x)["applied_rotation"] and K.preprocess_for_ocr(x).dtype == np.uint8
    assert K.apply_rotation(np.zeros((100, 200, 3), np.uint8), 90).shape == (200, 100, 3)
    assert K.adaptive_resize(np.zeros((200, 200, 3), np.uint8), 50).shape == (50, 50, 3)


def test_rotations_undo_each_other():
    x = page()
    assert (K.apply_rotation(K.apply_rotation(x, 90), -90) == x).all() and (K.apply_rotation(x, 90)[0] == x[::-1, 0]).all()


def test_skew_is_found_and_undone():
    for angle in (-3.0, 2.0):
        assert K.skew_angle(K.rotate_for_deskew(page(), angle), "paper") == pytest.approx(-angle, abs=0.5)


def test_sideways_page_is_detected():
    found = K.detect_rotation(K.apply_rotation(page(1000, 700), 90), EngineConfig(use_aspect_fallback=True))
    assert abs(found["angle"]) == 90 and abs(abs(found["original_angle"]) - 90) < 1


def test_components_by_flood():
    m = np.random.default_rng(5).random((30, 40)) < 0.4
    for diagonal in (True, False):
        row, first, last, label, n = K.components(m, diagonal)
        seen, count = np.zeros_like(m), 0
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
        for y, x in zip(*np.nonzero(m)):
            if not seen[y, x]:
                count += 1
                todo = [(y, x)]
                while todo:
                    p = todo.pop()
                    if 0 <= p[0] < 30 and 0 <= p[1] < 40 and m[p] and not seen[p]:
                        seen[p] = True
                        todo += [(p[0] + a, p[1] + b) for a, b in steps]
        assert int(n) == count


def test_resize_keeps_flat_images_and_means():
    flat = np.full((31, 47, 3), 90, np.uint8)
    for kind in ("area", "cubic", "lanczos", "linear"):
        assert (K.resize(flat, 20, 60, kind) == 90).all()
    x = np.random.default_rng(0).integers(0, 256, (40, 40), dtype=np.uint8)
    assert (K.resize(x, 20, 20, "area") == np.rint(x.reshape(20, 2, 20, 2).mean((1, 3)))).mean() > 0.95


def test_simple_kernels():
    x = page()
    assert K.pad(x).shape == (732, 532, 3) and (K.unsharp(np.full((20, 20, 3), 7, np.uint8)) == 7).all()
    assert K.rotate_arbitrary(x, 90).shape[:2] in ((500, 700), (499, 699), (500, 699), (499, 700))
    mid = x // 4 + 20
    assert np.ptp(K.white_balance(np.dstack([mid[..., 0], mid[..., 1] // 2, mid[..., 2]])).mean((0, 1))) < 2
    assert np.abs(K.from_lab(K.to_lab(x)).astype(int) - x).max() <= 2
    assert K.crop_box(x)[2] >= 50


PDF = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >> endobj\n3 0 obj << /Type /Page >> endobj\n4 0 obj << /Type /Page >> endobj\ntrailer << /Root 1 0 R >>"


def test_pdf_pages(spark, tmp_path):
    packed = zlib.compress(b"1 0 2 35 << /Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Count 7 >>")
    assert pdf.page_count(PDF) == 2 and pdf.page_count(b"x") is None and pdf.page_count(None) is None
    stream = b"%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj"
    assert pdf.page_count(stream) == 7
    (tmp_path / "a.pdf").write_bytes(PDF)
    (tmp_path / "b.pdf").write_bytes(b"no")
    render = lambda content, page, zoom: np.full((10, 10, 3), page, np.uint8)
    model = lambda request: {"content": "<transcription>text</transcription>"}
    out = api.parse_pdfs(spark, str(tmp_path), ParsingMode.VLM, EngineConfig(), renderer=render, transport=model, metadata={"year": 2024, "file_name": None}).collect()
    assert [(r.content, r.metadata.page_number, r.metadata.total_pages, r.metadata.file_name) for r in out] == [("text", 1, 2, None), ("text", 2, 2, None)]
    assert json.loads(out[0].metadata.user_meta) == {"year": 2024}
    assert api.parse_pdfs(spark, str(tmp_path), ParsingMode.VLM, EngineConfig(), 2, renderer=render, transport=model).count() == 1


def test_images_to_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(K.encode_png(page(60, 40)))
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    build = lambda: lambda x: [([[0, 9]], " low ", 1.0), ([[0, 2]], "high", 1.0), (None, "", 1.0)]
    out = api.parse_images(spark, str(tmp_path / "in"), build_recognizer=build).collect()
    assert [(r.content, r.metadata.file_name, r.metadata.parsing_mode) for r in out] == [("high\nlow", "a.png", "ocr_engine")]


def test_two_recognisers_in_one_worker(spark):
    image = [{"origin": "x", "height": 40, "width": 30, "nChannels": 3, "mode": 16, "data": bytearray(page(40, 30).tobytes())}]
    one = spark.createDataFrame([(image[0],)], schemas.T.StructType([schemas.T.StructField("image", schemas.IMAGE)]))
    for said in ("first", "second", "first"):
        build = lambda said=said: lambda x: [([[0, 1]], said, 1.0)]
        assert [r.content for r in api.parse_images(spark, one, build_recognizer=build).collect()] == [said]


def test_missing_models_are_told(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        api.parse_images(spark, str(tmp_path), config=EngineConfig(ocr_model_dir=str(tmp_path / "none")))


def test_every_page_is_called_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    (tmp_path / "in").mkdir()
    many = PDF.replace(b"/Count 2", b"/Count 37")
    (tmp_path / "in" / "a.pdf").write_bytes(many)
    (tmp_path / "in" / "b.pdf").write_bytes(PDF)

    def model(request):
        import uuid

        (calls / uuid.uuid4().hex).write_text("")
        return {"content": "text"}

    def render(content, number, zoom):
        if number == 3 and b"37" in content:
            raise ValueError("torn")
        return np.full((10, 10, 3), number, np.uint8)

    seen = []
    with pytest.warns(UserWarning, match="1 pages failed: .*a.pdf page 3: ValueError: torn"):
        out = api.parse_pdfs(spark, str(tmp_path / "in"), ParsingMode.VLM, EngineConfig(debug_dir=str(tmp_path / "debug")), renderer=render, transport=model, progress=seen.append)
    assert len(out.collect()) == 38 and out.count() == 38
    assert json.loads(sinks.save(out, str(tmp_path / "out.json")).read_text())[0]["metadata"]["page_number"] == 1
    assert len(list(calls.iterdir())) == 38 and seen[-1] == 39
    assert len(list((tmp_path / "debug").glob("*_vlm_p*_0.png"))) == 38


def test_steps_of_the_loop_are_tried_again():
    waits = []
    flaky = iter([ConnectionResetError("a"), BrokenPipeError("b"), "done"])

    def node():
        x = next(flaky)
        if isinstance(x, Exception):
            raise x
        return x

    assert attempted(node, waits.append) == "done" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        attempted(lambda: int("x"), waits.append)
    assert len(waits) == 2


def test_default_recogniser_reads_lines():
    from pagemill.sources import onnx_backend as B

    chance = np.zeros((64, 96), np.float32)
    chance[10:20, 8:80], chance[40:50, 8:60], chance[60:62, 1:3] = 0.9, 0.8, 0.9
    assert [(a < 10 and b > 20, c < 8) for a, b, c, _ in B.boxes(chance)] == [(True, True), (False, True)]
    text = np.eye(4)[[0, 1, 1, 0, 1, 2, 3]]
    assert B.read(text, ["", "a", "b", " "]) == ("aab ", 1.0) and B.read(np.eye(2)[[0, 0]], ["", "a"]) == ("", 0.0)
    got = B.recognize(np.zeros((64, 96, 3), np.uint8), lambda x: chance[None, None], lambda x: text[None], ["", "a", "b", " "])
    assert [t for _, t, _ in got] == ["aab ", "aab "] and recognizer.assemble(got) == "aab\naab"


def records(spark, rows):
    return spark.createDataFrame([("i", c, (f"f{p}", 2, p, None, "m", None, None, None, None)) for p, c in rows], schemas.RECORD)


def test_sinks_byte_by_byte(spark, tmp_path):
    to = sinks.save(records(spark, [(2, "zwei ü"), (1, '{"a": [1]}')]), str(tmp_path / "d" / "x.json"))
    want = [{"id": "i", "content": c, "metadata": {"file_name": f"f{p}", "total_pages": 2, "page_number": p, "parsing_mode": "m"}} for p, c in ((1, {"a": [1]}), (2, "zwei ü"))]
    assert to.read_text() == json.dumps(want, indent=2, ensure_ascii=False)
    assert sinks.save(records(spark, [(1, '{"a": 1}')]), str(tmp_path / "one")).read_text() == '{\n  "a": 1\n}'
    assert sinks.save(records(spark, [(2, "b"), (1, "a")]), str(tmp_path / "x.md")).read_text() == "<!-- page 1 -->\na\n\n---\n\n<!-- page 2 -->\nb"
    with pytest.warns(UserWarning):
        assert sinks.save(records(spark, [(1, "a")]).limit(0), str(tmp_path / "no.json")) is None


def test_models_and_lines(tmp_path):
    with pytest.raises(FileNotFoundError):
        recognizer.ensure_models(EngineConfig(ocr_model_dir=str(tmp_path)))
    assert recognizer.assemble(None) == "" and not sinks.clear_model_cache(tmp_path)


def test_schema_of_models():
    from dataclasses import dataclass

    @dataclass
    class Item:
        name: str
        price: float | None

    assert schemas.struct_of(Item).simpleString() == "struct<name:string,price:double>" and schemas.struct_of(Item)["price"].nullable


def test_stream_of_replies(spark, tmp_path):
    from pagemill.streaming.ingest import stream_replies

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, explode(array('<transcription>a</transcription>', 'a', 'b', ' ')) AS reply").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, reply string").parquet(str(tmp_path / "in"))
    q = stream_replies(source).writeStream.format("memory").queryName("replies").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.content for r in spark.table("replies").collect()) == ["a", "b"]
