import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from pagemill.config import EngineConfig, ParsingMode
from pagemill.functions import kernels
from pagemill.operators import pixels as PX
from pagemill.operators.stage import run_stage
from pagemill.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["column_profile", "crop_box", "crop_first_pass", "main_block", "profile_bounds", "row_profile", "row_variance", "top_heavy", "white_balance", "quarter_turn"])
def test_no_join_of_pixels_goes_through_the_driver(spark, monkeypatch, name):
    plans, stored = [], PX.stored
    monkeypatch.setattr(PX, "stored", lambda df, to: plans.append(plan(df)) or stored(df, to))
    plans.append(plan(catalogue.queries()[name](spark, SF)))
    assert any("Generate" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("name", ["gray_histogram", "otsu_threshold"])
def test_rasters_are_as_many_tasks_as_their_pixels_need(spark, monkeypatch, name):
    area = catalogue._dims(spark, SF).selectExpr("sum(h * w)").first()[0]
    monkeypatch.setattr(catalogue, "TASK_PIXELS", area // 20, raising=False)
    assert catalogue.queries()[name](spark, SF).rdd.getNumPartitions() >= 20


def test_drawn_rasters_are_those_of_the_expression(spark):
    sizes = [(0, 4, 8), (7, 9, 12), (11, 5, 8), (13, 6, 9), (359_999, 120, 40)]
    dims = spark.createDataFrame(sizes, "img bigint, h int, w int")
    px = dims.selectExpr("img", "h", "w", "explode(sequence(0, h - 1)) AS y").selectExpr("img", "w", "y", "explode(sequence(0, w - 1)) AS x")
    want = {(r.img, r.y, r.x): r.v for r in px.selectExpr("img", "y", "x", f"{catalogue.PIXEL} AS v").collect()}
    got = {(i, y, x): int(v) for i, h, w in sizes for (y, x), v in np.ndenumerate(catalogue.drawn(i, h, w))}
    assert got == want


@pytest.mark.parametrize("name", ["kernel_scores", "kernel_turns", "page_agentic", "page_basic_ocr"])
def test_images_are_drawn_once_and_no_pixel_is_shuffled(spark, name):
    p = plan(catalogue.queries()[name](spark, SF))
    assert p.count("MapInArrow") == 2 and p.count("Exchange") == 1 and "collect_list" not in p


def test_a_task_recognises_one_page_at_a_time(spark):
    def build():
        busy = []

        def read(image):
            busy.append(1)
            time.sleep(0.05)
            most = len(busy)
            busy.pop()
            return [([[0, 0]], f"{most} at once", 1.0)]

        return read

    pages = catalogue._images(spark, SF).limit(6).coalesce(1)
    out = run_stage(pages, ParsingMode.BASIC_OCR, EngineConfig(max_concurrency=6, enable_deskew=False, enable_rotate=False), None, build)
    assert {r.content for r in out.select("content").collect()} == {"1 at once"}


def test_row_sums_of_turned_masks():
    rng = np.random.default_rng(3)
    for h, w in ((1, 5), (40, 31), (300, 200)):
        mask = np.where(rng.random((h, w)) < 0.4, 255, 0).astype(np.uint8)
        angles = np.arange(-5, 5.25, 0.5)
        for fill in (0, 255):
            for a, sums in zip(angles, kernels._turned_row_sums(mask, angles, fill)):
                assert (kernels.rotate_for_deskew(mask, a, fill).sum(1, dtype=np.int64) == sums).all()


def test_large_pages_need_little_besides_themselves():
    page = np.full((800, 6000, 3), 200, np.uint8)
    tracemalloc.start()
    kernels.enhance_contrast(page)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15 * page.nbytes
