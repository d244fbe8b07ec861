"""Pixel kernels by brute force, and frames from pixels to the gate."""

from __future__ import annotations

import numpy as np
import pytest

from subloom.functions import pixels as P
from subloom.operators import candidates as C


def places(mask):
    return {(y, x) for y, x in zip(*np.nonzero(mask), strict=True)}


def flooded(mask):
    """Components by flood fill."""
    left, out = places(mask), []
    for first in sorted(left):
        if first not in left:
            continue
        todo, seen = [first], {first}
        while todo:
            y, x = todo.pop()
            for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left and q not in seen:
                    seen.add(q)
                    todo.append(q)
        left -= seen
        ys, xs = [y for y, _ in seen], [x for _, x in seen]
        out.append([min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)])
    return out


def slid(mask, size, take):
    """One window a place."""
    h, w = mask.shape
    return np.array([[take(mask[y + b, x + a] for a in range(-(size[0] // 2), size[0] - size[0] // 2) for b in range(-(size[1] // 2), size[1] - size[1] // 2) if 0 <= x + a < w and 0 <= y + b < h) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("share", [0.0, 0.15, 0.45, 0.6, 0.95, 1.0])
def test_components(share):
    rng = np.random.default_rng(int(share * 100))
    for h, w in ((1, 1), (1, 40), (40, 1), (13, 17), (40, 60)):
        mask = rng.random((h, w)) < share
        assert P.components(mask).tolist() == flooded(mask)


def test_components_of_a_spiral_and_a_comb():
    spiral = np.zeros((41, 41), bool)
    y, x, step, n = 20, 20, 0, 2
    while n < 40:
        for _ in range(2):
            for _ in range(n):
                spiral[y, x] = True
                y, x = y + (0, 1, 0, -1)[step % 4], x + (1, 0, -1, 0)[step % 4]
                if not (0 <= y < 41 and 0 <= x < 41):
                    break
            step += 1
            if not (0 <= y < 41 and 0 <= x < 41):
                n = 99
                break
        n += 2
    assert P.components(spiral).tolist() == flooded(spiral)
    comb = np.zeros((500, 801), bool)
    comb[:, ::2] = True
    comb[-1] = True
    assert P.components(comb).tolist() == [[0, 0, 801, 500, 500 * 401 + 400]]


@pytest.mark.parametrize("size", [(9, 3), (2, 2), (1, 1), (3, 1), (4, 5)])
def test_closing_and_opening(size):
    rng = np.random.default_rng(7)
    for h, w in ((1, 1), (2, 5), (12, 19)):
        m = rng.random((h, w)) < 0.4
        assert (P.closed(m, size) == slid(slid(m, size, max), size, min)).all()
        assert (P.opened(m, size) == slid(slid(m, size, min), size, max)).all()


def test_area_resize():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, (15, 28)).astype(np.uint8)
    for w, h in ((28, 15), (14, 5), (9, 4), (1, 1)):
        got = P.area_resize(v, (w, h))
        fine = np.kron(v, np.ones((h, w)))  # every place w by h times, so each mean is over whole places
        want = np.rint(fine.reshape(h, 15, w, 28).mean((1, 3)))
        assert (got == want).all()
    assert (P.area_resize(np.full((3, 2), 255, np.uint8), (96, 32)) == 255).all()


def painted(letters, w=640, h=120, channels=3):
    img = np.full((h, w, channels), 40, np.uint8)
    for i in range(letters):
        x = 200 + 40 * i
        img[70:90, x : x + 30] = 230
        img[74:86, x + 6 : x + 24] = 40
    return img


KIND = "video_id string, frame_id string, time double, pixels binary, width int, height int, mask string"


def test_frames_from_pixels_to_the_gate(spark):
    images = [painted(5), painted(5), painted(0), painted(2, channels=1), np.full((120, 640, 3), 255, np.uint8)]
    rows = [("v", f"{i}", float(i), x.tobytes(), 640, 120, "clash") for i, x in enumerate(images)]
    rows += [("v", "bad", 9.0, b"123", 640, 120, None), ("v", "none", 10.0, None, 640, 120, None), ("v", "flat", 11.0, b"", 0, 5, None), ("v", "size", 12.0, b"1", None, 1, None)]
    df = C.with_text(spark.createDataFrame(rows, KIND))
    out = {r.frame_id: r for r in df.collect()}
    assert [out[k].detected for k in ("0", "1", "2", "3", "4", "bad", "none", "flat", "size")] == [True, True, False, False, False, False, False, False, False]
    assert out["0"].n_components == 5 and [tuple(b)[:4] for b in out["0"].boxes[:2]] == [(201, 71, 30, 20), (241, 71, 30, 20)]
    box = out["0"].text_box
    assert (box.x1, box.y1, box.x2, box.y2, box.area, box.n) == (201, 71, 391, 91, 5 * (600 - 12 * 18), 5)
    assert tuple(out["0"].crop) == (185, 63, 407, 99) and out["2"].crop is None and out["2"].text_box is None
    assert len(out["0"].mask) == 96 * 32 and len(out["0"].small) == 160 * 40
    assert out["4"].n_components == 0 and out["4"].bright == pytest.approx(99 / 120) and all(x is None for x in (out["bad"].mask, out["none"].bright, out["flat"].n_components and None))
    states = {r.frame_id: r.state for r in C.gate_frames(df).collect()}
    assert states["0"] == "emit" and states["1"] == "same" and states["2"] == "no_text"
    assert C.with_text(spark.createDataFrame([], KIND)).collect() == []


def test_components_of_masks(spark):
    rows = [(1, [True, None, True, False]), (2, None), (3, []), (4, [True] * 3), (5, [False] * 4)]
    got = spark.createDataFrame(rows, "k int, m array<boolean>").select("k", P.components_of("m", P.F.lit(2), (1, 1), (1, 1)).alias("c"))
    assert {r.k: None if r.c is None else [tuple(c) for c in r.c] for r in got.collect()} == {1: [(0, 0, 1, 2, 2)], 2: None, 3: None, 4: None, 5: []}


def reflected(i, n):
    return 0 if n == 1 else abs((n - 1) - abs((n - 1 - i) % (2 * (n - 1)))) if not 0 <= i < n else i


def test_denoising_by_loops():
    rng = np.random.default_rng(5)
    v = (rng.integers(0, 3, (6, 16)) * 40 + rng.integers(0, 9, (6, 16))).astype(np.uint8)
    h, w = v.shape
    at = lambda y, x: int(v[reflected(y, h), reflected(x, w)])
    wide = np.array([[at(y, x) for x in range(-13, w + 13)] for y in range(-13, h + 13)])
    for y, x in ((0, 0), (5, 15), (2, 7), (3, 1)):
        mine, top, bottom = wide[y + 10 : y + 17, x + 10 : x + 17], 0.0, 0.0
        for a in range(-10, 11):
            for b in range(-10, 11):
                other = wide[y + 10 + a : y + 17 + a, x + 10 + b : x + 17 + b]
                weight = np.exp(-((mine - other) ** 2).sum() / 49 / 144)
                if weight >= 0.001:
                    top, bottom = top + weight * wide[y + 13 + a, x + 13 + b], bottom + weight
        assert P.denoised(v)[y, x] == int(top / bottom + 0.5)
    flat = np.full((20, 30), 77, np.uint8)
    assert (P.denoised(flat) == flat).all() and (P.prepare(flat[:, :, None], "denoise") == 0).all()


def test_modes_by_loops():
    rng = np.random.default_rng(11)
    big = rng.integers(0, 256, (9, 40)).astype(np.uint8)
    h, w = big.shape
    sigma = 0.3 * (34 * 0.5 - 1) + 0.8
    g = [np.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-17, 18)]
    mean = lambda y, x: sum(g[a + 17] * g[b + 17] * big[min(max(y + a, 0), h - 1), min(max(x + b, 0), w - 1)] for a in range(-17, 18) for b in range(-17, 18)) / sum(g) ** 2
    got = P.local_levels(big, 35, 6)
    for y, x in ((0, 0), (8, 39), (4, 20), (7, 3)):
        assert got[y, x] == (255 if int(big[y, x]) - round(mean(y, x)) > 6 else 0)

    def apart(t):
        low, high = big[big <= t].astype(float), big[big > t].astype(float)
        return low.size * high.size * (low.mean() - high.mean()) ** 2 if low.size and high.size else 0.0

    best = max(range(256), key=lambda t: (round(apart(t), 3), -t))
    assert (P.two_levels(big) == np.where(big > best, 255, 0)).all()
    assert (P.two_levels(np.full((3, 3), 9, np.uint8)) == 255).all()


def test_style_of_letters():
    white, amber = painted(4), painted(4)
    amber[amber.min(axis=2) > 200] = (20, 200, 230)
    assert P.style(white) == "white" and P.style(amber) == "yellow"
    assert P.prepare(amber, "subtitle").max() == 255 and (P.prepare(amber, "subtitle") > 0).mean() < 0.2
    assert P.prepare(amber, "subtitle").shape == (360, 1920) and P.prepare(amber, "simple").shape == (240, 1280)
    assert (P.prepare(amber, "auto") == P.prepare(amber, "subtitle", "yellow")).all()
    assert (P.enlarge(np.full((2, 3, 3), 200, np.uint8), 3) == 200).all()


def test_variants_and_portable_images(spark):
    img = np.arange(50, dtype=np.uint8).reshape(50, 1, 1)
    assert P.variant(img, "crop_down:none")[:, 0, 0].tolist() == [0, 0, 0, *range(47)]
    assert P.variant(img, "crop_up:none")[:, 0, 0].tolist() == [*range(3, 50), 49, 49, 49]
    assert (P.variant(img, "crop:invert") == 255 - P.prepare(img, "grayscale")).all()
    for sample in (painted(2), painted(1, channels=1)):
        assert (P.decoded(P.encoded(sample)) == sample).all()
    assert P.decoded(b"P5 # made by hand\n2\n1 255\n\x01\x02").tolist() == [[[1], [2]]]
    for bad in (b"", b"P4 1 1 255\n1", b"P5 2 2 255\n1", b"P6 0 1 255\n"):
        with pytest.raises(ValueError):
            P.decoded(bad)
    rows = [(k, img.tobytes(), 1, 50, m) for k, m in enumerate(("crop_up:none", "adaptive", None, "no such"))] + [(9, None, 1, 1, "none"), (10, b"12", 3, 3, "none")]
    df = spark.createDataFrame(rows, "k int, p binary, w int, h int, m string")
    got = {r.k: r.p for r in df.select("k", P.prepared(P.F.col("p"), P.F.col("w"), P.F.col("h"), P.F.col("m")).alias("p")).collect()}
    assert (got[0].width, got[0].height, bytes(got[0].pixels)) == (1, 50, P.variant(img, "crop_up:none").tobytes())
    assert [(got[k].width, got[k].height) for k in (1, 2, 3)] == [(3, 150)] * 3 and got[2].pixels == got[3].pixels
    assert all(got[k].pixels is None and got[k].width is None for k in (9, 10))


class Meter:
    """Reads a word where letters are bright enough."""

    def __call__(self, content: bytes) -> tuple[str, float]:
        img = P.decoded(content)
        return ("Это наш дом" if (img > 200).mean() > 0.005 else ""), min(0.99, img.shape[0] / 1000)


def test_deep_retry_on_portable_images(spark):
    from subloom.operators import recognise

    rows = [("v", f"{i}", float(i), P.encoded(painted(n))) for i, n in enumerate((4, 4, 0))] + [("w", "0", 0.0, b"no image")]
    frames = spark.createDataFrame(rows, "video_id string, frame_id string, time double, content binary")
    out = {(r.video_id, r.frame_id): r for r in recognise.deep_retry(frames.where("video_id = 'v'"), frames.where("frame_id = '0'"), {"meter": Meter}).collect()}
    assert (out["v", "0"].text, out["v", "0"].outcome) == ("Это наш дом", "deep_vote")


def test_results_of_a_batch_are_flat_arrays():
    """A batch's masks, thumbnails and components are made as Arrow arrays, without an object a row; what is no image has nulls."""
    import pyarrow as pa

    blank = bytes(8 * 4)
    args = pa.array([blank, None, blank], pa.binary()), pa.array([8, 8, 5]), pa.array([4, 4, 4]), pa.array([0.32] * 3)
    got = P._text_of.func(*args)
    assert isinstance(got, pa.StructArray) and len(got) == 3
    assert [x["mask"] is None for x in got.to_pylist()] == [x["components"] is None for x in got.to_pylist()] == [False, True, True]
    assert got[0].as_py()["components"] == [] and got[0].as_py()["bright"] == 0.0
