"""Codes in images: drawn by the writer, read back, with errors, turns, several in one picture, and bad input."""

import numpy as np
import pytest

from sievemark.plans.samples import code_image, with_file
from sievemark.sources import qr, qr_layout
from sievemark.sources.mail import parsed
from sievemark.sources.qr_write import drawn, png, symbol

LINK = "https://example.com/pay?id=8812"


def values(pixels, **how):
    found = qr.read(png(pixels, **how))
    assert found["status"] == "evaluated"
    return found["values"]


@pytest.mark.parametrize("text", [LINK, "0123456789012", "HELLO WORLD $1", "x" * 300, "é日本😀" * 10, "a"])
@pytest.mark.parametrize("level", "LMQH")
def test_round_trips(text, level):
    for mask, scale in ((0, 1), (3, 2), (5, 4), (7, 3)):
        assert values(drawn(symbol(text, level, mask), scale)) == [text]


def test_large_versions():
    for least in (7, 14, 27, 40):
        assert values(drawn(symbol("v" * 50, "M", 2, least), 2)) == ["v" * 50]
    with pytest.raises(ValueError):
        symbol("x" * 3000)


def test_light_on_dark_and_turned():
    picture = drawn(symbol(LINK), 5)
    for turn in range(4):
        assert values(255 - np.rot90(picture, turn)) == [LINK]
    wide = np.full((500, 500), 255, dtype=np.uint8)
    at = (500 - len(picture)) // 2
    wide[at : at + len(picture), at : at + len(picture)] = picture
    y, x = np.mgrid[:500, :500] - 250.0
    for degrees in (10, 33, 45, 77, 200):
        a = np.deg2rad(degrees)
        own = wide[np.clip(np.rint(np.cos(a) * y - np.sin(a) * x + 250).astype(int), 0, 499), np.clip(np.rint(np.cos(a) * x + np.sin(a) * y + 250).astype(int), 0, 499)]
        assert values(own) == [LINK], degrees


def test_several_in_one_image():
    sheet = np.full((450, 900), 255, dtype=np.uint8)
    for at, text in ((10, "https://legit-bank.example/"), (470, "https://evil-pay.example/steal")):
        own = drawn(symbol(text), 8)
        sheet[10 : 10 + len(own), at : at + len(own)] = own
    assert sorted(values(sheet)) == ["https://evil-pay.example/steal", "https://legit-bank.example/"]


def test_errors_are_corrected_or_refused():
    for level, hits in (("L", 2), ("M", 4), ("Q", 6), ("H", 8)):
        random = np.random.default_rng(7)
        modules = symbol("https://example.com/", level)
        free = np.argwhere(~qr_layout.reserved((len(modules) - 17) // 4))
        for y, x in random.permutation(free)[:hits]:
            modules[y, x] ^= True
        assert values(drawn(modules)) == ["https://example.com/"], level
    broken = symbol(LINK, "L")
    free = ~qr_layout.reserved((len(broken) - 17) // 4)
    broken[free] ^= np.random.default_rng(3).random(int(free.sum())) < 0.4
    assert values(drawn(broken)) == []


def test_pixel_formats():
    grey = drawn(symbol(LINK), 3)
    rgb = np.repeat(grey[:, :, None], 3, axis=2)
    clear = np.dstack([np.zeros_like(rgb), 255 - grey])  # black with transparency where it is light
    assert values(rgb, kind=2) == values(clear, kind=6) == values(np.dstack([grey // 2, np.full_like(grey, 255)]), kind=4) == [LINK]
    for filters in range(5):
        assert values(grey, filters=filters) == [LINK]


def test_nothing_and_bad_input():
    assert values(np.full((300, 300), 255, dtype=np.uint8)) == values(np.random.default_rng(1).integers(0, 256, (300, 300), dtype=np.uint8)) == []
    assert qr.read(b"")["reason"] == "empty" and qr.read(b"this is not an image")["reason"] == "unreadable_image"
    whole = png(drawn(symbol(LINK)))
    for cut in (20, 30, 60, 150, len(whole) - 20):
        assert qr.read(whole[:cut])["status"] in ("evaluated", "not_evaluated")
    assert qr.read(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7000).to_bytes(4, "big") * 2 + b"\x08\0\0\0\0")["reason"] == "image_too_large"
    assert qr.read(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (9).to_bytes(4, "big") * 2)["reason"] == "decode_error"


def test_jpeg_sizes():
    def jpeg(width, height, before=b""):
        return b"\xff\xd8\xff\xe0\x00\x04ab" + before + b"\xff\xc2\x00\x0b\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00"

    thumbnail = b"\xff\xe1" + (5002).to_bytes(2, "big") + b"\xff\xc0\x00\x0b" * 1250
    assert qr.measured(jpeg(640, 480)) == qr.measured(jpeg(640, 480, thumbnail)) == qr.measured(jpeg(640, 480, b"\xff\xff\xc4\x00\x02")) == (640, 480)
    assert qr.read(jpeg(7000, 7000, thumbnail))["reason"] == "image_too_large"
    assert qr.read(jpeg(640, 480))["reason"] == "local_qr_decoder_unavailable"
    for bad in (b"\xff\xd8\xff", jpeg(640, 480)[:14], b"\xff\xd8\xff\xda\x00\x02", b"\xff\xd8\xff\xe0\x00\x02xx", jpeg(0, 5)):
        assert qr.read(bad)["reason"] == "unreadable_image"


def test_caps(monkeypatch):
    monkeypatch.setattr(qr, "texts", lambda dark: [f"https://h{i}.example/" + "a" * 6000 for i in range(50)])
    found = qr.read(png(np.zeros((30, 30), dtype=np.uint8)))["values"]
    assert len(found) == qr.MAX_SYMBOLS and all(len(v) == qr.MAX_CHARS for v in found)


def test_attached_images(spark):
    files = [code_image("bit.ly/3xYzAbC"), code_image("WIFI:S:cafe;T:WPA;P:secret;;", 3), png(np.full((60, 60), 255, dtype=np.uint8)), b"\xff\xd8\xff"]
    rows = spark.createDataFrame([(i, bytearray(with_file("scan.png", "image/png", d))) for i, d in enumerate(files)], "i int, content binary")
    link, wifi, none, bad = [r.attachments[0] for r in parsed(rows, keep=["i"]).orderBy("i").collect()]
    assert link.extracted_urls == ["http://bit.ly/3xYzAbC"] and [f.code for f in link.findings] == ["QR_URL"]
    assert (link.qr.status, link.qr.symbols, link.qr.payload_kinds, link.qr.non_url_payloads[0].masked) == ("evaluated", 1, ["url"], "***zAbC")
    assert (wifi.qr.payload_kinds, wifi.qr.non_url_payloads[0].kind, wifi.findings) == (["wifi"], "wifi", []) and "secret" not in str(wifi)
    assert (none.qr.status, none.qr.symbols, bad.qr.status, bad.qr.reason, bad.qr.symbols) == ("evaluated", 0, "not_evaluated", "unreadable_image", None)


def test_rows_that_lean_on_their_left_neighbour_cost_no_more_than_a_plain_loop():
    import time

    rng = np.random.default_rng(5)
    kinds, lines, above = rng.integers(3, 5, 40).astype(np.uint8), rng.integers(0, 256, (40, 40, 1)).astype(np.uint8), np.zeros((40, 1), dtype=np.uint8)

    def plain():
        out = np.zeros((41, 41), dtype=np.uint8)
        for y in range(40):
            for x in range(40):
                left, up, corner = int(out[y + 1, x]), int(out[y, x + 1]), int(out[y, x])
                near = sorted((left, up, corner), key=lambda v: abs(left + up - corner - v))[0]
                out[y + 1, x + 1] = int(lines[y, x, 0]) + ((left + up) >> 1 if kinds[y] == 3 else near) & 255
        return out[1:, 1:, None]

    def least(run):
        took = []
        for _ in range(5):
            start = time.perf_counter()
            run()
            took.append(time.perf_counter() - start)
        return min(took)

    assert (qr._unfiltered(kinds, lines, above) == plain()).all()
    assert least(lambda: qr._unfiltered(kinds, lines, above)) < least(plain)
