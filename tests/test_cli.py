import numpy as np
import pytest

from lumenframe import cli
from lumenframe.sources import codecs
from lumenframe.sources.picture import Picture


@pytest.fixture
def photo(tmp_path):
    rng = np.random.default_rng(3)
    p = Picture({c: rng.random((9, 12)).astype(np.float32) for c in "rgb"})
    path = tmp_path / "in.exr"
    path.write_bytes(codecs.encode(p, "exr"))
    return str(path), p


def test_commands(spark, photo, tmp_path, capsys):
    path, p = photo
    out = str(tmp_path / "out.exr")
    read = lambda: codecs.decode((tmp_path / "out.exr").read_bytes())
    assert cli.main(["transform", path, out, "--op", "rot90"]) == 0
    assert np.array_equal(read().channels["g"], np.rot90(p.channels["g"], -1))
    assert cli.main(["resize", path, out, "--scale", "0.5"]) == 0
    assert (read().width, read().height) == (6, 4)
    assert cli.main(["grade", path, out, "--slope", "0.5"]) == 0
    assert np.allclose(read().channels["r"], p.channels["r"] * 0.5, atol=1e-6)
    assert cli.main(["crop", path, out, "--x", "2", "--y", "1", "--width", "3", "--height", "4"]) == 0
    assert np.array_equal(read().channels["b"], p.channels["b"][1:5, 2:5])
    lut = tmp_path / "x.cube"
    lut.write_text("LUT_1D_SIZE 2\n0 0 0\n0.5 0.5 0.5\n")
    assert cli.main(["lut", path, out, "--file", str(lut)]) == 0
    assert np.allclose(read().channels["r"], p.channels["r"] * 0.5, atol=1e-6)
    assert cli.main(["color", path, out, "--source", "sRGB", "--target", "sRGB"]) == 0
    assert cli.main(["diff", path, out, "--fail", "0.5"]) == 0
    assert cli.main(["info", path]) == 0 and "width=12" in capsys.readouterr().out
    assert cli.main(["stats", path]) == 0
    assert cli.main(["batch", path, str(tmp_path / "done"), "--op", "flip_h"]) == 0
    assert np.array_equal(codecs.decode((tmp_path / "done" / "in.exr").read_bytes()).channels["g"], p.channels["g"][:, ::-1])
    (tmp_path / "bad.exr").write_bytes(b"bad")
    assert cli.main(["batch", str(tmp_path / "bad.exr"), str(tmp_path / "done")]) == 1
    png = str(tmp_path / "out.png")
    assert cli.main(["convert", path, png, "--bits", "16"]) == 0
    assert cli.main(["diff", path, png, "--fail", "0.0001"]) == 0
    assert cli.main(["composite", path, png, out, "--mode", "screen"]) == 0
    assert cli.main(["aces", path, out, "--op", "rrt"]) == 0
    assert read().channels["r"].max() <= 1
    assert cli.main(["warp", path, out, "--kind", "twist", "--k1", "0"]) == 0
    assert np.allclose(read().channels["g"][1:-1, 1:-1], p.channels["g"][1:-1, 1:-1], atol=1e-5)
    assert cli.main(["maketx", path, str(tmp_path / "t.exr")]) == 0
    half = codecs.decode((tmp_path / "t.mip1.exr").read_bytes())
    assert (half.width, half.height) == (6, 4)
    assert np.allclose(half.channels["b"][0, 0], p.channels["b"][:2, :2].mean(), atol=1e-6)
    assert cli.main(["fill", path, out]) == 0


def test_alpha_and_other_channels_stay(spark, tmp_path):
    rng = np.random.default_rng(5)
    p = Picture({c: rng.random((6, 8)).astype(np.float32) for c in ("r", "g", "b", "a", "z", "diffuse.R")})
    path, out = str(tmp_path / "in.exr"), str(tmp_path / "out.exr")
    (tmp_path / "in.exr").write_bytes(codecs.encode(p, "exr"))
    read = lambda: codecs.decode((tmp_path / "out.exr").read_bytes()).channels
    for args in (["transform", "--op", "flip"], ["crop", "--width", "8", "--height", "6"], ["grade"], ["clamp"], ["color", "--source", "sRGB", "--target", "ACEScg"], ["resize", "--scale", "1", "--filter", "nearest"], ["rotate"], ["blur", "--box", "1"]):
        assert cli.main([args[0], path, out, *args[1:]]) == 0
        flipped = args[0] == "transform"
        got = read()
        assert set(got) == set(p.channels), args
        for c in ("a", "z", "diffuse.R"):
            assert np.allclose(got[c], p.channels[c][::-1] if flipped else p.channels[c], atol=1e-6), (args, c)
    png = str(tmp_path / "out.png")
    assert cli.main(["convert", path, png, "--bits", "16"]) == 0
    assert list(codecs.decode((tmp_path / "out.png").read_bytes()).channels) == ["r", "g", "b", "a"]


def test_layers(spark, tmp_path, capsys):
    rng = np.random.default_rng(6)
    one, two = (Picture({c: rng.random((4, 5)).astype(np.float32) for c in "rgb"}) for _ in range(2))
    for name, p in (("one", one), ("two", two)):
        (tmp_path / f"{name}.exr").write_bytes(codecs.encode(p, "exr"))
    both, out = str(tmp_path / "both.exr"), str(tmp_path / "out.exr")
    assert cli.main(["merge-layers", str(tmp_path / "one.exr"), str(tmp_path / "two.exr"), "--output", both, "--names", "beauty,light"]) == 0
    capsys.readouterr()
    assert cli.main(["layers", both]) == 0
    assert "layer=light" in capsys.readouterr().out
    assert cli.main(["extract-layer", both, out, "--layer", "light"]) == 0
    got = codecs.decode((tmp_path / "out.exr").read_bytes()).channels
    assert all(np.array_equal(got[c], two.channels[c]) for c in "rgb")
    assert cli.main(["channel-extract", both, out, "--channels", "beauty.G,light.B"]) == 0
    got = codecs.decode((tmp_path / "out.exr").read_bytes()).channels
    assert np.array_equal(got["beauty.G"], one.channels["g"]) and np.array_equal(got["light.B"], two.channels["b"])


def test_udim(spark, tmp_path, capsys):
    rng = np.random.default_rng(7)
    whole = Picture({c: rng.random((8, 12)).astype(np.float32) for c in "rgb"})
    (tmp_path / "whole.exr").write_bytes(codecs.encode(whole, "exr"))
    assert cli.main(["udim", "split", str(tmp_path / "whole.exr"), str(tmp_path / "t.<UDIM>.exr"), "--tile-size", "4"]) == 0
    assert np.array_equal(codecs.decode((tmp_path / "t.1011.exr").read_bytes()).channels["r"], whole.channels["r"][:4, :4])
    pattern = str(tmp_path / "t.<UDIM>.exr")
    assert cli.main(["udim", "info", pattern]) == 0
    assert capsys.readouterr().out.count("tile=10") == 6
    assert cli.main(["udim", "convert", pattern, str(tmp_path / "c.<UDIM>.pfm")]) == 0
    assert np.array_equal(codecs.decode((tmp_path / "c.1003.pfm").read_bytes()).channels["b"], whole.channels["b"][4:, 8:])
    for size in (4, 2):
        assert cli.main(["udim", "atlas", pattern, str(tmp_path / "atlas.exr"), "--tile-size", str(size)]) == 0
        got = codecs.decode((tmp_path / "atlas.exr").read_bytes()).channels
        assert np.array_equal(got["g"], whole.channels["g"] if size == 4 else whole.channels["g"][1::2, 1::2])
