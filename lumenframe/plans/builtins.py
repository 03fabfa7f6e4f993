"""Built-in transforms by their style names.

A style says what it goes from and to: a camera's log curve and gamut, a utility matrix, a
curve alone, a display's gamut and encoding, or a rendering. Names are read without regard
to case, dashes, dots, underscores and spaces, and put together from tables of their parts.
"""

from __future__ import annotations

import re

import numpy as np

from ..functions import aces2, gamut
from . import ir

#: Camera encodings: curve, gamut, and how its white is adapted to that of ACES. Fixed values.
CAMERAS = {
    "arrilogc3": ("logc3", "arri_wide3", "cat02"), "arrialexalogcei800awg": ("logc3", "arri_wide3", "cat02"), "arrialexa": ("logc3", "arri_wide3", "cat02"),
    "arrilogc4": ("logc4", "arri_wide4", "cat02"), "logc3": ("logc3", "arri_wide3", "cat02"), "logc4": ("logc4", "arri_wide4", "cat02"), "arrilogc": ("logc3", "arri_wide3", "cat02"),
    "sonyslog3sgamut3": ("slog3", "sgamut3", "cat02"), "sonyslog3": ("slog3", "sgamut3", "cat02"), "slog3": ("slog3", "sgamut3", "cat02"), "slog3sgamut3": ("slog3", "sgamut3", "cat02"),
    "sonyslog3sgamut3cine": ("slog3", "sgamut3_cine", "cat02"), "slog3cine": ("slog3", "sgamut3_cine", "cat02"), "slog3sgamut3cine": ("slog3", "sgamut3_cine", "cat02"),
    "sonyslog3sgamut3venice": ("slog3", "sgamut3_venice", "cat02"), "sonyslog3sgamut3cinevenice": ("slog3", "sgamut3_cine_venice", "cat02"),
    "panasonicvlogvgamut": ("vlog", "vgamut", "cat02"), "vlog": ("vlog", "vgamut", "cat02"), "vlogvgamut": ("vlog", "vgamut", "cat02"),
    "redlog3g10rwg": ("log3g10", "red_wide", "bradford"), "log3g10": ("log3g10", "red_wide", "bradford"), "log3g10rwg": ("log3g10", "red_wide", "bradford"), "redlog": ("log3g10", "red_wide", "bradford"),
    "redredlogfilmrwg": ("redlogfilm", "red_wide", "bradford"), "redlogfilm": ("redlogfilm", "red_wide", "bradford"), "redlogfilmrwg": ("redlogfilm", "red_wide", "bradford"),
    "canonclog2cgamut": ("clog2", "canon", "cat02"), "clog2": ("clog2", "canon", "cat02"), "canonclog2": ("clog2", "canon", "cat02"),
    "canonclog3cgamut": ("clog3", "canon", "cat02"), "clog3": ("clog3", "canon", "cat02"), "canonclog3": ("clog3", "canon", "cat02"),
    "applelog": ("apple_log", "rec2020", "bradford"), "applelogrec2020": ("apple_log", "rec2020", "bradford"),
}
#: Curves alone, by what they decode. Fixed values.
CURVES = {
    "applelog": "apple_log", "canonclog2": "clog2", "canonclog3": "clog3", "acescctlog": "acescct", "acescclog": "acescc", "st2084": "pq_100", "pq": "pq_100",
    "hlg": "hlg", "srgb": "srgb", "rec709": "rec709",
}
#: Displays: gamut, white whose colours are adapted from D65 (none: seen as they are), encoding. Fixed values.
DISPLAYS = {
    "rec1886rec709": ("rec709", None, 2.4), "rec1886rec2020": ("rec2020", None, 2.4), "g22rec709": ("rec709", None, 2.2), "g26p3dcibfd": ("dci_p3", "DCI", 2.6),
    "g26p3d65": ("display_p3", None, 2.6), "g26p3d60bfd": ("p3_d60", "D60", 2.6), "srgb": ("srgb", None, "srgb"), "displayp3": ("display_p3", None, "srgb"),
    "displayp3hdr": ("display_p3", None, "srgb mirror"), "st2084p3d65": ("display_p3", None, "pq_100"), "rec2100pq": ("rec2020", None, "pq_100"),
    "rec2100hlg": ("rec2020", None, "hlg"), "rec2100hlg1000nit": ("rec2020", None, "hlg"), "dcdmd65": (None, None, "dcdm"), "st2084dcdmd65": (None, None, "pq_100"),
}
#: White of cinema encodings over their reference white. Fixed values.
DCDM = 48.0 / 52.37
#: Film density to printing density, density to logarithm of exposure by points, exposure to ACES. Fixed values.
ADX_DENSITY = ((0.75573, 0.22197, 0.02230), (0.05901, 0.96928, -0.02829), (0.16134, 0.07406, 0.76460))
ADX_POINTS = (
    (-0.19, -6.0), (0.01, -2.721718645), (0.028, -2.521718645), (0.054, -2.321718645), (0.095, -2.121718645), (0.145, -1.921718645), (0.22, -1.721718645),
    (0.3, -1.521718645), (0.4, -1.321718645), (0.5, -1.121718645), (0.6, -0.926545676714876),
)
ADX_EXPOSURE = ((0.72286, 0.12630, 0.15084), (0.11923, 0.76418, 0.11659), (0.01427, 0.08213, 0.90359))
#: The matrix that softens saturated blue light. Fixed values.
BLUE_LIGHT = ((0.9404372683, -0.0183068787, 0.0778696104), (0.0083786969, 0.8286599939, 0.1629613092), (0.0005471261, -0.0008833746, 1.0003362486))


class Missing(KeyError):
    """A name that the catalogue doesn't know."""


def _plain(style: str) -> str:
    return re.sub(r"[-_. ]", "", style.lower())


def _ap(a: str, b: str) -> ir.Matrix:
    return ir.Matrix(gamut.rgb_to_rgb(a, b))


def _utility(name: str) -> list | None:
    """Matrices between the two ACES gamuts, XYZ and Rec.709, and curves of the ACES working spaces."""
    to_d65 = lambda g: ir.Matrix(gamut.adaptation("D60", "D65") @ gamut.rgb_to_xyz(g))
    found = {
        "identity": [], "acesap0toap1": [_ap("aces_ap0", "aces_ap1")], "acesap1toap0": [_ap("aces_ap1", "aces_ap0")], "ap0toap1": [_ap("aces_ap0", "aces_ap1")],
        "ap1toap0": [_ap("aces_ap1", "aces_ap0")], "aces2065toacescg": [_ap("aces_ap0", "aces_ap1")], "acescgtoaces2065": [_ap("aces_ap1", "aces_ap0")],
        "acescgtoaces20651": [_ap("aces_ap1", "aces_ap0")], "acesap0toxyzd65bfd": [to_d65("aces_ap0")], "acesap1toxyzd65bfd": [to_d65("aces_ap1")],
        "ap0toxyzd65": [to_d65("aces_ap0")], "ap1toxyzd65": [to_d65("aces_ap1")], "aces20651toxyzd65": [to_d65("aces_ap0")], "acescgtoxyzd65": [to_d65("aces_ap1")],
        "utilityacesap0tociexyzd65bfd": [to_d65("aces_ap0")], "utilityacesap1tociexyzd65bfd": [to_d65("aces_ap1")],
        "utilityacesap1tolinearrec709bfd": [ir.Matrix(gamut.rgb_to_rgb("aces_ap1", "rec709", "bradford"))],
        "srgbtolinear": [ir.Curve("srgb")], "acesccttoacescg": [ir.Curve("acescct")], "acescctoacescg": [ir.Curve("acescc")],
        "srgbtoxyzd65": [ir.Curve("srgb"), ir.Matrix(gamut.rgb_to_xyz("srgb"))], "srgbtociexyz": [ir.Curve("srgb"), ir.Matrix(gamut.rgb_to_xyz("srgb"))],
        "aceslmtbluelightartifactfix": [ir.Matrix(np.array(BLUE_LIGHT))], "gamutcompress13": [_ap("aces_ap0", "aces_ap1"), ir.Fixed("aces_gamut_comp_13"), _ap("aces_ap1", "aces_ap0")],
    }
    found["aceslmtaces13referencegamutcompression"] = found["gamutcompress13"]
    for suffix in ("", "1"):
        found[f"acesccttoaces2065{suffix}"] = [ir.Curve("acescct"), _ap("aces_ap1", "aces_ap0")]
        found[f"acescctoaces2065{suffix}"] = [ir.Curve("acescc"), _ap("aces_ap1", "aces_ap0")]
    return found.get(name)


def _curve(name: str) -> list | None:
    """CURVE styles: X_to_LINEAR decodes, LINEAR_to_X encodes, and the HLG pair has names of its own."""
    if name in ("curvehlgoetf", "curvelineartohlg"):
        return [ir.Curve("hlg", False)]
    if name in ("curvehlgoetfinverse", "curvehlgtolinear"):
        return [ir.Curve("hlg")]
    if m := re.fullmatch(r"curve(.+?)to(?:linear|lin)", name):
        key = m[1]
        return [ir.Curve(CURVES[key])] if key in CURVES else _named_curve(key, True)
    if m := re.fullmatch(r"curvelinearto(.+)", name):
        return [ir.Curve(CURVES[m[1]], False)] if m[1] in CURVES else _named_curve(m[1], False)
    return None


def _named_curve(key: str, decode: bool) -> list | None:
    from ..functions.transfer import CURVES as known

    return next(([ir.Curve(n, decode)] for n in known if _plain(n) == key), None)


def _camera(name: str) -> list | None:
    m = re.fullmatch(r"(.+?)to(?:aces20651|aces2065|aces|ap0)", name) or re.fullmatch(r"(arrialexa)", name)
    if not m:
        return None
    if m[1] in CAMERAS:
        curve, g, method = CAMERAS[m[1]]
        return [ir.Curve(curve), ir.Matrix(gamut.rgb_to_rgb(g, "aces_ap0", method))]
    if m[1] in ("acesproxy10i", "acesproxy10"):
        # Code values 64 to 940 of 10 bits are stops: 50 of them each, 425 at 2.5 stops below 1.
        low, high = ((c - 425.0) / 50.0 - 2.5 for c in (64.0, 940.0))
        return [ir.Range(64 / 1023, 940 / 1023, low, high, False), ir.Made("power_of", (2.0,)), _ap("aces_ap1", "aces_ap0")]
    if m[1] in ("adx10", "adx16"):
        scale, shift = (1023 / 500, -95 / 500) if m[1] == "adx10" else (65535 / 8000, -1520 / 8000)
        return [
            ir.Matrix(np.eye(3) * scale, (shift,) * 3), ir.Matrix(np.array(ADX_DENSITY)), ir.Made("line", (ADX_POINTS, 100 / 55)), ir.Made("power_of", (10.0,)),
            ir.Matrix(np.array(ADX_EXPOSURE)),
        ]
    return None


def _display(name: str) -> list | None:
    m = re.fullmatch(r"(?:display)?(?:cie)?xyzd65to(.+?)(mirrornegs?)?", name)
    if not m or m[1] not in DISPLAYS:
        return None
    g, white, encoding = DISPLAYS[m[1]]
    mirror = bool(m[2])
    out = []
    if g:
        back = gamut.xyz_to_rgb(g)
        out.append(ir.Matrix(back @ gamut.adaptation("D65", white) if white else back))
    if encoding == "dcdm":
        return [ir.Matrix(np.eye(3) * DCDM), ir.Exponent((1 / 2.6,) * 3)]
    if encoding == "srgb mirror" or (encoding == "srgb" and mirror):
        return [*out, ir.Curve("moncurve_mirror", False)]
    if isinstance(encoding, float):
        return [*out, ir.Exponent((1 / encoding,) * 3, "mirror" if mirror else "clamp")]
    return [*out, ir.Curve(encoding, False)]


#: Limiting gamuts of second-generation renderings by what their names hold, the first that fits. Fixed values.
LIMITS = (
    ("rec709d60", "rec709_d60"), ("rec709", "rec709"), ("p3d60", "p3_d60"), ("p3d65", "display_p3"), ("rec2020d60", "rec2020_d60"), ("rec2020", "rec2020"), ("xyze", "xyz_e"),
)


def _rendering(name: str) -> list | None:
    """ACES-OUTPUT styles: ACES2065-1 to CIE-XYZ-D65."""
    if not name.startswith("acesoutput"):
        return None
    body = name.split("xyzd65", 1)[-1]
    to_d65 = lambda g: ir.Matrix(gamut.adaptation(gamut.GAMUTS[g][3], "D65") @ gamut.rgb_to_xyz(g) if gamut.GAMUTS[g][3] != "D65" else gamut.rgb_to_xyz(g))
    if body.endswith("20"):
        peak = re.search(r"(\d+)nit", body)
        limit = next((g for k, g in LIMITS if k in body), None)
        if peak is None or limit is None:
            return None
        there, back = (aces2.output_transform(float(peak[1]), limit, inverse)[0] for inverse in (False, True))
        return [ir.Ready(there, back), to_d65(limit)]
    if not body.endswith(("10", "11")):
        return None
    # The first generation: into the rendering gamut, glow, red modifier, tone curve, desaturation, and the surround for video.
    dim = [] if "cinema" in body or "hdr" in body else [ir.Fixed("aces_dark_to_dim_10")]
    return [ir.Fixed("aces_glow_10"), ir.Fixed("aces_red_mod_10"), _ap("aces_ap0", "aces_ap1"), ir.Made("tone", ("fitted",)), *dim, to_d65("aces_ap1")]


def builtin(style: str) -> list:
    """A built-in transform by style; unknown ones are refused."""
    name = _plain(style)
    for part in (_utility, _curve, _camera, _display, _rendering):
        found = part(name)
        if found is not None:
            return found
    raise Missing(style)

