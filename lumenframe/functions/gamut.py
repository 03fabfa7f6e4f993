"""RGB primaries, white points, and the matrices between them (driver-side numpy; a few numbers each)."""

from __future__ import annotations

import numpy as np

#: Chromaticities of white points. Fixed values.
WHITES = {
    "D50": (0.34570, 0.35850), "D55": (0.33242, 0.34743), "D60": (0.32168, 0.33767), "D65": (0.31270, 0.32900),
    "D75": (0.29902, 0.31485), "DCI": (0.31400, 0.35100), "A": (0.44757, 0.40745), "E": (1 / 3, 1 / 3),
    "F2": (0.37208, 0.37529), "F7": (0.31292, 0.32933), "F11": (0.38052, 0.37713),
}
#: Chromaticities of red, green and blue, and the white point. Fixed values.
GAMUTS = {
    "srgb": ((0.6400, 0.3300), (0.3000, 0.6000), (0.1500, 0.0600), "D65"),
    "rec709": ((0.6400, 0.3300), (0.3000, 0.6000), (0.1500, 0.0600), "D65"),
    "rec2020": ((0.7080, 0.2920), (0.1700, 0.7970), (0.1310, 0.0460), "D65"),
    "dci_p3": ((0.6800, 0.3200), (0.2650, 0.6900), (0.1500, 0.0600), "DCI"),
    "p3_d60": ((0.6800, 0.3200), (0.2650, 0.6900), (0.1500, 0.0600), "D60"),
    "rec709_d60": ((0.6400, 0.3300), (0.3000, 0.6000), (0.1500, 0.0600), "D60"),
    "rec2020_d60": ((0.7080, 0.2920), (0.1700, 0.7970), (0.1310, 0.0460), "D60"),
    "xyz_e": ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0), "E"),
    "sgamut3_venice": ((0.740464264304292, 0.279364374750660), (0.089241145423286, 0.893809528608105), (0.110488236673827, -0.052579333080476), "D65"),
    "sgamut3_cine_venice": ((0.775901871567345, 0.274502392854799), (0.188682902773355, 0.828684937020288), (0.101337382499301, -0.089187517306263), "D65"),
    "display_p3": ((0.6800, 0.3200), (0.2650, 0.6900), (0.1500, 0.0600), "D65"),
    "aces_ap0": ((0.7347, 0.2653), (0.0000, 1.0000), (0.0001, -0.0770), "D60"),
    "aces_ap1": ((0.7130, 0.2930), (0.1650, 0.8300), (0.1280, 0.0440), "D60"),
    "adobe_rgb": ((0.6400, 0.3300), (0.2100, 0.7100), (0.1500, 0.0600), "D65"),
    "prophoto": ((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001), "D50"),
    "arri_wide3": ((0.6840, 0.3130), (0.2210, 0.8480), (0.0861, -0.1020), "D65"),
    "arri_wide4": ((0.7347, 0.2653), (0.1424, 0.8576), (0.0991, -0.0308), "D65"),
    "sgamut3": ((0.7300, 0.2800), (0.1400, 0.8550), (0.1000, -0.0500), "D65"),
    "sgamut3_cine": ((0.7660, 0.2750), (0.2250, 0.8000), (0.0890, -0.0870), "D65"),
    "canon": ((0.7400, 0.2700), (0.1700, 1.1400), (0.0800, -0.1000), "D65"),
    "red_wide": ((0.780308, 0.304253), (0.121595, 1.493994), (0.095612, -0.084589), "D65"),
    "vgamut": ((0.7300, 0.2800), (0.1650, 0.8400), (0.1000, -0.0300), "D65"),
    "davinci": ((0.8000, 0.3130), (0.1682, 0.9877), (0.0790, -0.1155), "D65"),
    "dji": ((0.71, 0.31), (0.21, 0.88), (0.09, -0.08), "D65"),
}
#: Cone response matrices of the adaptation methods. Fixed values.
CONES = {
    "bradford": ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296)),
    "vonkries": ((0.40024, 0.70760, -0.08081), (-0.22630, 1.16532, 0.04570), (0.0, 0.0, 0.91822)),
    "cat02": ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834)),
    "xyz": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
}


def white_xyz(name: str) -> np.ndarray:
    """XYZ of a white point, of luminance 1."""
    x, y = WHITES[name]
    return np.array([x / y, 1.0, (1 - x - y) / y])


def matrix_of(red, green, blue, white) -> np.ndarray:
    """Columns are the XYZ of three primaries (x, y), scaled so that equal parts make the white point."""
    columns = np.array([[x / y, 1.0, (1 - x - y) / y] if y else [x, y, 1 - x - y] for x, y in (red, green, blue)]).T
    x, y = white
    return columns * np.linalg.solve(columns, np.array([x / y, 1.0, (1 - x - y) / y]))


def rgb_to_xyz(gamut: str) -> np.ndarray:
    *primaries, white = GAMUTS[gamut]
    return matrix_of(*primaries, WHITES[white])


def xyz_to_rgb(gamut: str) -> np.ndarray:
    return np.linalg.inv(rgb_to_xyz(gamut))


def adaptation(source: str, target: str, method: str = "bradford") -> np.ndarray:
    """The matrix that turns colours seen under one white into those under another."""
    cone = np.array(CONES[method])
    ratio = (cone @ white_xyz(target)) / (cone @ white_xyz(source))
    return np.linalg.inv(cone) @ np.diag(ratio) @ cone


def rgb_to_rgb(source: str, target: str, method: str | None = None) -> np.ndarray:
    """From one gamut to another; with a method, whites are adapted."""
    middle = adaptation(GAMUTS[source][3], GAMUTS[target][3], method) if method else np.eye(3)
    return xyz_to_rgb(target) @ middle @ rgb_to_xyz(source)
