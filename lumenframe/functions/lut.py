"""Look-up tables: one- and three-dimensional, and the text formats that carry them.

Small tables become constant arrays inside the expression. Larger ones
(over INLINE entries) are broadcast to the executors and applied to Arrow batches; a table's size is fixed by its file.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .expr import Op, at, clamp, ex, floor, least, numbers, when

RGB = ("r", "g", "b")
INLINE = 1000


@dataclass(frozen=True)
class Lut1D:
    """Tables of equal length for one or three channels over a common domain."""

    tables: np.ndarray  # (n, 1 or 3)
    low: float = 0.0
    high: float = 1.0

    @staticmethod
    def of(f, n: int, low: float = 0.0, high: float = 1.0) -> Lut1D:
        return Lut1D(f(np.linspace(low, high, n))[:, None], low, high)

    def op(self, extrapolate_below: bool = False) -> Op:
        """Linear interpolation; outside the domain the ends hold (or, below, the first segment goes on)."""
        n = len(self.tables)
        steps1 = {f"t_{c}": (ex(c) - self.low) / (self.high - self.low) * float(n - 1) for c in RGB}
        index = {f"i_{c}": clamp(floor(f"t_{c}"), 0.0, float(max(0, n - 2))).cast("INT") for c in RGB}
        tables = {f"l_{c}": numbers(self.tables[:, min(k, self.tables.shape[1] - 1)]) for k, c in enumerate(RGB)}
        out = {}
        for c in RGB:
            t = ex(f"t_{c}") - ex(f"i_{c}").cast("DOUBLE")
            t = least(t, 1.0) if extrapolate_below else clamp(t)
            first = at(f"l_{c}", f"i_{c}")
            out[c] = first + (at(f"l_{c}", f"i_{c} + 1") - first) * t if n > 1 else first
        return Op({**out, "a": "a"}, {**steps1, **tables}, index)

    def inverse(self, n: int | None = None) -> Lut1D:
        """The inverse of increasing tables, sampled at `n` places of their common range."""
        n = n or len(self.tables)
        x = np.linspace(self.low, self.high, len(self.tables))
        low, high = float(self.tables.min()), float(self.tables.max())
        at_ = np.linspace(low, high, n)
        return Lut1D(np.stack([np.interp(at_, t, x) for t in self.tables.T], axis=1), low, high)


#: Steps a side of a cube that is broadcast at most: 400 MB.
MOST_CUBE = 256


@dataclass(frozen=True)
class Lut3D:
    """A cube of colours, indexed [r, g, b]."""

    cube: np.ndarray  # (n, n, n, 3)
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @staticmethod
    def of(f, n: int) -> Lut3D:
        g = np.linspace(0, 1, n)
        return Lut3D(f(np.stack(np.meshgrid(g, g, g, indexing="ij"), axis=-1)))

    @property
    def size(self) -> int:
        return len(self.cube)

    def op(self, method: str = "trilinear") -> Op:
        """The cube as an expression."""
        n = self.size
        place = {f"t_{c}": clamp((ex(c) - lo) / (hi - lo)) * float(n - 1) for c, lo, hi in zip(RGB, self.low, self.high, strict=True)}
        table = {f"l_{c}": numbers(self.cube[..., k].ravel()) for k, c in enumerate(RGB)}
        index = {f"i_{c}": least(floor(f"t_{c}"), float(n - 2)).cast("INT") for c in RGB}
        part = {f"f_{c}": ex(f"t_{c}") - ex(f"i_{c}").cast("DOUBLE") for c in RGB}
        corner = lambda c, dr, dg, db: at(f"l_{c}", f"((i_r + {dr}) * {n} + i_g + {dg}) * {n} + i_b + {db}")
        if method == "nearest":
            near = {f"i_{c}": floor(ex(f"t_{c}") + 0.5).cast("INT") for c in RGB}
            return Op({**{c: corner(c, 0, 0, 0) for c in RGB}, "a": "a"}, {**place, **table}, near)
        mix = lambda p, q, f: p + (q - p) * ex(f)
        out = {}
        for c in RGB:
            if method == "trilinear":
                along_b = [[mix(corner(c, r, g, 0), corner(c, r, g, 1), "f_b") for g in (0, 1)] for r in (0, 1)]
                out[c] = mix(mix(*along_b[0], "f_g"), mix(*along_b[1], "f_g"), "f_r")
            else:
                out[c] = self._tetrahedral(c, corner)
        return Op({**out, "a": "a"}, {**place, **table}, index, part)

    @staticmethod
    def _tetrahedral(c, corner):
        """Walk from the low to the high corner along the axes by falling fraction."""
        cases = []
        for order in (("r", "g", "b"), ("r", "b", "g"), ("b", "r", "g"), ("b", "g", "r"), ("g", "b", "r"), ("g", "r", "b")):
            at_ = {"r": 0, "g": 0, "b": 0}
            before = corner(c, 0, 0, 0)
            total = before
            for axis in order:
                at_[axis] = 1
                here = corner(c, at_["r"], at_["g"], at_["b"])
                total = total + (here - before) * ex(f"f_{axis}")
                before = here
            a, b, d = (ex(f"f_{x}") for x in order)
            cases.append(((a >= b) & (b >= d), total))
        return when(*cases[:-1], cases[-1][1])

    def apply(self, rgb: np.ndarray, method: str = "trilinear") -> np.ndarray:
        """The same in numpy, for rows of colours."""
        n = self.size
        t = np.clip((rgb - self.low) / (np.array(self.high) - self.low), 0, 1) * (n - 1)
        i = np.minimum(np.floor(t).astype(np.int64), n - 2)
        f = t - i
        get = lambda dr, dg, db: self.cube[i[:, 0] + dr, i[:, 1] + dg, i[:, 2] + db]
        if method == "trilinear":
            out = 0.0
            for dr in (0, 1):
                for dg in (0, 1):
                    for db in (0, 1):
                        w = np.where(dr, f[:, 0], 1 - f[:, 0]) * np.where(dg, f[:, 1], 1 - f[:, 1]) * np.where(db, f[:, 2], 1 - f[:, 2])
                        out = out + w[:, None] * get(dr, dg, db)
            return out
        order = np.argsort(-f, axis=1, kind="stable")
        step = np.zeros_like(i)
        before = self.cube[tuple(i.T)]
        out = before.copy()
        rows = np.arange(len(i))
        for k in range(3):
            step[rows, order[:, k]] = 1
            here = self.cube[tuple((i + step).T)]
            out += (here - before) * f[rows, order[:, k]][:, None]
            before = here
        return out

    def frame(self, df: DataFrame, method: str = "trilinear") -> DataFrame:
        """`df` with its r, g and b looked up in Arrow batches; the cube is broadcast, if it isn't larger than MOST_CUBE a side."""
        if self.size > MOST_CUBE:
            raise ValueError(f"a cube of {self.size} steps is too large to broadcast")
        # Broadcast values are pickled by reference to their class, so only plain values go there.
        held = df.sparkSession.sparkContext.broadcast((self.cube, self.low, self.high))

        def run(batches):
            cube = Lut3D(*held.value)
            for batch in batches:
                rgb = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RGB], axis=1)
                out = cube.apply(rgb, method)
                columns = [pa.array(out[:, RGB.index(n)]) if n in RGB else batch.column(n) for n in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return df.mapInArrow(run, df.schema)

    def inverse(self, n: int | None = None, rounds: int = 20) -> Lut3D:
        """An approximate inverse on a grid, by damped fixed-point steps."""
        n = n or self.size
        g = np.linspace(0, 1, n)
        want = np.stack(np.meshgrid(g, g, g, indexing="ij"), axis=-1).reshape(-1, 3)
        x = want.copy()
        for _ in range(rounds):
            x = np.clip(x + 0.7 * (want - self.apply(x)), 0, 1)
        return Lut3D(x.reshape(n, n, n, 3))


# Text formats


def _rows(lines, width: int) -> np.ndarray:
    return np.array([[float(v) for v in line.split()[:width]] for line in lines]).reshape(-1, width)


def _numeric(line: str) -> bool:
    return bool(re.match(r"\s*[-+.\d]", line))


def _cube_of(rows: np.ndarray, blue_first: bool = False) -> np.ndarray:
    """Rows with red fastest (or blue fastest) as a cube [r, g, b]."""
    n = round(len(rows) ** (1 / 3))
    if n**3 != len(rows):
        raise ValueError("not a cube of rows")
    cube = rows.reshape(n, n, n, 3)
    return cube if blue_first else cube.transpose(2, 1, 0, 3)


def parse_cube(text: str) -> Lut1D | Lut3D:
    """.cube"""
    lines = [x.split("#")[0].strip() for x in text.splitlines()]
    head = {x.split()[0].upper(): x.split()[1:] for x in lines if x and not _numeric(x)}
    low = [float(v) for v in head.get("DOMAIN_MIN", ["0"] * 3)]
    high = [float(v) for v in head.get("DOMAIN_MAX", ["1"] * 3)]
    rows = _rows([x for x in lines if x and _numeric(x)], 3)
    if "LUT_1D_SIZE" in head:
        if len(rows) != int(head["LUT_1D_SIZE"][0]):
            raise ValueError("row count differs from the size")
        return Lut1D(rows, low[0], high[0])
    if len(rows) != int(head["LUT_3D_SIZE"][0]) ** 3:
        raise ValueError("row count differs from the size")
    return Lut3D(_cube_of(rows), tuple(low), tuple(high))


def write_cube(lut: Lut1D | Lut3D, title: str = "") -> str:
    head = [f'TITLE "{title}"'] if title else []
    if isinstance(lut, Lut1D):
        rows = np.repeat(lut.tables, 3, axis=1) if lut.tables.shape[1] == 1 else lut.tables
        head += [f"LUT_1D_SIZE {len(rows)}", f"DOMAIN_MIN {lut.low} {lut.low} {lut.low}", f"DOMAIN_MAX {lut.high} {lut.high} {lut.high}"]
    else:
        rows = lut.cube.transpose(2, 1, 0, 3).reshape(-1, 3)
        head += [f"LUT_3D_SIZE {lut.size}", "DOMAIN_MIN " + " ".join(map(str, lut.low)), "DOMAIN_MAX " + " ".join(map(str, lut.high))]
    return "\n".join([*head, *(" ".join(f"{v:.10g}" for v in row) for row in rows)]) + "\n"


def parse_spi1d(text: str) -> Lut1D:
    """.spi1d"""
    low, high = map(float, re.search(r"From\s+(\S+)\s+(\S+)", text).groups())
    width = int(re.search(r"Components\s+(\d+)", text)[1])
    body = text[text.index("{") + 1 : text.rindex("}")]
    return Lut1D(_rows([x for x in body.splitlines() if x.strip()], width), low, high)


def write_spi1d(lut: Lut1D) -> str:
    rows = "\n".join("    " + " ".join(f"{v:.10g}" for v in row) for row in lut.tables)
    return f"Version 1\nFrom {lut.low} {lut.high}\nLength {len(lut.tables)}\nComponents {lut.tables.shape[1]}\n{{\n{rows}\n}}\n"


def parse_spi3d(text: str) -> Lut3D:
    """.spi3d: each row names its place"""
    lines = [x for x in text.splitlines() if x.strip()]
    n = int(lines[2].split()[0])
    cube = np.zeros((n, n, n, 3))
    for line in lines[3:]:
        v = line.split()
        cube[int(v[0]), int(v[1]), int(v[2])] = [float(x) for x in v[3:6]]
    return Lut3D(cube)


def write_spi3d(lut: Lut3D) -> str:
    n = lut.size
    rows = [f"{r} {g} {b} " + " ".join(f"{v:.10g}" for v in lut.cube[r, g, b]) for r in range(n) for g in range(n) for b in range(n)]
    return "\n".join(["SPILUT 1.0", "3 3", f"{n} {n} {n}", *rows]) + "\n"


def parse_3dl(text: str) -> Lut3D:
    """.3dl: integer rows with blue fastest; a first line may hold the input steps, a line `Mesh` the bits of inputs and outputs.

    Without that line the least usual depth holds that fits the greatest value.
    """
    lines = [x.split() for x in text.splitlines() if x.strip() and _numeric(x)]
    rows = np.array([[float(v) for v in x] for x in lines if len(x) == 3])
    mesh = re.search(r"^\s*Mesh\s+(\d+)\s+(\d+)", text, re.M | re.I)
    top = rows.max()
    bits = int(mesh[2]) if mesh else next(b for b in (8, 10, 12, 16, 32) if top < 2**b)
    if top >= 2**bits:
        raise ValueError(f"a value beyond {bits} bits")
    return Lut3D(_cube_of(rows / (2**bits - 1), blue_first=True))


def parse_csp(text: str) -> Lut1D | Lut3D:
    """.csp whose shapers are straight lines onto [0, 1]; others are refused"""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    kind = lines[1].upper()
    i = 2
    if lines[i].upper().startswith("BEGIN METADATA"):
        while not lines[i].upper().startswith("END METADATA"):
            i += 1
        i += 1
    low, high = [], []
    for _ in range(3):
        xs, ys = ([float(v) for v in lines[i + k].split()] for k in (1, 2))
        straight = np.interp(xs, [xs[0], xs[-1]], [0.0, 1.0])
        if len(xs) != len(ys) or not np.allclose(ys, straight, atol=1e-6):
            raise ValueError("a shaper that bends")
        low.append(xs[0])
        high.append(xs[-1])
        i += 3
    if kind == "1D":
        return Lut1D(_rows(lines[i + 1 :], 3), low[0], high[0])
    return Lut3D(_cube_of(_rows(lines[i + 1 :], 3)), tuple(low), tuple(high))


def parse_itx(text: str) -> Lut3D:
    """.itx"""
    return Lut3D(_cube_of(_rows([x for x in text.splitlines() if x.strip() and _numeric(x)], 3)))


def parse_vf(text: str) -> Lut3D:
    """.vf: rows with blue fastest"""
    body = text[text.index("data") + 4 :]
    return Lut3D(_cube_of(_rows([x for x in body.splitlines() if x.strip() and _numeric(x)], 3), blue_first=True))


def parse_truelight(text: str) -> Lut3D:
    """.cub: the cube part"""
    body = text[re.search(r"#\s*Cube", text).end() :].split("# end")[0]
    return Lut3D(_cube_of(_rows([x for x in body.splitlines() if x.strip() and _numeric(x)], 3)))


def parse_1dl(text: str) -> Lut1D:
    """.1dl / .lut: `LUT: tables entries`, integer values of one table after another"""
    head = re.search(r"LUT:\s+(\d+)\s+(\d+)", text)
    values = np.array([float(x) for x in text[head.end() :].split() if _numeric(x)])
    tables = values.reshape(int(head[1]), int(head[2])).T
    bits = next(b for b in (8, 10, 12, 16, 32) if tables.max() < 2**b)
    return Lut1D(tables / (2**bits - 1))


def parse_m3d(text: str) -> Lut3D:
    """.mga / .m3d: rows of index and integer colours, blue fastest"""
    top = float(re.search(r"out\s*=?\s*(\d+)", text)[1]) - 1 if re.search(r"out\s*=?\s*(\d+)", text) else 4095.0
    rows = [x.split() for x in text.splitlines() if x.strip() and _numeric(x)]
    return Lut3D(_cube_of(np.array([[float(v) for v in x[1:4]] for x in rows if len(x) >= 4]) / top, blue_first=True))


def parse_hdl(text: str) -> Lut1D | Lut3D:
    """.lut (Houdini): a one-dimensional table `RGB`, or a cube `3D`, between braces"""
    low, high = map(float, re.search(r"From\s+(\S+)\s+(\S+)", text).groups())
    kind = re.search(r"Type\s+(\S+)", text)[1].upper()
    block = lambda name: [float(v) for v in re.search(rf"\b{name}\s*\{{([^}}]*)\}}", text)[1].split()]
    if "3D" in kind:
        values = np.array(block("3D")).reshape(-1, 3)
        return Lut3D(_cube_of(values), (low,) * 3, (high,) * 3)
    found = [c for c in ("R", "G", "B") if re.search(rf"\b{c}\s*\{{", text)]
    return Lut1D(np.array([block(c) for c in found]).T if found else np.array(block("RGB"))[:, None], low, high)


def parse_look(text: str) -> Lut3D:
    """.look: an XML element LUT of a size and little-endian floats in hexadecimal, red fastest"""
    root = ET.fromstring(text)
    node = next(e for e in root.iter() if _tag(e) == "LUT")
    n = int(next(e.text for e in node.iter() if _tag(e) == "size").strip("\"' "))
    data = "".join(next(e.text for e in node.iter() if _tag(e) == "data").split()).replace('"', "")
    return Lut3D(_cube_of(np.frombuffer(bytes.fromhex(data), "<f4").reshape(n**3, 3).astype(float)))


def parse_spimtx(text: str) -> tuple[np.ndarray, np.ndarray]:
    """.spimtx: a 3 x 3 matrix and offsets in 16-bit units"""
    m = np.array([float(v) for v in text.split()]).reshape(3, 4)
    return m[:, :3], m[:, 3] / 65535.0


def write_spimtx(m: np.ndarray, offset=(0, 0, 0)) -> str:
    return "\n".join(" ".join(f"{v:.10g}" for v in [*row, o * 65535.0]) for row, o in zip(np.asarray(m), offset, strict=True)) + "\n"


#: Parsers by file extension.
FORMATS = {
    "cube": parse_cube, "spi1d": parse_spi1d, "spi3d": parse_spi3d, "3dl": parse_3dl, "csp": parse_csp, "itx": parse_itx, "vf": parse_vf,
    "cub": parse_truelight, "1dl": parse_1dl, "m3d": parse_m3d, "mga": parse_m3d, "spimtx": parse_spimtx,
    "lut": parse_hdl, "look": parse_look,
}


def parse(text: str, extension: str):
    return FORMATS[extension.lower().lstrip(".")](text)


@dataclass
class Cdl:
    """A colour decision: slope, offset, power and saturation."""

    slope: tuple = (1.0, 1.0, 1.0)
    offset: tuple = (0.0, 0.0, 0.0)
    power: tuple = (1.0, 1.0, 1.0)
    saturation: float = 1.0
    name: str = ""
    notes: list[str] = field(default_factory=list)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def parse_cdl(xml: str) -> list[Cdl]:
    """.cc, .ccc and .cdl: every ColorCorrection in the document."""
    out = []
    for e in ET.fromstring(xml).iter():
        if _tag(e) != "ColorCorrection":
            continue
        c = Cdl(name=e.get("id", ""))
        for v in e.iter():
            kind, text = _tag(v), (v.text or "").split()
            if kind in ("Slope", "Offset", "Power"):
                setattr(c, kind.lower(), tuple(float(x) for x in text))
            elif kind == "Saturation":
                c.saturation = float(text[0])
            elif kind == "Description" and v.text:
                c.notes.append(v.text)
        out.append(c)
    return out


def write_cdl(corrections: list[Cdl]) -> str:
    body = "".join(
        f'<ColorCorrection id="{c.name}"><SOPNode>' + "".join(f"<{k}>{' '.join(map(repr, v))}</{k}>" for k, v in (("Slope", c.slope), ("Offset", c.offset), ("Power", c.power)))
        + f"</SOPNode><SatNode><Saturation>{c.saturation!r}</Saturation></SatNode></ColorCorrection>"
        for c in corrections
    )
    return f'<ColorCorrectionCollection xmlns="urn:ASC:CDL:v1.01">{body}</ColorCorrectionCollection>'


_DEPTHS = {"8i": 255.0, "10i": 1023.0, "12i": 4095.0, "16i": 65535.0}


def parse_clf(xml: str) -> list[tuple[str, object]]:
    """A process list (.clf, .ctf) as (kind, value): matrix, lut1d, lut3d, range, cdl, exponent or log nodes in order."""
    out: list[tuple[str, object]] = []
    for node in ET.fromstring(xml):
        kind = _tag(node)
        scale_in, scale_out = (_DEPTHS.get(node.get(k, ""), 1.0) for k in ("inBitDepth", "outBitDepth"))
        array = next((x for x in node if _tag(x) == "Array"), None)
        values = np.array([float(v) for v in array.text.split()]) if array is not None else None
        dims = [int(v) for v in array.get("dim").split()] if array is not None else []
        if kind == "Matrix":
            m = values.reshape(dims[0], dims[1]) * (scale_in / scale_out)
            out.append(("matrix", (m[:3, :3], m[:3, 3] / scale_out if m.shape[1] > 3 else np.zeros(3))))
        elif kind == "LUT1D":
            out.append(("lut1d", Lut1D(values.reshape(dims[0], dims[1]) / scale_out)))
        elif kind == "LUT3D":
            out.append(("lut3d", Lut3D(values.reshape(dims[0], dims[1], dims[2], 3) / scale_out)))
        elif kind == "Range":
            get = lambda n, k: next((float(x.text) / k for x in node if _tag(x) == n), None)  # noqa: B023, E731
            out.append(("range", (get("minInValue", scale_in), get("maxInValue", scale_in), get("minOutValue", scale_out), get("maxOutValue", scale_out), node.get("style") != "noClamp")))
        elif kind == "ASC_CDL":
            wrapped = f"<r><ColorCorrection>{''.join(ET.tostring(x, encoding='unicode') for x in node)}</ColorCorrection></r>"
            out.append(("cdl", (parse_cdl(wrapped)[0], node.get("style", "Fwd"))))
        elif kind in ("Exponent", "Gamma"):
            p = next(x for x in node if _tag(x) in ("ExponentParams", "GammaParams"))
            out.append(("exponent", (node.get("style", "basicFwd"), {k: float(v) for k, v in p.attrib.items() if k != "channel"})))
        elif kind == "Log":
            p = next((x for x in node if _tag(x) == "LogParams"), None)
            out.append(("log", (node.get("style"), {k: float(v) for k, v in p.attrib.items() if k != "channel"} if p is not None else {})))
    return out


def write_clf(nodes: list[tuple[str, object]], name: str = "list") -> str:
    """A process list (.clf) of nodes as `parse_clf` gives them, values as floats."""
    out = []
    rows = lambda a: "\n".join(" ".join(f"{v:.10g}" for v in row) for row in np.asarray(a, float).reshape(-1, np.shape(a)[-1]))
    attributes = lambda p: "".join(f' {k}="{v!r}"' for k, v in p.items())
    for i, (kind, value) in enumerate(nodes):
        tag = f'id="n{i}" inBitDepth="32f" outBitDepth="32f"'
        if kind == "matrix":
            m = np.column_stack([value[0], value[1]])
            out.append(f'<Matrix {tag}><Array dim="3 4 3">\n{rows(m)}\n</Array></Matrix>')
        elif kind == "lut1d":
            n, width = value.tables.shape
            out.append(f'<LUT1D {tag}><Array dim="{n} {width}">\n{rows(value.tables)}\n</Array></LUT1D>')
        elif kind == "lut3d":
            out.append(f'<LUT3D {tag}><Array dim="{value.size} {value.size} {value.size} 3">\n{rows(value.cube.reshape(-1, 3))}\n</Array></LUT3D>')
        elif kind == "range":
            names = ("minInValue", "maxInValue", "minOutValue", "maxOutValue")
            body = "".join(f"<{k}>{v!r}</{k}>" for k, v in zip(names, value[:4], strict=True) if v is not None)
            out.append(f'<Range {tag} style="{"clamp" if value[4] else "noClamp"}">{body}</Range>')
        elif kind == "cdl":
            c, style = value
            sop = "".join(f"<{k}>{' '.join(map(repr, v))}</{k}>" for k, v in (("Slope", c.slope), ("Offset", c.offset), ("Power", c.power)))
            out.append(f'<ASC_CDL {tag} style="{style}"><SOPNode>{sop}</SOPNode><SatNode><Saturation>{c.saturation!r}</Saturation></SatNode></ASC_CDL>')
        elif kind == "exponent":
            out.append(f'<Exponent {tag} style="{value[0]}"><ExponentParams{attributes(value[1])}/></Exponent>')
        elif kind == "log":
            params = f"<LogParams{attributes(value[1])}/>" if value[1] else ""
            out.append(f'<Log {tag} style="{value[0]}">{params}</Log>')
        else:
            raise ValueError(kind)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<ProcessList id="{name}" compCLFversion="3">\n' + "\n".join(out) + "\n</ProcessList>\n"


def identity3d(n: int) -> Lut3D:
    return Lut3D.of(lambda c: c, n)
