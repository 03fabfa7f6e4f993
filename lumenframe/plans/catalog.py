"""A catalogue of colour spaces: roles, displays and views, looks, file rules, context variables.

The catalogue lives on the driver (its size is that of a configuration file). Asking
it for a conversion gives a chain of transforms; nothing here touches pixels.
"""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import aces2, color, curves, gamut, lut
from . import ir
from .builtins import Missing, builtin


@dataclass
class Space:
    """A colour space; one of the transforms to and from the reference may be missing and is then inverted."""

    name: str
    to_reference: list | None = None
    from_reference: list | None = None
    aliases: tuple = ()
    family: str = ""
    encoding: str = ""
    categories: tuple = ()
    is_data: bool = False
    #: Whether its reference is the display's (XYZ under D65), not the scene's.
    display: bool = False


@dataclass
class Look:
    name: str
    process_space: str
    forward: list


@dataclass
class View:
    name: str
    space: str
    looks: str = ""
    #: The transform from the scene's to the display's reference; none where the space is seen as it is.
    transform: str = ""


@dataclass
class FileRule:
    """A space for paths that match a glob and extension, or a regular expression."""

    name: str
    space: str
    pattern: str = "*"
    extension: str = "*"
    regex: str | None = None

    def expression(self) -> str:
        if self.regex is not None:
            return self.regex
        body = fnmatch.translate(f"{self.pattern}.{self.extension}")
        return "(?i)^" + re.sub(r"^\(\?s:(.*)\)\\(?:Z|z)$", r"\1", body) + "$"


@dataclass
class Catalog:
    spaces: dict[str, Space] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    displays: dict[str, list[View]] = field(default_factory=dict)
    looks: dict[str, Look] = field(default_factory=dict)
    named: dict[str, list] = field(default_factory=dict)
    rules: list[FileRule] = field(default_factory=list)
    default_space: str = ""
    search_path: list[str] = field(default_factory=list)
    variables: dict[str, str] = field(default_factory=dict)
    active: tuple = ()
    inactive: tuple = ()
    #: From the scene's reference to the display's, by name; the first serves conversions without a view.
    view_transforms: dict[str, list] = field(default_factory=dict)
    name: str = ""

    def add(self, space: Space) -> None:
        self.spaces[space.name] = space

    def space(self, name: str) -> Space:
        """By name, alias or role, without regard to case."""
        wanted = name.lower()
        for s in self.spaces.values():
            if wanted in (s.name.lower(), *(a.lower() for a in s.aliases)):
                return s
        for role, target in self.roles.items():
            if role.lower() == wanted and target.lower() != wanted:
                return self.space(target)
        raise Missing(name)

    def conversion(self, source: str, target: str) -> list:
        """From one space to another through the reference; data spaces pass unchanged."""
        a, b = self.space(source), self.space(target)
        if a is b or a.is_data or b.is_data:
            return []
        between: list = []
        if a.display != b.display:
            between = self.viewing() if b.display else [ir.Chain(tuple(self.viewing())).inverse()]
        return [*self._to(a), *between, *self._from(b)]

    def viewing(self, name: str = "") -> list:
        """A view transform; without a name the one that changes colours least, or the first."""
        if name:
            if name not in self.view_transforms:
                raise Missing(name)
            return self.view_transforms[name]
        plain = [n for n in self.view_transforms if re.search(r"un-?tone-?mapped|colorimetric", n, re.I)]
        return self.view_transforms[(plain or list(self.view_transforms))[0]] if self.view_transforms else []

    @staticmethod
    def _to(s: Space) -> list:
        if s.to_reference is not None:
            return s.to_reference
        return [ir.Chain(tuple(s.from_reference)).inverse()] if s.from_reference is not None else []

    @staticmethod
    def _from(s: Space) -> list:
        if s.from_reference is not None:
            return s.from_reference
        return [ir.Chain(tuple(s.to_reference)).inverse()] if s.to_reference is not None else []

    def _looked(self, source: str, looks: str) -> list:
        """From a space through looks to the scene's reference."""
        out, now = self._through(source, looks)
        return [*out, *self._to(self.space(now))]

    def with_looks(self, source: str, target: str, looks: str) -> list:
        """A conversion with looks between; `-name` applies one backwards."""
        out, now = self._through(source, looks)
        return [*out, *self.conversion(now, target)]

    def _through(self, source: str, looks: str) -> tuple[list, str]:
        out, now = [], source
        for name, forward in parsed_looks(looks):
            if name not in self.looks:
                raise Missing(name)
            look = self.looks[name]
            out += self.conversion(now, look.process_space)
            out += look.forward if forward else [ir.Chain(tuple(look.forward)).inverse()]
            now = look.process_space
        return out, now

    def display(self, source: str, display: str, view: str) -> list:
        for v in self.displays.get(display, []):
            if v.name != view:
                continue
            space = display if v.space == "<USE_DISPLAY_NAME>" else v.space
            if not v.transform:
                return self.with_looks(source, space, v.looks)
            target = self.space(space)
            scene = [*self._looked(source, v.looks), *self.viewing(v.transform)]
            return [*scene, *self._from(target)]
        raise Missing(f"{display}/{view}")

    def resolve(self, text: str, strict: bool = False) -> str:
        """`$NAME` and `${NAME}` replaced, from the catalogue and then the environment; unknown ones stay."""

        def one(m):
            name = m[1] or m[2]
            value = self.variables.get(name, os.environ.get(name))
            if value is None:
                if strict:
                    raise Missing(name)
                return m[0]
            return value

        return re.sub(r"\$\{(\w+)\}|\$(\w+)", one, text)

    def space_of_path(self, path: Column) -> Column:
        """The space that the first matching rule gives a path."""
        out = None
        for rule in self.rules:
            hit = path.rlike(rule.expression())
            out = F.when(hit, F.lit(rule.space)) if out is None else out.when(hit, F.lit(rule.space))
        return out.otherwise(F.lit(self.default_space)) if out is not None else F.lit(self.default_space)

    def by(self, **wanted) -> list[str]:
        """Names of spaces with a category, family or encoding."""
        fits = lambda s: all(v in s.categories if k == "category" else getattr(s, k) == v for k, v in wanted.items())
        return [s.name for s in self.spaces.values() if fits(s)]

    def active_spaces(self) -> list[str]:
        chosen = self.active or tuple(self.spaces)
        return [n for n in chosen if n in self.spaces and n not in self.inactive]

    def equivalent(self, one: str, other: str) -> bool:
        try:
            return self.space(one) is self.space(other) or not ir.optimized(self.conversion(one, other))
        except Missing:
            return one.lower() == other.lower()

    def issues(self) -> list[tuple[str, str]]:
        """(severity, message) of what is wrong with the catalogue."""
        out = []
        known = lambda n: self._known(n)
        for role, target in self.roles.items():
            if not known(target):
                out.append(("error", f"role {role} names unknown space {target}"))
        for role in ("scene_linear", "default"):
            if role not in self.roles:
                out.append(("warning", f"role {role} is missing"))
        for display, views in self.displays.items():
            if not views:
                out.append(("warning", f"display {display} has no views"))
            for v in views:
                if v.transform and v.transform not in self.view_transforms:
                    out.append(("error", f"view {display}/{v.name} names unknown view transform {v.transform}"))
                if not known(display if v.space == "<USE_DISPLAY_NAME>" else v.space):
                    out.append(("error", f"view {display}/{v.name} names unknown space {v.space}"))
                out += [("error", f"view {display}/{v.name} names unknown look {n}") for n, _ in parsed_looks(v.looks) if n not in self.looks]
        for look in self.looks.values():
            if not known(look.process_space):
                out.append(("error", f"look {look.name} names unknown space {look.process_space}"))
        for rule in self.rules:
            if not known(rule.space):
                out.append(("error", f"file rule {rule.name} names unknown space {rule.space}"))
        seen: dict[str, str] = {}
        for s in self.spaces.values():
            for alias in (s.name, *s.aliases):
                if alias.lower() in seen:
                    out.append(("error", f"name {alias} belongs to {seen[alias.lower()]} and {s.name}"))
                seen[alias.lower()] = s.name
        return out

    def _known(self, name: str) -> bool:
        try:
            self.space(name)
        except Missing:
            return False
        return True


def parsed_looks(text: str) -> list[tuple[str, bool]]:
    """`+one, -two` as (name, forward)."""
    parts = [p.strip() for p in re.split(r"[,:]", text) if p.strip()]
    return [(p.lstrip("+-").strip(), not p.startswith("-")) for p in parts]


class Processors:
    """Optimised chains by (source, target, looks)."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.held, self.hits = catalog, {}, 0

    def get(self, source: str, target: str, looks: str = "") -> list:
        key = (source, target, looks)
        if key in self.held:
            self.hits += 1
        else:
            self.held[key] = ir.optimized(self.catalog.with_looks(source, target, looks))
        return self.held[key]


# A text form: the YAML subset of colour configurations


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return re.sub(r"\\(.)", r"\1", text[1:-1]) if text[0] == '"' else text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return float(text)
    except ValueError:
        return text


def _flow(text: str):
    """A flow value: [..], {..} or a scalar; tags become key `!`."""
    value, rest = _flow_at(text.strip())
    if rest.strip():
        raise ValueError(f"can't read {text!r}")
    return value


def _flow_at(text: str):
    text = text.lstrip()
    if m := re.match(r"!<(\w+)>\s*", text):
        value, rest = _flow_at(text[m.end() :])
        return {"!": m[1], **(value if isinstance(value, dict) else {"values": value})}, rest
    if text.startswith("["):
        out, rest = [], text[1:].lstrip()
        while not rest.startswith("]"):
            value, rest = _flow_at(rest)
            out.append(value)
            rest = rest.lstrip().removeprefix(",").lstrip()
        return out, rest[1:]
    if text.startswith("{"):
        found, rest = {}, text[1:].lstrip()
        while not rest.startswith("}"):
            key, rest = re.match(r"\s*([\w \-/.]+?)\s*:\s*(.*)", rest, re.S).groups()
            found[key], rest = _flow_at(rest)
            rest = rest.lstrip().removeprefix(",").lstrip()
        return found, rest[1:]
    m = re.match(r'"(?:[^"\\]|\\.)*"|\'[^\']*\'|[^,\]\}]*', text)
    return _scalar(m[0]), text[m.end() :]


def _unclosed(text: str) -> bool:
    bare = re.sub(r'"(?:[^"\\]|\\.)*"|\'[^\']*\'', "", text)
    return bare.count("{") + bare.count("[") > bare.count("}") + bare.count("]")


def parse_yaml(text: str):
    """Nested maps and lists by indentation, flow values, texts of several lines and `!<Tag>`s."""
    lines: list[tuple[int, str]] = []
    raw, i = text.splitlines(), 0
    while i < len(raw):
        body = re.sub(r"(^|\s)#[^\"']*$", "", raw[i]).rstrip()
        indent = len(body) - len(body.lstrip())
        i += 1
        if re.search(r":\s+[|>][+-]?$", body):
            told = []
            while i < len(raw) and (not raw[i].strip() or len(raw[i]) - len(raw[i].lstrip()) > indent):
                told.append(raw[i].strip())
                i += 1
            whole = "\n".join(told).strip().replace("\\", "\\\\").replace('"', '\\"')
            body = body[: body.rindex(":") + 1] + f' "{whole}"'
        if body.strip() and body.strip() != "---":
            lines.append((indent, body.strip()))
    # Flow values may go over several lines.
    merged: list[tuple[int, str]] = []
    for indent, body in lines:
        if merged and _unclosed(merged[-1][1]):
            merged[-1] = (merged[-1][0], f"{merged[-1][1]} {body}")
        else:
            merged.append((indent, body))
    value, at = _block(merged, 0, merged[0][0]) if merged else ({}, 0)
    if at != len(merged):
        raise ValueError(f"can't read {merged[at][1]!r}")
    return value


def _value(rest: str):
    """A value that stands behind a key: flow, quoted or plain to the end of the line."""
    return _flow(rest) if rest[0] in "[{\"'!" else _scalar(rest)


def _block(lines, at: int, indent: int):
    if lines[at][1].startswith(("{", "[")):
        return _flow(lines[at][1]), at + 1
    if lines[at][1].startswith("- ") or lines[at][1] == "-":
        out: list = []
        while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
            body = lines[at][1][1:].strip()
            tag = re.match(r"!<(\w+)>\s*", body)
            rest = body[tag.end() :] if tag else body
            if rest.startswith(("{", "[")) or (rest and not re.match(r"[\w \-/.]+:(\s|$)", rest)):
                value = _value(rest)
                at += 1
            elif rest:
                inner = indent + len(lines[at][1]) - len(rest)
                value, at = _block([*lines[:at], (inner, rest), *lines[at + 1 :]], at, inner)
            elif at + 1 < len(lines) and lines[at + 1][0] > indent:
                value, at = _block(lines, at + 1, lines[at + 1][0])
            else:
                value, at = {}, at + 1
            out.append({"!": tag[1], **(value if isinstance(value, dict) else {"values": value})} if tag else value)
        return out, at
    found: dict = {}
    while at < len(lines) and lines[at][0] == indent:
        m = re.match(r"(\"[^\"]*\"|.+?)(:)(?:\s+(.*)|$)", lines[at][1], re.S)
        if m is None:
            raise ValueError(f"can't read {lines[at][1]!r}")
        key, rest = m[1], m[3] or ""
        key, rest = _scalar(key), rest.strip()
        tag = re.match(r"!<(\w+)>\s*", rest)
        rest = rest[tag.end() :] if tag else rest
        if rest:
            value, at = _value(rest), at + 1
        elif at + 1 < len(lines) and (lines[at + 1][0] > indent or (lines[at + 1][0] == indent and lines[at + 1][1].startswith("-"))):
            value, at = _block(lines, at + 1, lines[at + 1][0])
        else:
            value, at = None, at + 1
        found[key] = {"!": tag[1], **(value or {})} if tag else value
    return found, at


def _numbers(v, n: int = 3) -> tuple:
    return tuple(float(x) for x in v[:n]) if isinstance(v, list) else (float(v),) * n


def _either(node: dict, one: str, default):
    """A parameter under its name with underscores or in camel case."""
    camel = re.sub(r"_(\w)", lambda m: m[1].upper(), one)
    return node.get(one, node.get(camel, default))


def _points(value) -> list[tuple[float, float]] | None:
    """Control points: a list of pairs, or of numbers in turn, or a map with them."""
    if isinstance(value, dict):
        value = value.get("control_points") or value.get("points")
    if not value:
        return None
    if isinstance(value[0], list):
        return [(float(x), float(y)) for x, y in value]
    return [(float(x), float(y)) for x, y in zip(value[::2], value[1::2], strict=True)]


def _mixed(node, neutral: float, multiply: bool) -> tuple:
    """Red, green and blue, joined with the master's value."""
    if not isinstance(node, dict):
        return (neutral,) * 3 if node is None else _numbers(node)
    rgb, master = _numbers(node.get("rgb", neutral)), float(node.get("master", neutral))
    return tuple(v * master if multiply else v + master for v in rgb)


def _primary(node: dict) -> ir.Made:
    get = node.get
    if "style" not in node and not isinstance(get("contrast"), dict):
        kw = {
            "lift": _numbers(get("lift", 0.0)), "gamma": _numbers(get("gamma", 1.0)), "gain": _numbers(get("gain", 1.0)), "offset": float(get("offset", 0.0)),
            "exposure": float(get("exposure", 0.0)), "contrast": float(get("contrast", 1.0)), "saturation": float(get("saturation", 1.0)),
            "pivot": float(get("pivot", 0.18)), "low": get("clamp_black"), "high": get("clamp_white"),
        }
        return ir.Made("primary", (tuple(kw.items()),))
    style = get("style", "log")
    kw = {
        "brightness": _mixed(get("brightness"), 0.0, False), "contrast": _mixed(get("contrast"), 1.0, True), "gamma": _mixed(get("gamma"), 1.0, True),
        "offset": _mixed(get("offset"), 0.0, False), "exposure": _mixed(get("exposure"), 0.0, False), "lift": _mixed(get("lift"), 0.0, False),
        "gain": _mixed(get("gain"), 1.0, True), "saturation": float(get("saturation", 1.0)),
    }
    pivot, clamp = get("pivot") or {}, get("clamp") or {}
    if "contrast" in pivot:
        kw["pivot"] = float(pivot["contrast"])
    kw |= {k: float(pivot[k]) for k in ("black", "white") if k in pivot}
    kw |= {k: float(clamp[c]) for k, c in (("low", "black"), ("high", "white")) if c in clamp}
    return ir.Made("styled_primary", ({"linear": "linear", "log": "log", "video": "video"}[style], tuple(kw.items())))


def _tone(node: dict) -> ir.Made:
    get = node.get
    if "style" not in node:
        four = lambda k, d: _numbers(get(k, [d] * 4), 4)
        kw = {k: four(k, 1.0) for k in ("shadows", "midtones", "highlights", "whites")} | {"blacks": four("blacks", 0.0)}
        kw |= {"shadow": (float(get("shadow_start", 0.0)), float(get("shadow_pivot", 0.09))), "highlight": (float(get("highlight_start", 0.5)), float(get("highlight_pivot", 0.89)))}
        return ir.Made("basic_tone", (tuple(kw.items()),))
    zones = {}
    for zone in ("blacks", "shadows", "midtones", "highlights", "whites"):
        if isinstance(get(zone), dict):
            v = get(zone)
            first, second = (v.get("start", v.get("center")), v.get("width", v.get("pivot")))
            zones[zone] = curves.Zone((*_numbers(v.get("rgb", 1.0)), float(v.get("master", 1.0))), float(first), float(second))
    if "s_contrast" in node:
        zones["s_contrast"] = float(get("s_contrast"))
    return ir.Made("tone_zones", (get("style"), tuple(zones.items())))


def _table(node: dict) -> ir.Table:
    """An inline table: a cube's values with red slowest, or a curve's values (all channels, or red, green and blue in turn)."""
    values = [float(v) for v in (node.get("values") or [])]
    if node["!"] == "Lut3DTransform":
        n = int(node.get("gridSize", 2))
        found = lut.Lut3D(np.array(values).reshape(n, n, n, 3)) if values else lut.identity3d(n)
        return ir.Table(found, "tetrahedral" if node.get("interpolation") == "tetrahedral" else "trilinear")
    n = int(node.get("length", 2))
    if not values:
        values = np.linspace(0, 1, n).tolist()
    rows = np.array(values).reshape(-1, 3) if len(values) == 3 * n and n > 1 and "length" in node else np.repeat(np.array(values)[:, None], 3, axis=1)
    return ir.Table(lut.Lut1D(rows))


def transform(node: dict, catalog: Catalog | None = None, files=None) -> list:
    """A transform of a configuration as a chain. `files` reads a look-up file's text by name."""
    kind, get = node["!"], node.get
    if kind == "GroupTransform":
        out = [t for child in get("children", []) for t in transform(child, catalog, files)]
    elif kind == "MatrixTransform":
        m, offset = np.array(get("matrix", np.eye(4).ravel()), float).reshape(4, 4), np.array(get("offset", (0, 0, 0, 0)), float)
        alone = np.allclose(m[3], (0, 0, 0, 1)) and np.allclose(m[:3, 3], 0) and offset[3] == 0
        out = [ir.Matrix(m[:3, :3], tuple(offset[:3]))] if alone else [ir.Made("matrix4", (tuple(map(tuple, m.tolist())), tuple(offset.tolist())))]
    elif kind == "ExponentTransform":
        negative = {"clamp": "clamp", "mirror": "mirror", "pass_thru": "pass"}[get("style", "clamp")]
        out = [ir.Exponent(_numbers(get("value", 1.0)), negative)]
    elif kind == "ExponentWithLinearTransform":
        out = [ir.Made("exponent_with_linear", (_numbers(get("gamma", 1.0)), _numbers(get("offset", 0.0)), get("style") == "mirror"))]
    elif kind == "LogTransform":
        out = [ir.LogAffine(get("base", 2.0))]
    elif kind in ("LogAffineTransform", "LogCameraTransform"):
        names = (("log_side_slope", 1.0), ("log_side_offset", 0.0), ("lin_side_slope", 1.0), ("lin_side_offset", 0.0))
        p = [_numbers(_either(node, name, default)) for name, default in names]
        if kind == "LogCameraTransform":
            out = [ir.Made("log_camera", (float(get("base", 2.0)), *p, _numbers(_either(node, "lin_side_break", 0.0))))]
        elif all(len(set(v)) == 1 for v in p):
            out = [ir.LogAffine(get("base", 2.0), *(v[0] for v in p))]
        else:
            out = [ir.Made("log_affine", (float(get("base", 2.0)), *p))]
    elif kind == "CDLTransform":
        out = [ir.Cdl(_numbers(get("slope", 1.0)), _numbers(get("offset", 0.0)), _numbers(get("power", 1.0)), get("sat", get("saturation", 1.0)), get("style", "noclamp"))]
    elif kind == "RangeTransform":
        low_in, high_in = _either(node, "min_in_value", 0.0), _either(node, "max_in_value", 1.0)
        out = [ir.Range(low_in, high_in, _either(node, "min_out_value", low_in), _either(node, "max_out_value", high_in), get("style", "Clamp").lower() != "noclamp")]
    elif kind == "ExposureContrastTransform":
        out = [ir.ExposureContrast(get("style", "linear"), get("exposure", 0.0), get("contrast", 1.0), get("gamma", 1.0), get("pivot", 0.18))]
    elif kind == "FixedFunctionTransform":
        out = [_fixed(node)]
    elif kind == "GradingPrimaryTransform":
        out = [_primary(node)]
    elif kind == "GradingToneTransform":
        out = [_tone(node)]
    elif kind == "GradingRGBCurveTransform":
        found = {k: curves.fitted(p) for k in ("red", "green", "blue", "master") if (p := _points(get(k)))}
        out = [ir.Made("rgb_curves", (tuple(found.items()),))]
    elif kind == "GradingHueCurveTransform":
        found = {k: curves.periodic(p, k == "hue_hue") if k.startswith("hue_") else curves.fitted(p) for k in HUE_CURVES if (p := _points(get(k)))}
        out = [ir.Made("hue_curves", ({"linear": "lin", "video": "vid"}.get(get("style"), "log"), tuple(found.items())))]
    elif kind == "AllocationTransform":
        p = get("vars") or [0.0, 1.0]
        log = str(get("allocation", "uniform")).lower() in ("lg2", "log2")
        out = [ir.Made("allocation", ("log2" if log else "uniform", float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else None))]
    elif kind in ("Lut1DTransform", "Lut3DTransform"):
        out = [_table(node)]
    elif kind == "BuiltinTransform":
        out = builtin(get("style"))
    elif kind == "FileTransform":
        name = catalog.resolve(get("src")) if catalog else get("src")
        out = from_file(name, files(name))
    elif kind == "ColorSpaceTransform":
        out = [Later(catalog, "conversion", (get("src"), get("dst")))] if catalog else []
    elif kind == "LookTransform":
        out = [Later(catalog, "with_looks", (get("src"), get("dst"), get("looks", "")))]
    elif kind == "DisplayViewTransform":
        out = [Later(catalog, "display", (get("src"), get("display"), get("view")))]
    else:
        raise Missing(kind)
    return [ir.Chain(tuple(out)).inverse()] if get("direction") == "inverse" else out


#: Curves of a hue transform. Fixed values.
HUE_CURVES = ("hue_hue", "hue_sat", "hue_lum", "lum_sat", "sat_sat", "lum_lum", "sat_lum", "hue_fx")


def _fixed(node: dict):
    style, p = str(node.get("style")), [float(v) for v in (node.get("params") or [])]
    plain = style.lower().replace("_", "").replace("-", "")
    if plain == "rec2100surround":
        return ir.Made("surround", (p[0] if p else color.DIM_GAMMA,))
    if plain in ("lintogammalog", "gammalogtolin", "lintodoublelog", "doublelogtolin"):
        return ir.Made("logs", ("gamma" if "gamma" in plain else "double", tuple(p)), not plain.startswith("lin"))
    if plain == "acesoutputtransform20":
        # Peak luminance, and the chromaticities of the limiting gamut's primaries and white.
        return _aces2(aces2.output_transform, p)
    if plain in ("acestonescalecompress20", "acesgamutcompress20"):
        return _aces2(lambda *how: [(aces2.tone_scaled if "tone" in plain else aces2.gamut_fitted)(*how)], p)
    try:
        return ir.Fixed(ir.fixed(style))
    except KeyError as e:
        raise Missing(style) from e


def _aces2(make, p: list[float]) -> ir.Ready:
    peak, limit = (p[0] if p else 100.0), "rec709"
    if len(p) >= 9:
        given = np.array(p[1:9]).reshape(4, 2)
        near = lambda g: np.abs(np.array([*g[:3], gamut.WHITES[g[3]]]) - given).max()
        limit = min(gamut.GAMUTS, key=lambda name: near(gamut.GAMUTS[name]))
        if near(gamut.GAMUTS[limit]) > 1e-3:
            raise Missing("a limiting gamut of other primaries")
    return ir.Ready(make(peak, limit)[0], make(peak, limit, True)[0])


@dataclass(frozen=True, eq=False)
class Later:
    """A conversion of the catalogue that is looked up when it is needed, so that spaces may be named before they are defined."""

    catalog: Catalog
    how: str
    names: tuple
    backward: bool = False

    @property
    def parts(self) -> tuple:
        found = tuple(getattr(self.catalog, self.how)(*self.names))
        return (ir.Chain(found).inverse(),) if self.backward else found

    def inverse(self) -> Later:
        return Later(self.catalog, self.how, self.names, not self.backward)


def from_file(name: str, text: str) -> list:
    """The chain of a look-up or correction file."""
    extension = name.rsplit(".", 1)[-1].lower()
    if extension in ("cc", "ccc", "cdl"):
        c = lut.parse_cdl(text)[0]
        return [ir.Cdl(c.slope, c.offset, c.power, c.saturation)]
    if extension in ("clf", "ctf"):
        return [t for node in lut.parse_clf(text) for t in _clf_node(*node)]
    found = lut.parse(text, extension)
    return [ir.Matrix(found[0], tuple(found[1]))] if extension == "spimtx" else [ir.Table(found)]


def _clf_node(kind: str, value) -> list:
    if kind == "matrix":
        return [ir.Matrix(value[0], tuple(value[1]))]
    if kind in ("lut1d", "lut3d"):
        return [ir.Table(value)]
    if kind == "range":
        low_in, high_in, low_out, high_out, clamp = value
        return [ir.Range(low_in or 0.0, 1.0 if high_in is None else high_in, low_out or 0.0, 1.0 if high_out is None else high_out, clamp)]
    if kind == "cdl":
        c, style = value
        t = ir.Cdl(c.slope, c.offset, c.power, c.saturation, "noclamp" if "NoClamp" in style else "asc")
        return [t.inverse() if "Rev" in style else t]
    if kind == "exponent":
        style, p = value
        e = p.get("exponent", p.get("gamma", 1.0))
        return [ir.Exponent(((1 / e) if "Rev" in style else e,) * 3, "mirror" if "Mirror" in style else "clamp")]
    style, p = value
    base = {"log10": 10.0, "antiLog10": 10.0}.get(style, p.get("base", 2.0))
    t = ir.LogAffine(base, p.get("logSideSlope", 1.0), p.get("logSideOffset", 0.0), p.get("linSideSlope", 1.0), p.get("linSideOffset", 0.0))
    return [t.inverse() if "anti" in style or "logToLin" in style or "LogToLin" in style else t]


def load(text: str, files=None) -> Catalog:
    """A catalogue from the text of a configuration."""
    data = parse_yaml(text)
    out = Catalog(roles={k: str(v) for k, v in (data.get("roles") or {}).items()}, variables={k: str(v) for k, v in (data.get("environment") or {}).items()}, name=str(data.get("name") or ""))
    path = data.get("search_path") or []
    out.search_path = path if isinstance(path, list) else str(path).split(":")

    def chain(node: dict, *keys) -> list | None:
        return next((transform(node[k], out, files) for k in keys if node.get(k)), None)

    for node in [*(data.get("colorspaces") or []), *(data.get("display_colorspaces") or [])]:
        display = bool(node.get("to_display_reference") or node.get("from_display_reference")) or node in (data.get("display_colorspaces") or [])
        out.add(Space(
            node["name"], chain(node, "to_reference", "to_scene_reference", "to_display_reference"), chain(node, "from_reference", "from_scene_reference", "from_display_reference"),
            tuple(node.get("aliases") or ()), node.get("family") or "", node.get("encoding") or "", tuple(node.get("categories") or ()), bool(node.get("isdata")), display,
        ))
    for node in data.get("view_transforms") or []:
        forward = chain(node, "from_scene_reference", "from_reference")
        back = chain(node, "to_scene_reference", "to_reference")
        out.view_transforms[node["name"]] = forward if forward is not None else [ir.Chain(tuple(back)).inverse()] if back else []
    for node in data.get("looks") or []:
        forward, back = chain(node, "transform"), chain(node, "inverse_transform")
        out.looks[node["name"]] = Look(node["name"], node["process_space"], forward if forward is not None else [ir.Chain(tuple(back or [])).inverse()])

    def view(v: dict) -> View:
        return View(v["name"], v.get("display_colorspace") or v.get("colorspace", ""), v.get("looks") or "", v.get("view_transform") or "")

    shared = {v["name"]: view(v) for v in data.get("shared_views") or []}
    for display, views in (data.get("displays") or {}).items():
        out.displays[display] = []
        for v in views or []:
            out.displays[display] += [shared[n] for n in v["values"] if n in shared] if v.get("!") == "Views" else [view(v)]
    for node in data.get("file_rules") or []:
        if node["name"].lower() == "default":
            out.default_space = node["colorspace"]
        else:
            out.rules.append(FileRule(node["name"], node.get("colorspace", ""), node.get("pattern", "*"), node.get("extension", "*"), node.get("regex")))
    for node in data.get("named_transforms") or []:
        forward, back = chain(node, "transform"), chain(node, "inverse_transform")
        out.named[node["name"]] = forward if forward is not None else [ir.Chain(tuple(back or [])).inverse()]
    out.active = tuple(data.get("active_colorspaces") or ())
    out.inactive = tuple(data.get("inactive_colorspaces") or ())
    return out


# Back to text


def _text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dict):
        tag = f"!<{value['!']}> " if "!" in value else ""
        return tag + "{" + ", ".join(f"{k}: {_text(v)}" for k, v in value.items() if k != "!" and v is not None) + "}"
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(_text, value)) + "]"
    if isinstance(value, float | int | np.floating):
        return repr(float(value)) if not isinstance(value, int) else str(value)
    plain = re.fullmatch(r"[A-Za-z_$/][\w $./-]*", str(value)) and str(value) not in ("true", "false")
    return str(value) if plain else '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def node_of(t) -> dict:
    """A transform as the node of a configuration that gives it back."""
    if isinstance(t, ir.Chain):
        return {"!": "GroupTransform", "children": [node_of(p) for p in t.parts]}
    if isinstance(t, ir.Matrix):
        m = np.eye(4)
        m[:3, :3] = t.m
        return {"!": "MatrixTransform", "matrix": m.ravel().tolist(), "offset": [*map(float, t.offset), 0.0]}
    if isinstance(t, ir.Curve):
        node = {"!": "BuiltinTransform", "style": f"CURVE - {t.name}_to_LINEAR"}
        return node if t.decode else node | {"direction": "inverse"}
    if isinstance(t, ir.Exponent):
        return {"!": "ExponentTransform", "value": [*t.power, 1.0], "style": {"pass": "pass_thru"}.get(t.negative, t.negative)}
    if isinstance(t, ir.Cdl):
        node = {"!": "CDLTransform", "slope": t.slope, "offset": t.offset, "power": t.power, "sat": t.saturation, "style": t.style}
        return node | {"direction": "inverse"} if t.backward else node
    if isinstance(t, ir.Range):
        return {"!": "RangeTransform", "min_in_value": t.low_in, "max_in_value": t.high_in, "min_out_value": t.low_out, "max_out_value": t.high_out, "style": "Clamp" if t.clamp else "noClamp"}
    if isinstance(t, ir.LogAffine):
        node = {"!": "LogAffineTransform", "base": t.base, "log_side_slope": t.log_slope, "log_side_offset": t.log_offset, "lin_side_slope": t.lin_slope, "lin_side_offset": t.lin_offset}
        return node | {"direction": "inverse"} if t.backward else node
    if isinstance(t, ir.ExposureContrast):
        return {"!": "ExposureContrastTransform", "style": t.style, "exposure": t.exposure, "contrast": t.contrast, "gamma": t.gamma, "pivot": t.pivot}
    if isinstance(t, ir.Fixed):
        node = {"!": "FixedFunctionTransform", "style": t.name.upper()}
        return node if t.forward else node | {"direction": "inverse"}
    if isinstance(t, ir.Table) and isinstance(t.lut, lut.Lut3D):
        return {"!": "Lut3DTransform", "gridSize": t.lut.size, "interpolation": t.method, "values": t.lut.cube.ravel().tolist()}
    if isinstance(t, ir.Made) and t.kind == "matrix4":
        return {"!": "MatrixTransform", "matrix": [v for row in t.values[0] for v in row], "offset": list(t.values[1])} | ({"direction": "inverse"} if t.backward else {})
    if isinstance(t, ir.Made) and t.kind in ("log_camera", "log_affine"):
        names = ("base", "log_side_slope", "log_side_offset", "lin_side_slope", "lin_side_offset", "lin_side_break")
        kind = "LogCameraTransform" if t.kind == "log_camera" else "LogAffineTransform"
        return {"!": kind, **dict(zip(names, t.values, strict=False))} | ({"direction": "inverse"} if t.backward else {})
    if isinstance(t, ir.Made) and t.kind == "allocation":
        kind, low, high, offset = t.values
        return {"!": "AllocationTransform", "allocation": kind, "vars": [low, high, *([] if offset is None else [offset])]} | ({"direction": "inverse"} if t.backward else {})
    if isinstance(t, ir.Made) and t.kind == "primary":
        kw = {{"low": "clamp_black", "high": "clamp_white"}.get(k, k): v for k, v in t.values[0]}
        return {"!": "GradingPrimaryTransform", **kw} | ({"direction": "inverse"} if t.backward else {})
    if isinstance(t, Later) and t.how == "conversion":
        return {"!": "ColorSpaceTransform", "src": t.names[0], "dst": t.names[1]} | ({"direction": "inverse"} if t.backward else {})
    raise ValueError(f"no text for {type(t).__name__}")


def dumped(c: Catalog) -> str:
    """A catalogue as the text of a configuration; `load` gives it back."""
    out = ["ocio_profile_version: 2", ""]
    if c.search_path:
        out.append(f"search_path: {_text(c.search_path)}")
    if c.variables:
        out += ["environment:", *(f"  {k}: {_text(v)}" for k, v in c.variables.items())]
    out += ["roles:", *(f"  {k}: {_text(v)}" for k, v in c.roles.items())] if c.roles else []
    out.append("file_rules:")
    for r in c.rules:
        how = {"regex": r.regex} if r.regex is not None else {"pattern": r.pattern, "extension": r.extension}
        out.append("  - " + _text({"!": "Rule", "name": r.name, "colorspace": r.space, **how}))
    out.append("  - " + _text({"!": "Rule", "name": "Default", "colorspace": c.default_space or "default"}))
    if c.displays:
        out.append("displays:")
        for display, views in c.displays.items():
            out += [f"  {display}:", *("    - " + _text({"!": "View", "name": v.name, "colorspace": v.space, "looks": v.looks or None}) for v in views)]
    for key, names in (("active_colorspaces", c.active), ("inactive_colorspaces", c.inactive)):
        if names:
            out.append(f"{key}: {_text(list(names))}")
    chain = lambda parts: _text(node_of(ir.Chain(tuple(parts))))
    if c.looks:
        out.append("looks:")
        for k in c.looks.values():
            out += ["  - !<Look>", f"    name: {_text(k.name)}", f"    process_space: {_text(k.process_space)}", f"    transform: {chain(k.forward)}"]
    out.append("colorspaces:")
    for s in c.spaces.values():
        out += ["  - !<ColorSpace>", f"    name: {_text(s.name)}"]
        for key, value in (("aliases", list(s.aliases)), ("family", s.family), ("encoding", s.encoding), ("categories", list(s.categories)), ("isdata", s.is_data)):
            if value:
                out.append(f"    {key}: {_text(value)}")
        for key, parts in (("to_scene_reference", s.to_reference), ("from_scene_reference", s.from_reference)):
            if parts:
                out.append(f"    {key}: {chain(parts)}")
    if c.named:
        out.append("named_transforms:")
        for name, parts in c.named.items():
            out += ["  - !<NamedTransform>", f"    name: {_text(name)}", f"    transform: {chain(parts)}"]
    return "\n".join(out) + "\n"


def standard() -> Catalog:
    """A small catalogue around ACES2065-1."""
    out = Catalog(roles={"scene_linear": "ACEScg", "default": "raw", "color_timing": "ACEScct", "reference": "ACES2065-1"}, default_space="raw")
    cg = ir.Matrix(gamut.rgb_to_rgb("aces_ap1", "aces_ap0"))
    from_rgb = lambda g: ir.Matrix(gamut.rgb_to_rgb(g, "aces_ap0", "bradford"))
    spaces = [
        Space("ACES2065-1", [], aliases=("aces", "ap0"), encoding="scene-linear"),
        Space("ACEScg", [cg], aliases=("lin_ap1",), encoding="scene-linear"),
        Space("ACEScct", [ir.Curve("acescct"), cg], encoding="log"),
        Space("ACEScc", [ir.Curve("acescc"), cg], encoding="log"),
        Space("linear_srgb", [from_rgb("srgb")], aliases=("lin_rec709",), encoding="scene-linear"),
        Space("sRGB", [ir.Curve("srgb"), from_rgb("srgb")], aliases=("srgb_texture",), encoding="sdr-video"),
        Space("Rec.709", [ir.Curve("gamma24"), from_rgb("rec709")], encoding="sdr-video"),
        Space("Display P3", [ir.Curve("srgb"), from_rgb("display_p3")], encoding="sdr-video"),
        Space("Rec.2100-PQ", [ir.Curve("pq_100"), from_rgb("rec2020")], encoding="hdr-video"),
        Space("raw", is_data=True, aliases=("utility - raw",)),
    ]
    spaces += [Space(n, builtin(b), encoding="log", family="camera") for n, b in (
        ("LogC3", "arri_logc3_to_ap0"), ("LogC4", "arri_logc4_to_ap0"), ("S-Log3", "slog3_sgamut3_to_ap0"), ("V-Log", "vlog_vgamut_to_ap0"),
        ("Log3G10", "log3g10_rwg_to_ap0"), ("Canon Log 3", "canon_clog3_to_ap0"), ("Apple Log", "apple_log_rec2020_to_ap0"),
    )]
    for s in spaces:
        out.add(s)
    out.looks["warm"] = Look("warm", "ACEScct", [ir.Cdl((1.05, 1.0, 0.95), (0.01, 0.0, -0.01), (1.0, 1.0, 1.0), 1.1)])
    out.displays = {"sRGB": [View("Film", "sRGB", "warm"), View("Raw", "raw")], "P3": [View("Video", "Display P3")]}
    out.rules = [FileRule("linear", "ACEScg", "*", "exr"), FileRule("texture", "sRGB", regex=r"(?i)_(diff|col)\."), FileRule("log", "LogC3", "*plate*", "dpx")]
    return out
