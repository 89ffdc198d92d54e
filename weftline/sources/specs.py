"""Scraper specs: the declarative description of rows and fields, checked when read."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from weftline.sources.selectors import compile_selector

TYPES = ("string", "number", "list")
ROW = "__row__"


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    selector: str
    type: str = "string"
    required: bool | None = True
    min: float | None = None
    max: float | None = None
    min_items: int | None = None
    attr: str | None = None


@dataclass(frozen=True)
class Spec:
    name: str
    url: str
    fields: dict[str, Field]
    row: str | None = None
    rows_min: int | None = None
    rows_max: int | None = None
    auth: dict | None = None
    paginate: dict | None = None
    output: dict | None = None

    def selector(self, target: str) -> str | None:
        return self.row if target == ROW else self.fields[target].selector if target in self.fields else None

    def with_selector(self, target: str, selector: str) -> Spec:
        if target == ROW:
            return replace(self, row=selector)
        if target not in self.fields:
            return self
        return replace(self, fields=self.fields | {target: replace(self.fields[target], selector=selector)})

    def only(self, names: list[str]) -> Spec:
        """The same spec with fewer fields: pruning happens before the extraction is planned."""
        return replace(self, fields={k: v for k, v in self.fields.items() if k in names})


def _want(ok: bool, what: str) -> None:
    if not ok:
        raise SpecError(what)


def spec_from_dict(raw: dict, name: str | None = None) -> Spec:
    """A checked spec; ``name`` (a file's) wins over the one inside."""
    _want(isinstance(raw, dict), "a spec is an object")
    name = name or raw.get("name")
    _want(isinstance(name, str) and bool(name), "name must be a string")
    _want(isinstance(raw.get("url"), str) and bool(raw["url"]), f"{name}: url must be a string")
    fields = raw.get("fields")
    _want(isinstance(fields, dict) and bool(fields), f"{name}: fields must be a non-empty object")
    out = {}
    for key, f in fields.items():
        _want(isinstance(f, dict) and isinstance(f.get("selector"), str) and bool(f["selector"]), f"{name}.{key}: selector must be a string")
        _want(f.get("type", "string") in TYPES, f"{name}.{key}: type must be one of {', '.join(TYPES)}")
        for bound in ("min", "max", "minItems"):
            _want(f.get(bound) is None or isinstance(f[bound], (int, float)), f"{name}.{key}: {bound} must be a number")
        compile_selector(f["selector"])
        out[key] = Field(f["selector"], f.get("type", "string"), f.get("required", True), f.get("min"), f.get("max"), f.get("minItems"), f.get("attr"))
    if raw.get("row") is not None:
        _want(isinstance(raw["row"], str) and bool(raw["row"]), f"{name}: row must be a string")
        compile_selector(raw["row"])
    rows = (raw.get("expect") or {}).get("rows") or {}
    paginate = raw.get("paginate")
    if paginate is not None:
        _want(bool(paginate.get("template")) != bool(paginate.get("next")), f"{name}: paginate needs template or next")
    output = raw.get("output")
    if output is not None:
        check_output(output, name)
    return Spec(name, raw["url"], out, raw.get("row"), rows.get("min"), rows.get("max"), raw.get("auth"), paginate, output)


def check_output(output: dict, name: str) -> None:
    _want(isinstance(output.get("path"), str) and bool(output["path"]), f"{name}: output.path must be a string")
    _want(output.get("format") in (None, "json", "jsonl", "csv"), f"{name}: output.format is unknown")
    _want(output.get("mode") in (None, "snapshot", "append", "changes"), f"{name}: output.mode is unknown")
    if output.get("mode") in ("append", "changes"):
        _want(format_for(output["path"], output.get("format")) != "json", f"{name}: a JSON array cannot be appended to")


def format_for(path: str, explicit: str | None = None) -> str:
    return explicit or {".csv": "csv", ".json": "json"}.get(Path(path).suffix.lower(), "jsonl")


def spec_to_dict(spec: Spec) -> dict:
    fields = {}
    for k, f in spec.fields.items():
        d = asdict(f)
        d["minItems"] = d.pop("min_items")
        fields[k] = {a: b for a, b in d.items() if b is not None and not (a == "required" and b is True)}
    out: dict = {"name": spec.name, "url": spec.url}
    if spec.row:
        out["row"] = spec.row
    out["fields"] = fields
    if spec.rows_min is not None or spec.rows_max is not None:
        out["expect"] = {"rows": {k: v for k, v in (("min", spec.rows_min), ("max", spec.rows_max)) if v is not None}}
    return out | {k: v for k in ("auth", "paginate", "output") if (v := getattr(spec, k)) is not None}


def load_spec(path: str | Path) -> Spec:
    try:
        return spec_from_dict(json.loads(Path(path).read_text()), Path(path).stem)
    except json.JSONDecodeError as e:
        raise SpecError(f"{path}: not JSON ({e})") from e


def load_specs(folder: str | Path) -> list[Spec]:
    """All specs of a folder by file name; JSON that is no spec is passed over, none at all is an error."""
    found = []
    for path in sorted(Path(folder).glob("*.json")):
        raw = json.loads(path.read_text())
        if isinstance(raw, dict) and "fields" in raw and "url" in raw:
            found.append(spec_from_dict(raw, path.stem))
    if not found:
        raise SpecError(f"no specs in {folder}")
    return found


def patch_spec_file(path: str | Path, target: str, selector: str) -> None:
    raw = json.loads(Path(path).read_text())
    if target == ROW:
        raw["row"] = selector
    else:
        raw["fields"][target]["selector"] = selector
    Path(path).write_text(json.dumps(raw, indent=2) + "\n")


# --- settings ----------------------------------------------------------------


@dataclass
class Settings:
    interval: float = 900
    concurrency: int = 4
    heal: str = "report"
    notify: list = field(default_factory=list)
    politeness: dict = field(default_factory=dict)
    output: dict | None = None
    #: Provider, model and the like, as ``operators.model`` reads them.
    model: dict | None = None


def parse_duration(text: str | float) -> float:
    """``30s``, ``15m``, ``2h``, ``1d`` or seconds, as seconds."""
    if isinstance(text, (int, float)):
        return float(text)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*", text)
    if not m:
        raise SpecError(f"not a duration: {text!r}")
    return float(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def format_duration(seconds: float) -> str:
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        if seconds >= size and seconds % size == 0:
            return f"{int(seconds // size)}{unit}"
    return f"{int(seconds)}s" if seconds == int(seconds) else f"{seconds}s"


def load_settings(folder: str | Path, names: tuple[str, ...] = ("weftline.config.json", ".weftlinerc.json")) -> Settings:
    for name in names:
        path = Path(folder, name)
        if path.exists():
            raw = json.loads(path.read_text())
            s = Settings(**{k: v for k, v in raw.items() if k in Settings.__dataclass_fields__})
            s.interval = parse_duration(s.interval)
            _want(s.interval >= 5, "interval must be 5 seconds or more")
            _want(s.concurrency >= 1, "concurrency must be 1 or more")
            _want(s.heal in ("off", "report", "write"), "heal must be off, report or write")
            return s
    return Settings()
