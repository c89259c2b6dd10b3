"""Run settings: defaults, then an overlay file, then the environment; passed on explicitly."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Settings:
    data_path: str = "panel"
    outputs_dir: str = "outputs"
    seed: int = 42
    lags: tuple[int, ...] = (1, 2)
    folds: int = 4
    min_train_rows: int = 8
    min_test_rows: int = 4
    backtest_years: int = 3
    years_ahead: int = 10
    clean_scale: float = 0.8
    polluted_scale: float = 1.2
    aod_columns: tuple[str, ...] = ("aod",)
    pm_columns: tuple[str, ...] = ("pm", "pm2.5 ugm-3")
    smoothing: float = 10.0
    use_target_mean: bool = True
    tertiles: str = "fixed"  # or refit: thresholds from each fold's training rows
    feature_set: str = "auto"
    tune_mode: str = "metrics"
    regressors: tuple[str, ...] = ()  # none: those of the mode
    classifiers: tuple[str, ...] = ()
    most_candidates: int = 8  # of each kind; 0: as many as the mode has
    sample_weight_power: float = 1.0
    use_cache: bool = True
    importance_repeats: int = 10
    extra: Mapping[str, str] = field(default_factory=dict)


def _coerced(name: str, value):
    now = getattr(Settings(), name)
    if isinstance(now, bool):
        return str(value).strip().lower() in ("1", "true", "yes")
    if isinstance(now, tuple):
        items = value if isinstance(value, (list, tuple)) else [x.strip() for x in str(value).split(",") if x.strip()]
        return tuple(int(x) if now and isinstance(now[0], int) else str(x) for x in items)
    return type(now)(value)


#: Names of an overlay, with the names of their groups, and the settings that they mean.
NAMES = {
    "random_state": "seed",
    "cv.n_splits": "folds",
    "cv.min_samples_cv": "min_train_rows",
    "forecast.years_ahead": "years_ahead",
    "scenario.clean_scale": "clean_scale",
    "scenario.polluted_scale": "polluted_scale",
    "scenario.aod_cols": "aod_columns",
    "scenario.pm_cols": "pm_columns",
}
_WORD = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]#"']+(?:#(?<!\s#)[^,\[\]#]*)*)\s*(,|$|\]|#)""")


def _bare(word: str) -> str:
    word = word.strip()
    if len(word) > 1 and word[0] == word[-1] and word[0] in "'\"":
        return word[1:-1].replace("''", "'") if word[0] == "'" else word[1:-1].replace('\\"', '"').replace("\\\\", "\\")
    return word


def _words(text: str) -> list[str]:
    """Words between commas; quoted ones may hold commas and #. What follows a # is a remark."""
    out, at = [], 0
    while at < len(text) and (m := _WORD.match(text, at)):
        out.append(_bare(m[1]))
        at = m.end()
        if m[2] in ("#", "]"):
            break
    return out


def _overlay_text(text: str) -> dict:
    """JSON, or a small YAML: nested ``name: value`` lines, lists in brackets, over lines or with dashes, quotes and
    remarks. Names of groups are joined by dots."""
    try:
        return _flat(json.loads(text))
    except ValueError:
        pass
    out: dict = {}
    path: list[tuple[int, str]] = []
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "---"))]
    while lines:
        line = lines.pop(0)
        depth, line = len(line) - len(line.lstrip()), line.strip()
        name = ".".join(n for d, n in path)
        if line.startswith("- "):
            out.setdefault(name, [])
            out[name] += _words(line[2:])
            continue
        key, colon, rest = line.partition(":")
        if not colon:
            continue
        path = [(d, n) for d, n in path if d < depth]
        name = ".".join([*(n for _, n in path), _bare(key)])
        rest = rest.strip()
        if rest.startswith("["):
            while "]" not in re.sub(r"""\"[^"]*"|'[^']*'""", "", rest) and lines:
                rest += f" {lines.pop(0).strip()}"
            out[name] = _words(rest[1:])
        elif not rest or rest.startswith("#"):
            path.append((depth, _bare(key)))
        else:
            words = _words(rest)
            out[name] = words[0] if len(words) == 1 else words
    return out


def _flat(found: dict, before: str = "") -> dict:
    out: dict = {}
    for k, v in found.items():
        out |= _flat(v, f"{before}{k}.") if isinstance(v, dict) else {f"{before}{k}": v}
    return out


def settings(overlay: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """``overlay``: path of a file, skipped if absent. Environment names: FURROW_<FIELD>."""
    known = {f.name for f in fields(Settings)} - {"extra"}
    found: dict = {}
    if overlay and os.path.exists(overlay):
        with open(overlay, encoding="utf-8") as f:
            for name, value in _overlay_text(f.read()).items():
                found[NAMES.get(name, name.rpartition(".")[2])] = value
                if name == "cv.min_samples_cv":
                    found.setdefault("min_test_rows", max(2, int(value) // 2))
    for key, value in (os.environ if environment is None else environment).items():
        if key.startswith("FURROW_"):
            found[key.removeprefix("FURROW_").lower()] = value
    own = {k: _coerced(k, v) for k, v in found.items() if k in known}
    return replace(Settings(), **own, extra={k: str(v) for k, v in found.items() if k not in known})
