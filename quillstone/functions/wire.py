"""Documents as they are served: EDN with keywords, or JSON, whose keys and keywords have no colons."""

from __future__ import annotations

import json

from ..sources.edn import edn

KEYWORDS = {"evidence": ("type", "claim_type", "pattern_id", "tags"), "hx": ("type",), "entity": ("type",), "relation": ("type",)}


def public(row: dict, space: str, keywords: bool = True) -> dict:
    """A row under namespaced keys; what is null or internal (an id of the store, names kept for filters) doesn't show."""
    out = {}
    for k, v in row.items():
        if v is None or k in ("tag_names", "xt/id", "ends"):
            continue
        if keywords and k in KEYWORDS.get(space, ()):
            v = [f":{x}" for x in v] if isinstance(v, list) else f":{v}"
        if isinstance(v, dict):
            v = {f":{a.replace('_', '/', 1) if a.startswith('ref_') else a.replace('_', '-')}": b for a, b in v.items()}
        out[f":{space}/{k.replace('_', '-')}"] = v
    return out


def plain(x):
    """Without the colons of keywords as keys and values."""
    if isinstance(x, dict):
        return {str(k).removeprefix(":"): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.removeprefix(":") if isinstance(x, str) and len(x) > 1 and " " not in x else x


def accepts_json(accept: str | None) -> bool:
    """JSON where it is asked for before EDN; EDN is the default."""
    kinds = [k.split(";")[0].strip() for k in (accept or "").split(",")]
    at = [kinds.index(k) if k in kinds else len(kinds) for k in ("application/json", "application/edn")]
    return at[0] < at[1]


def render(x, accept: str | None = None, keep: tuple[str, ...] = ("types",)) -> tuple[str, str]:
    """(content type, text).  Session ``types`` keep their colons in JSON too."""
    if not accepts_json(accept):
        return "application/edn", edn(x)

    def walk(v, key: str = ""):
        if isinstance(v, dict):
            return {str(k).removeprefix(":"): walk(w, str(k).rpartition("/")[2].removeprefix(":")) for k, w in v.items()}
        if isinstance(v, (list, tuple)):
            return [walk(w, key) for w in v]
        return v if key in keep else plain(v)

    return "application/json", json.dumps(walk(x), ensure_ascii=False)
