"""Configurations: files, defaults, requests and what is kept of them beside the tables."""

from __future__ import annotations

import ast
import json
import pickle
from collections import Counter
from pathlib import Path
from typing import Any

from phrasewerk.sources.store import ArtifactStore

#: The defaults of a document server.
SERVER = {"url": "http://localhost", "port": "9008", "index": "documents", "size": 30, "label_key": "label", "other_id": "id", "replace_keys": {"text": "content"}}
#: Words that mean yes and no in a request, and the languages by their names.
YES, NO = ("true", "yes", "y", "ja", "j", "1"), ("false", "no", "n", "nein", "0")
LANGUAGES = {"en": "en", "english": "en", "englisch": "en", "de": "de", "german": "de", "deutsch": "de"}
#: The keys under which a request may name documents, in order.
ID_KEYS = ("doc_ids", "doc_id", "ids", "id")


def _yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML files need the yaml package; JSON files do not") from e
    return yaml.safe_load(text)


#: How a file is read by the end of its name; JSON for all others. Pickles run code: only files that are trusted.
LOADERS = {"pickle": lambda raw: pickle.loads(raw), "yaml": lambda raw: _yaml(raw.decode()), "yml": lambda raw: _yaml(raw.decode()), "json": lambda raw: json.loads(raw)}


def load(path: str) -> Any:
    """The content of a configuration file, by the end of its name."""
    raw = Path(path).read_bytes()
    return LOADERS.get(path.rsplit(".", 1)[-1].lower(), LOADERS["json"])(raw)


def labels(given: str | dict | None) -> dict[str, str] | str | None:
    """Labels by file stem from a file or a table at hand; a string that names no file is the field of the document server that holds them."""
    if given is None or isinstance(given, dict):
        return given
    if Path(given).is_file():
        found = load(given)
        if not isinstance(found, dict):
            raise ValueError("labels are a table from stem to label")
        return {str(k): None if v is None else str(v) for k, v in found.items()}
    return given


def literal_dict(text: Any) -> dict:
    """A dict from its literal; a dict stays, anything else is empty."""
    if isinstance(text, dict):
        return text
    try:
        found = ast.literal_eval(str(text))
    except (ValueError, SyntaxError):
        return {}
    return found if isinstance(found, dict) else {}


def server(config: dict | None) -> dict:
    """A document server's settings, the defaults for what is missing; "none" is no value."""
    out = {**SERVER, **(config or {})}
    out = {k: None if isinstance(v, str) and v.lower() == "none" else v for k, v in out.items()}
    out["replace_keys"] = literal_dict(out["replace_keys"])
    return out


def flag(word: Any, default: bool | None = None) -> bool | None:
    """A yes or no of a request; *default* for anything else."""
    if isinstance(word, bool):
        return word
    text = str(word).strip().lower()
    return True if text in YES else False if text in NO else default


def language(name: str | None, default: str = "en") -> str:
    """The code of a language by its name or code, region and case aside."""
    text = (name or default).strip().lower().replace("_", "-")
    return LANGUAGES.get(text, LANGUAGES.get(text.split("-")[0], default))


def omitted_steps(text: str | list | None, known: tuple[str, ...]) -> set[str]:
    """The steps to leave out, from a list, its literal or words between commas; an unknown one is an error."""
    if not text:
        return set()
    if isinstance(text, str):
        body = text.strip()
        parts = ast.literal_eval(body) if body.startswith("[") else body.split(",")
    else:
        parts = text
    names = {str(p).strip().lower() for p in parts if str(p).strip()}
    if names - set(known):
        raise ValueError(f"unknown steps: {', '.join(sorted(names - set(known)))}")
    return names


def exclusion_ids(text: str | list | None) -> list:
    """Cluster ids to leave out, from a list, its literal, or a file that holds it."""
    if not text:
        return []
    if isinstance(text, list):
        return text
    body = Path(text).read_text() if Path(text).is_file() else text
    found = ast.literal_eval(body.strip())
    return list(found) if isinstance(found, (list, tuple, set)) else [found]


def document_ids(request: dict) -> list[str]:
    """The documents that a request names, under the first known key that has any."""
    for key in ID_KEYS:
        if request.get(key) not in (None, "", []):
            given = request[key]
            return [str(x) for x in given] if isinstance(given, (list, tuple)) else [str(given)]
    return []


def credential(headers: dict[str, str]) -> str | None:
    """The key that a request carries: Authorization: Bearer before X-API-Key, the case of the names aside."""
    own = {k.lower(): v.strip() for k, v in headers.items() if v}
    scheme, _, token = own.get("authorization", "").partition(" ")
    return token.strip() if scheme.lower() == "bearer" and token.strip() else own.get("x-api-key") or None


def flattened(config: dict, *dropped: str) -> dict[str, Any]:
    """Nested settings as sub_key, those of *dropped* left out."""
    out: dict[str, Any] = {}
    for k, v in config.items():
        if k in dropped:
            continue
        if isinstance(v, dict):
            out |= {f"{k}_{x}": y for x, y in flattened(v, *dropped).items()}
        else:
            out[k] = v
    return out


def nested(flat: dict[str, Any], subs: tuple[str, ...]) -> dict[str, Any]:
    """The other way round: keys that begin with one of *subs* and _ come under it."""
    out: dict[str, Any] = {}
    for k, v in flat.items():
        sub = next((s for s in subs if k.startswith(f"{s}_")), None)
        if sub:
            out.setdefault(sub, {})[k[len(sub) + 1 :]] = v
        else:
            out[k] = v
    return out


def parts(flat: dict[str, Any], *prefixes: str) -> tuple[dict[str, Any], ...]:
    """The settings of each prefix without it, and the rest as the last one."""
    rest, out = dict(flat), []
    for p in prefixes:
        out.append({k[len(p) :]: rest.pop(k) for k in list(rest) if k.startswith(p)})
    return (*out, rest)


class ConfigStore:
    """The settings of each step of a process, as JSON beside its tables."""

    def __init__(self, store: ArtifactStore):
        self.store = store

    def save(self, process: str, step: str, config: dict) -> None:
        self.store._write_text(f"{process}/{step}_config.json", json.dumps(config, ensure_ascii=False, sort_keys=True))

    def read(self, process: str, step: str) -> dict:
        """The settings of a step, empty if none were kept."""
        return json.loads(self.store._text(f"{process}/{step}_config.json") or "{}")

    def all(self, process: str, steps: tuple[str, ...]) -> dict[str, Any]:
        """{"name", "language", "config": {step: settings}}; the language is the most frequent one of the steps, ties by its name, en for none."""
        found = {s: c for s in steps if (c := self.read(process, s))}
        said = Counter(c["language"] for c in found.values() if c.get("language"))
        top = min(said, key=lambda x: (-said[x], x)) if said else "en"
        return {"name": process, "language": top, "config": found}
