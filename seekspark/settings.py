"""Settings of an indexed project: a JSON file beside the index, read with defaults for what it lacks."""

from __future__ import annotations

import copy
import json
import os

from seekspark import values as V
from seekspark.errors import SettingsError

FOLDER, FILE = ".ctx", "config.json"
# Fixed values.
DEFAULTS = {
    "embedder": {"provider": "local", "model": "Xenova/all-MiniLM-L6-v2", "dimensions": V.EMBEDDING_SIZE},
    "search": {"defaultLimit": 10, "strategies": ["vector", "fts", "ast", "path"], "weights": {"vector": 1.0, "fts": 0.8, "ast": 0.9, "path": 0.7, "dependency": 0.6}},
    "watch": {"debounceMs": V.DEBOUNCE_MS, "ignored": []},
    "llm": {"provider": None, "model": None},
}


def _whole(least: int):
    return lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) and v >= least


RULES = {
    "embedder.provider": (lambda v: v in V.EMBEDDERS, "one of " + ", ".join(V.EMBEDDERS)),
    "embedder.dimensions": (_whole(1), "a positive whole number"),
    "search.defaultLimit": (_whole(1), "a positive whole number"),
    "watch.debounceMs": (_whole(0), "a whole number from 0 on"),
    "llm.provider": (lambda v: v is None or v in V.PROVIDERS, "null or one of " + ", ".join(V.PROVIDERS)),
}


def _merged(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = _merged(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def value_of(text: str):
    """A value as it was typed: null, true, false, a number, a JSON list or object, else the text."""
    try:
        said = json.loads(text)
    except ValueError:
        try:
            return float(text) if text.strip() else text
        except ValueError:
            return text
    return text if isinstance(said, str) else said


class Settings:
    def __init__(self, root: str):
        self.folder = os.path.join(os.path.abspath(root), FOLDER)
        if not os.path.isdir(self.folder):
            raise SettingsError(f"{root} has no index yet ({FOLDER}/ is missing)", "NOT_INITIALIZED")
        self.path = os.path.join(self.folder, FILE)

    def read(self) -> dict:
        if not os.path.exists(self.path):
            self.write(DEFAULTS)
        try:
            with open(self.path) as lines:
                return _merged(DEFAULTS, json.load(lines))
        except ValueError as cause:
            raise SettingsError(f"{self.path} is no JSON", "CONFIG_INVALID") from cause

    def write(self, said: dict) -> None:
        with open(self.path, "w") as out:
            out.write(json.dumps(said, indent=2) + "\n")

    @staticmethod
    def _find(said, key: str):
        """(found, value) at a dotted key."""
        for part in key.split("."):
            if not isinstance(said, dict) or part not in said:
                return False, None
            said = said[part]
        return True, said

    def get(self, key: str):
        return self._find(self.read(), key)[1]

    def set(self, key: str, text: str) -> None:
        value = value_of(text)
        fits, what = RULES.get(key, (lambda v: True, ""))
        if not fits(value):
            raise SettingsError(f"{key} must be {what}", "CONFIG_INVALID")
        self._put(key, value)

    def _put(self, key: str, value) -> None:
        said = place = self.read()
        *above, last = key.split(".")
        for part in above:
            if not isinstance(place.get(part), dict):
                place[part] = {}
            place = place[part]
        place[last] = value
        self.write(said)

    def reset(self, key: str | None = None) -> None:
        if key is None:
            return self.write(DEFAULTS)
        known, value = self._find(DEFAULTS, key)
        if not known:
            raise SettingsError(f"there is no setting {key}", "CONFIG_INVALID")
        self._put(key, copy.deepcopy(value))
        return None


def prepare(root: str) -> Settings:
    """The settings of a project, its folder made and hidden from version control where that is in use."""
    os.makedirs(os.path.join(root, FOLDER), exist_ok=True)
    ignore, rule = os.path.join(root, ".gitignore"), FOLDER + "/"
    lines = []
    if os.path.exists(ignore):
        with open(ignore) as said:
            lines = said.read().splitlines()
    if rule not in [x.strip() for x in lines] and FOLDER not in [x.strip() for x in lines]:
        with open(ignore, "w") as out:
            out.write("\n".join([*lines, rule]) + "\n")
    settings = Settings(root)
    settings.read()
    return settings
