"""Run configuration on the driver: files, the environment, precedence and digests."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping

#: The keys of a configuration file.
KEYS = frozenset(
    "input_path input_pdf output_dir language provider_translator provider_rewriter provider_tts model_translate model_rewrite model_tts tts_voice api_key "
    "rewrite_bypass chunk_size_chars chapter_selection resume output_format package_mode package_chapters package_chapter_numbering package_naming "
    "package_encoding_bitrate package_encoding_profile package_keep_merged reader_output_format extra".split()
)
DEFAULTS = {"language": "cs", "chunk_size_chars": 1800, "chapter_selection": "", "rewrite_bypass": False, "provider_translator": "openai", "provider_rewriter": "openai", "provider_tts": "openai"}
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def boolean(value: object) -> bool | None:
    """A permissive boolean; None for anything else."""
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower() if value is not None else ""
    return True if word in TRUE else False if word in FALSE else None


def _scalar(text: str) -> object:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    try:
        return int(text)
    except ValueError:
        return text


def parse_yaml(text: str) -> dict:
    """A strict subset: `key: value` lines, comments, and one level of indented mappings."""
    out: dict = {}
    inner: dict | None = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #", 1)[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.strip().partition(":")
        if not colon or line.startswith("\t"):
            raise ValueError(f"line {n}: `key: value` expected")
        if line[0] == " ":
            if inner is None:
                raise ValueError(f"line {n}: unexpected indent")
            inner[key] = _scalar(value)
        elif value.strip():
            out[key], inner = _scalar(value), None
        else:
            inner = out[key] = {}
    return out


def from_mapping(payload: Mapping) -> dict:
    """A checked configuration; unknown keys and impossible values are errors."""
    unknown = sorted(set(payload) - KEYS)
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    config = DEFAULTS | {k: v for k, v in payload.items() if v is not None}
    if not (config.get("input_path") or config.get("input_pdf")):
        raise ValueError("an input path is needed")
    size = config["chunk_size_chars"]
    if isinstance(size, bool) or not str(size).strip().isdigit() or int(size) <= 0:
        raise ValueError("chunk_size_chars must be a positive number")
    config["chunk_size_chars"] = int(size)
    bypass = boolean(config["rewrite_bypass"])
    if bypass is None:
        raise ValueError("rewrite_bypass must be a boolean")
    return config | {"rewrite_bypass": bypass}


def from_env(env: Mapping[str, str], prefix: str = "FOLIOFORGE_") -> dict:
    return from_mapping({k[len(prefix) :].lower(): v.strip() for k, v in env.items() if k.startswith(prefix) and v.strip()})


def resolve(key: str, *sources: Mapping[str, str | None]) -> str | None:
    """The first source's value that isn't blank: command line, secure store, environment, default."""
    return next((v.strip() for s in sources if (v := s.get(key)) and v.strip()), None)


def anchored(raw: object, manifest: str, default: str, exists: Callable[[str], bool] = os.path.exists) -> str:
    """A path of a manifest: absolute as it is, else beside the manifest if it is there, else as it is; blank: the default."""
    if not isinstance(raw, str) or not raw.strip():
        return default
    if os.path.isabs(raw):
        return raw
    beside = os.path.join(os.path.dirname(manifest), raw)
    return beside if exists(beside) else raw


def digest(config: Mapping) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no spaces, ASCII alone."""
    return hashlib.sha256(json.dumps(dict(config), sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()).hexdigest()


def run_id(config: Mapping) -> str:
    return f"run-{digest(config)[:12]}"
