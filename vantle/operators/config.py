"""Settings in layers: what a class declares, then a file, then what the caller states.

Settings are dataclass fields; a field's metadata may hold a rule (a test and what it asks for). One function lays any
number of layers over a settings object, and one checks its rules, so that a new setting is one more field.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any

from vantle.functions.vectors import PACKINGS

#: Channel means and deviations of the usual image normalization.
IMAGE_MEAN, IMAGE_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
RESIZE_MODES = ("short-edge-center-crop", "stretch")
DEFAULT_ENCODER, DEFAULT_POOLING = "stub", "meanP"
#: Settings that tell where a build ran, not what it computed.
PLACE = ("device", "precision")


def _ruled(default: Any, test: Callable[[Any], bool], wanted: str) -> Any:
    return field(default=default, metadata={"rule": (test, wanted)})


_POSITIVE = (lambda x: x > 0, "must be above 0")
_AT_LEAST_ONE = (lambda x: x >= 1, "must be at least 1")


class Settings:
    """A dataclass whose fields' rules hold."""

    def __post_init__(self):
        broken = [f"{f.name} {f.metadata['rule'][1]}" for f in fields(self) if "rule" in f.metadata and not f.metadata["rule"][0](getattr(self, f.name))]
        if broken := broken or self.broken():
            raise ValueError("; ".join(broken))

    def broken(self) -> list[str]:
        """Rules between fields that don't hold."""
        return []


def layered(base: Any, *layers: Mapping[str, Any] | None) -> Any:
    """base with each layer's settings over it, in order. None leaves a setting as it is; a nested settings object takes a
    mapping; a name that base doesn't declare fails."""
    known = {f.name for f in fields(base)}
    for layer in layers:
        if strange := sorted(set(layer or ()) - known):
            raise ValueError(f"unknown {type(base).__name__} settings {strange}; there are {sorted(known)}")
        stated = {k: v for k, v in (layer or {}).items() if v is not None}
        nested = {k: layered(getattr(base, k), v) for k, v in stated.items() if is_dataclass(getattr(base, k)) and isinstance(v, Mapping)}
        base = replace(base, **{**stated, **nested})
    return base


@dataclass(frozen=True)
class Preprocess(Settings):
    """How an encoder wants its frames."""

    image_size: int = _ruled(224, *_AT_LEAST_ONE)
    mean: tuple[float, ...] = IMAGE_MEAN
    std: tuple[float, ...] = _ruled(IMAGE_STD, lambda x: all(v > 0 for v in x), "must be above 0")
    resize_mode: str = _ruled(RESIZE_MODES[0], RESIZE_MODES.__contains__, f"must be one of {RESIZE_MODES}")
    channels: int = _ruled(3, *_AT_LEAST_ONE)

    def broken(self) -> list[str]:
        return [f"{name} needs {self.channels} numbers" for name in ("mean", "std") if len(getattr(self, name)) != self.channels]


@dataclass
class EncoderConfig(Settings):
    """Which encoder, from where, and what it runs on; image settings that are None are the encoder's own."""

    name: str = DEFAULT_ENCODER
    model: str = ""
    revision: str | None = None
    cache_dir: str | None = None
    local_files_only: bool = False
    device: str = "auto"
    precision: str = "auto"
    pooling: str = DEFAULT_POOLING
    image_size: int | None = None
    image_mean: tuple[float, ...] | None = None
    image_std: tuple[float, ...] | None = None

    def over(self, own: Preprocess) -> Preprocess:
        """The encoder's own preprocessing under these image settings."""
        numbers = lambda x: x and tuple(map(float, x))
        return layered(own, {"image_size": self.image_size, "mean": numbers(self.image_mean), "std": numbers(self.image_std)})


@dataclass
class BuildConfig(Settings):
    encoder: EncoderConfig = field(default_factory=EncoderConfig)
    storage_dtype: str = _ruled("float32", PACKINGS[:2].__contains__, f"must be one of {PACKINGS[:2]}")
    frame_rate: float = _ruled(1.0, *_POSITIVE)
    max_frames: int = _ruled(12, *_POSITIVE)
    frame_batch_size: int = 128
    video_batch_size: int = 16
    decode_workers: int = 4


def encoder_config(given: Mapping[str, Any], base: EncoderConfig | None = None) -> EncoderConfig:
    return layered(base or EncoderConfig(), given)


def build_config(path: str | None = None, encoder: dict | None = None, build: dict | None = None) -> BuildConfig:
    """Defaults, under the file's sections, under the stated ones."""
    sections = config_file(path) if path else {}
    return layered(BuildConfig(), sections.get("build"), {"encoder": sections.get("encoder")}, build, {"encoder": encoder})


def _yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError:
        raise ValueError("YAML settings need a YAML reader; JSON ones don't") from None
    return yaml.safe_load(text)


#: Readers of settings by a file's extension; any other file is JSON.
READERS: dict[str, Callable[[str], Any]] = {".yaml": _yaml, ".yml": _yaml}
SECTIONS = {"encoder", "build"}


def config_file(path: str) -> dict:
    """The sections of a settings file; an empty one has none."""
    with open(os.path.expanduser(path), encoding="utf-8") as f:
        found = READERS.get(os.path.splitext(path)[1].lower(), json.loads)(f.read())
    if not (found is None or (isinstance(found, dict) and set(found) <= SECTIONS)):
        raise ValueError(f"{path} holds something else than the sections {sorted(SECTIONS)}")
    return found or {}


def _without_place(value: Any) -> Any:
    return {k: _without_place(v) if k == "encoder" else v for k, v in value.items() if k not in PLACE} if isinstance(value, dict) else value


def identity(config: dict) -> dict:
    """A stored configuration without the settings of PLACE, at the top and under encoder."""
    return json.loads(json.dumps(_without_place(config)))


#: Fixed names: what older manifests call an encoder's settings.
OLDER = {"model_id": "model", "device": "device", "precision": "precision", "image_size": "image_size"}


def encoder_of(manifest: dict) -> EncoderConfig:
    """The encoder's settings in a manifest: a section of their own, or older names at the top, or the defaults."""
    stored = manifest.get("config") or {}
    nested = stored.get("encoder")
    return encoder_config(nested if isinstance(nested, dict) else {new: stored[old] for old, new in OLDER.items() if old in stored})


def plain(config: BuildConfig) -> dict:
    return json.loads(json.dumps(asdict(config)))
