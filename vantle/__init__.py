"""Embedding retrieval and corpus preparation on Spark. Names are loaded when they are first used."""

from __future__ import annotations

import importlib

_WHERE = {
    "functions.bpe": ("vocabulary",),
    "functions.sizes": ("capacity_report", "checked_budget", "estimated", "npy_bytes", "parse_budget", "readable"),
    "functions.vectors": ("PACKINGS", "bytes_per_vector"),
    "operators.build": ("build",),
    "operators.config": ("IMAGE_MEAN", "IMAGE_STD", "DEFAULT_ENCODER", "DEFAULT_POOLING", "BuildConfig", "EncoderConfig", "Preprocess", "build_config", "config_file", "encoder_config", "encoder_of"),
    "operators.encoders": ("FrameEncoder", "TextEncoder", "available", "create_encoder", "get_pooling", "register_decoder", "register_encoder", "register_pooling"),
    "operators.ranking": ("positions", "recall_metrics"),
    "operators.store": ("Store", "packed", "unpacked"),
    "session": ("build_session",),
    "sources.captions": ("discover_items", "read_split", "text_vectors"),
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"vantle.{_MODULE[name]}"), name)
