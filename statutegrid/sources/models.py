"""Where a model comes from: a local export, or an identifier that a model library resolves; and the settings beside it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from pathlib import Path

from statutegrid.operators.model import Scorer

#: Files that hold weights, the folder that an export may keep them in, and the settings' file.
WEIGHTS = ("model.safetensors", "pytorch_model.bin")
FULL, SETTINGS = "full", "training_config.json"


@dataclass(frozen=True)
class Settings:
    """What an export may say about how its labels are decoded and how it was trained."""

    use_crf: bool = True
    ordinal_weight: float = 0.3
    aim0_penalty_weight: float = 0.5
    #: Transition scores (from, to) of the decoder, three by three; an export without them is decoded by arg-max.
    transitions: list[list[float]] | None = None


def has_weights(folder: Path) -> bool:
    return any((folder / name).exists() for name in WEIGHTS)


def resolve(reference: str) -> tuple[str, Path | None]:
    """(name to load, local folder or None).

    A folder that exists is taken, or its `full` child where only that holds weights; a folder without weights, and a path that should be local but does
    not exist, raise FileNotFoundError; anything else is an identifier for the model library.
    """
    path = Path(reference)
    if path.exists():
        folder = path / FULL if not has_weights(path) and has_weights(path / FULL) else path
        if not has_weights(folder):
            raise FileNotFoundError(f"{folder} holds none of {', '.join(WEIGHTS)}")
        return str(folder), folder
    if path.is_absolute() or reference.startswith((".", "models/", "models\\")):
        raise FileNotFoundError(f"no such model folder: {path}")
    return reference, None


def settings(folder: Path | None) -> Settings:
    """Settings of a local export; the defaults where it has none, or for what it leaves out."""
    file = folder / SETTINGS if folder else None
    if file is None or not file.exists():
        return Settings()
    said = json.loads(file.read_text(encoding="utf-8"))
    return Settings(**{k: said[k] for k in Settings.__dataclass_fields__ if k in said})


def scorer(reference: str, runner: Callable[[str, Settings], object]) -> Scorer:
    """The model that a reference names: resolved and its settings read on the driver, made in the workers by runner(name, settings)."""
    name, folder = resolve(reference)
    said = settings(folder)
    return Scorer(partial(runner, name, said), said.transitions if said.use_crf else None)
