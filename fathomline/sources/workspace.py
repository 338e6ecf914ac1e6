"""Repositories that are already indexed: their folders in a common home, and what in them serves."""

from __future__ import annotations

import json
import os

from ..functions.code import fnv1a

#: Fixed value: the offset basis of folder names, other than the one for words.
FOLDER_BASIS = 0x14650FB0739D0383
RECORD = "repository.json"


def folder_of(home: str, root: str) -> str:
    """Where a repository's tables live: its name and a hash of its absolute path."""
    name = os.path.basename(os.path.normpath(root)) or "root"
    return os.path.join(home, f"{name}-{fnv1a(os.path.abspath(root), FOLDER_BASIS):016x}")


def record(home: str, root: str) -> str:
    """Notes a repository's root in its folder; the folder."""
    at = folder_of(home, root)
    os.makedirs(at, exist_ok=True)
    with open(os.path.join(at, RECORD + ".tmp"), "w", encoding="utf-8") as f:
        json.dump({"root": os.path.abspath(root)}, f)
    os.replace(os.path.join(at, RECORD + ".tmp"), os.path.join(at, RECORD))
    return at


def cached(home: str) -> list[str]:
    """Roots of the repositories with a folder here whose recorded root leads back to that folder."""
    found = []
    for name in sorted(os.listdir(home)) if os.path.isdir(home) else ():
        try:
            with open(os.path.join(home, name, RECORD), encoding="utf-8") as f:
                root = json.load(f)["root"]
        except (OSError, ValueError, KeyError, TypeError):
            continue
        if isinstance(root, str) and folder_of(home, root) == os.path.join(home, name):
            found.append(root)
    return found


def indexed(home: str, top: str, fingerprint: str | None = None, model: str | None = None) -> list[tuple[str, str]]:
    """(root, index folder) of the repositories at or below ``top`` with a whole index of a fingerprint, or
    of any fingerprint of a model."""
    top = os.path.abspath(top)
    out = []
    for root in cached(home):
        if root != top and not root.startswith(top.rstrip(os.sep) + os.sep):
            continue
        at = os.path.join(folder_of(home, root), "index")
        held = sorted(n for n in os.listdir(at) if os.path.isdir(os.path.join(at, n, "whole"))) if os.path.isdir(at) else []
        fits = [n for n in held if n == fingerprint or (model is not None and n.startswith(f"{model}-"))]
        if fits:
            out.append((root, os.path.join(at, fits[0])))
    return out
