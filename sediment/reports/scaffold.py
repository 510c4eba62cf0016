"""The files a new project starts with."""

from __future__ import annotations

import os

# What each entry is for.
ENTRIES = {
    "README.md": "The software, where the data is from, and how to run each step again.",
    "SCHEMA.md": "Fields, classes and the identity key in words, with the figures behind them.",
    "FINDINGS.md": "Each class: how often it occurs, what it joins, and what should become of it.",
    "DECISIONS.md": "Choices that the owner made, when and why.",
    "VALIDATION.md": "What was checked, what failed, and each iteration.",
    "schema.yaml": "The schema that validate reads.",
    "conformance/": "Schemas that must fail.",
}


def init_project(name: str, location: str, force: bool = False) -> dict:
    """Create the entries; a folder that isn't empty raises FileExistsError unless force."""
    root = os.path.join(os.path.abspath(os.path.expanduser(location)), name)
    if os.path.isdir(root) and os.listdir(root) and not force:
        raise FileExistsError(f"{root} is not empty; --force writes into it")
    os.makedirs(root, exist_ok=True)
    for entry, purpose in ENTRIES.items():
        path = os.path.join(root, entry)
        if entry.endswith("/"):
            os.makedirs(path, exist_ok=True)
            path, text = os.path.join(path, ".gitkeep"), ""
        else:
            text = f"# {entry}\n# {purpose}\n" if entry.endswith(".yaml") else f"# {entry}\n\n{purpose}\n\nNot filled in yet.\n"
        with open(path, "w") as f:
            f.write(text)
    return {"root": root, "written": list(ENTRIES)}
