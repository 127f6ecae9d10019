"""Helper columns beside columns of any names."""

from __future__ import annotations

from collections.abc import Iterable


def free(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it from being one of ``columns`` in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
