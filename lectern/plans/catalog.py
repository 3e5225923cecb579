"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

from lectern.plans import anchors, captions, concepts, course, frames, harvest, lint, markdown, sources, terms

MODULES = (captions, terms, anchors, markdown, lint, concepts, course, harvest, frames, sources)


def queries():
    out = {}
    for m in MODULES:
        for name, fn in m.REG.queries.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = fn
    return out


def oracles():
    return {name: sql for m in MODULES for name, sql in m.REG.oracles.items()}


def group_of(name: str) -> str:
    return next(m.__name__.rsplit(".", 1)[1] for m in MODULES if name in m.REG.queries)
