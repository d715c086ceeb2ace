"""Texts for readers, made of the few rows that a ranked query gives."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame


def bundle(ranked: DataFrame, relations: DataFrame | None = None, shown: int = 20) -> str:
    """One target's ranked items, and its first relations, as text. The rows are bounded by the profile."""
    out = []
    for r in ranked.orderBy("rank").toLocalIterator():
        score = "direct" if r["relevance_score"] is None else f"relevance: {r['relevance_score']:.0%}"
        out.append(f"[{r['rank']}] {r['entity_type']} ({score}) {r['entity_id']}: {r['reason']}")
    if relations is not None:
        out += [f"{r['source_id']} --{r['relation_type']}--> {r['target_id']}" for r in relations.orderBy("rank").limit(shown).toLocalIterator()]
    return "\n".join(out)


def glossary_markdown(terms: DataFrame) -> str:
    """Terms (repo, term, n) of one repository under a heading each for their first letter."""
    out, head = [], None
    for r in terms.orderBy("term").toLocalIterator():
        if r["term"][0] != head:
            head = r["term"][0]
            out.append(f"## {head}")
        out.append(f"- **{r['term']}** ({r['n']})")
    return "\n".join(out)


def parse_terms(response: str | None, most: int = 15) -> dict[str, str]:
    """A generator's answer as terms and descriptions: a JSON object in a fenced block, else from the first brace to the last. Only pairs of non-empty text count; anything else gives none."""
    if not response:
        return {}
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", response, re.S)
    found = fenced[1] if fenced else response[response.find("{") : response.rfind("}") + 1]
    try:
        data = json.loads(found)
    except ValueError:
        return {}
    if not isinstance(data, dict):
        return {}
    pairs = [(k.strip(), v.strip()) for k, v in data.items() if isinstance(k, str) and isinstance(v, str)]
    return dict([(k, v) for k, v in pairs if k and v][:most])


def condense(samples: list[str], files: int = 10, chars: int = 500) -> str:
    """The first samples that are not blank, each cut, for a generator's prompt."""
    return "\n---\n".join(s[:chars] for s in [s for s in samples if s.strip()][:files])


class Lexicons:
    """Named lexicons: functions from a session to a table (keyword, description)."""

    def __init__(self):
        self._by_name: dict[str, Callable] = {}

    def register(self, name: str, make: Callable) -> None:
        self._by_name[name] = make

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def get(self, name: str, spark) -> DataFrame:
        """KeyError for a name that is not registered."""
        return self._by_name[name](spark)
