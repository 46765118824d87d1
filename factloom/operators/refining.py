"""Filters of evidence cards by named fields: one conjunction, without a search of its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain

#: The columns of a card; roles is an array of (role, name), times are ISO text or timestamps.
FIELDS = {
    "source_type": "string", "type": "string", "kind": "string", "modality": "string", "role": "string", "session_id": "string", "status": "string", "quantity_unit": "string", "content": "string", "content_preview": "string",
    "predicate_raw": "string", "predicate_canonical": "string", "roles": "array<struct<role:string,name:string>>", "confidence": "double", "occurred": "string", "created": "string", "valid_from": "string", "valid_until": "string",
}


@dataclass(frozen=True)
class CardFilter:
    """What cards have to be. Empty fields ask for nothing; a limit that is no ISO date or time limits nothing.

    channels add to source_types and types to event_types, which match a card's type or kind.
    entity stands in the content or a role; entity_roles asks, for each role, for one of the names in it.
    Cards without a time fall out of occurred and created limits and stay within valid ones.
    """

    source_types: Sequence[str] = ()
    channels: Sequence[str] = ()
    event_types: Sequence[str] = ()
    types: Sequence[str] = ()
    modalities: Sequence[str] = ()
    kinds: Sequence[str] = ()
    source_roles: Sequence[str] = ()
    session_id: str = ""
    status: Sequence[str] | str = ()
    quantity_units: Sequence[str] = ()
    entity: str = ""
    entity_roles: Mapping[str, Sequence[str] | str] = field(default_factory=dict)
    min_confidence: float | None = None
    occurred_from: str | None = None
    occurred_to: str | None = None
    created_from: str | None = None
    created_to: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None
    include_terms: Sequence[str] = ()
    exclude_terms: Sequence[str] = ()


def _several(value: Sequence[str] | str) -> list[str]:
    return [value] if isinstance(value, str) and value else list(value)


def _limit(value: str | None) -> Column | None:
    try:
        return F.lit(datetime.fromisoformat(value).replace(tzinfo=None)).cast("timestamp_ntz") if value else None
    except ValueError:
        return None


def _within(name: str, low: str | None, high: str | None, missing: bool) -> list[Column]:
    at, first, last = F.col(name).try_cast("timestamp_ntz"), _limit(low), _limit(high)
    asked = ([at >= first] if first is not None else []) + ([at <= last] if last is not None else [])
    return [F.coalesce(c, F.lit(missing)) for c in asked]


def matches(wanted: CardFilter) -> Column:
    """Whether a card (with the columns of FIELDS) is what is wanted; never null."""
    has = lambda text, term: text.contains(str(term).lower())
    names = lambda role=None: F.transform(F.filter(F.coalesce("roles", F.array()), lambda r: r["name"].isNotNull() & (F.lit(True) if role is None else r["role"] == role)), lambda r: r["name"])
    among = lambda name, values: F.col(name).isin(*values)
    conditions = [among(c, v) for c, v in (
        ("source_type", [*_several(wanted.source_types), *_several(wanted.channels)]), ("modality", _several(wanted.modalities)), ("kind", _several(wanted.kinds)), ("role", _several(wanted.source_roles)),
        ("session_id", _several(wanted.session_id)), ("status", _several(wanted.status)), ("quantity_unit", _several(wanted.quantity_units)),
    ) if v]
    if sorts := [*_several(wanted.event_types), *_several(wanted.types)]:
        conditions.append(F.coalesce(among("type", sorts), F.lit(False)) | F.coalesce(among("kind", sorts), F.lit(False)))
    if wanted.entity:
        conditions.append(has(F.lower(F.concat_ws(" ", "content", "content_preview", names())), wanted.entity))
    for role, some in wanted.entity_roles.items():
        text = F.lower(F.array_join(names(role), " "))
        conditions.append((F.size(names(role)) > 0) & reduce(lambda a, b: a | b, (has(text, s) for s in _several(some)), F.lit(False)))
    if wanted.min_confidence is not None:
        conditions.append(F.coalesce("confidence", F.lit(0.0)) >= wanted.min_confidence)
    conditions += _within("occurred", wanted.occurred_from, wanted.occurred_to, False) + _within("created", wanted.created_from, wanted.created_to, False)
    conditions += _within("valid_from", wanted.valid_from, None, True) + _within("valid_until", None, wanted.valid_to, True)
    roles = F.array_join(F.transform(F.coalesce("roles", F.array()), lambda r: F.concat_ws(" ", r["role"], r["name"])), " ")
    hay = F.lower(F.concat_ws(" ", *(plain(F.col(c)) for c in ("content", "content_preview", "predicate_raw", "predicate_canonical", "type", "kind", "modality")), roles))
    conditions += [has(hay, t) for t in wanted.include_terms] + [~has(hay, t) for t in wanted.exclude_terms]
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), conditions, F.lit(True))


def cards(rows: DataFrame) -> DataFrame:
    """rows with those columns of FIELDS that they lack, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in FIELDS.items() if c not in rows.columns})


def refine_cards(rows: DataFrame, wanted: CardFilter) -> DataFrame:
    """The rows whose cards are what is wanted, with the rows' own columns."""
    return cards(rows).where(matches(wanted)).select(*rows.columns)
