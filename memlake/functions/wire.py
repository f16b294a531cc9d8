"""Job lines and plans as they come over the wire: JSON with loosely written keys and strict types.

Keys match in any case and the last of equal ones wins; unknown keys are passed over; null leaves a field as it was. A
value of another type makes the whole text faulty. Nothing but one JSON value may stand in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from memlake.schema import ACTION, MESSAGES, PLAN_CORE, PLAN_GENERAL, PLAN_REASONING

NOT_JSON, NOT_OBJECT, WRONG_TYPE = "not JSON", "not an object", "wrong type"


class _Object(list):
    """A JSON object as the list of its (key, value) pairs, repeated keys included."""


class _Fault(Exception):
    """The reason why a text is faulty."""


def _refuse(constant: str):
    raise ValueError(constant)


Decode = Callable[[str], object]


def _decoder() -> Decode:
    """A decoder for many texts, for json.loads with hooks makes one for each."""
    return json.JSONDecoder(object_pairs_hook=_Object, parse_int=float, parse_constant=_refuse).decode


def _loads(text: str | None, decode: Decode | None) -> _Object | None:
    """The object in `text`; None for a JSON null."""
    try:
        value = (decode or _decoder())(text or "")
    except (ValueError, RecursionError):
        raise _Fault(NOT_JSON) from None
    if value is not None and not isinstance(value, _Object):
        raise _Fault(NOT_OBJECT)
    return value


def _text(value):
    if not isinstance(value, str):
        raise _Fault(WRONG_TYPE)
    # A lone surrogate is no character.
    return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(value):
    if not isinstance(value, float):
        raise _Fault(WRONG_TYPE)
    return value


def _list_of(**kinds):
    def read(value):
        if not isinstance(value, list) or isinstance(value, _Object):
            raise _Fault(WRONG_TYPE)
        return [_fields(item, **kinds) for item in value]

    return read


def _fields(value, **kinds) -> dict:
    """The named fields of an object, each read by its kind; None where the field is missing or null."""
    found = dict.fromkeys(kinds)
    if value is None:
        return found
    if not isinstance(value, _Object):
        raise _Fault(WRONG_TYPE)
    names = {name.lower(): name for name in kinds}
    for key, inner in value:
        name = names.get(key.lower())
        if name is not None and inner is not None:
            found[name] = kinds[name](inner)
        elif name is not None and kinds[name] is not _text and kinds[name] is not _number:
            found[name] = None
    return found


_MESSAGES = _list_of(role=_text, content=_text)
_ACTIONS = _list_of(action_type=_text, payload=_text, target_memory_id=_text)


def read_job(line: str | None, decode: Decode | None = None) -> dict:
    """ReqId, UserId, Messages and Threshold of a job line, zero values where missing, and `reason`, null if good."""
    try:
        found = _fields(_loads(line, decode), ReqId=_text, UserId=_text, Messages=_MESSAGES, Threshold=_number)
    except _Fault as fault:
        return {"req_id": "", "user_id": "", "messages": None, "threshold": 0.0, "reason": str(fault)}
    messages = found["Messages"]
    if messages is not None:
        messages = [{name: text or "" for name, text in message.items()} for message in messages]
    return {
        "req_id": found["ReqId"] or "",
        "user_id": found["UserId"] or "",
        "messages": messages,
        "threshold": found["Threshold"] or 0.0,
        "reason": None,
    }


def read_plan(text: str | None, accept_underscore_keys: bool = True, decode: Decode | None = None) -> dict:
    """The core and the general actions of a plan, and `reason`, null if good."""
    kinds = {PLAN_CORE: _ACTIONS, PLAN_GENERAL: _ACTIONS, PLAN_REASONING: _text}
    if accept_underscore_keys:
        kinds |= {key.replace(" ", "_"): kind for key, kind in kinds.items()}
    try:
        loaded = _loads(text, decode)
        found = _fields(loaded, **kinds)
    except _Fault as fault:
        return {"core": None, "general": None, "reason": str(fault)}
    if loaded is None:
        return {"core": None, "general": None, "reason": NOT_OBJECT}

    def listed(key: str):
        actions = found[key]
        return found.get(key.replace(" ", "_")) if actions is None else actions

    return {"core": listed(PLAN_CORE), "general": listed(PLAN_GENERAL), "reason": None}


def job_of(line: Column | str) -> Column:
    """:func:`read_job` of a column of lines, in Arrow batches."""

    return _read(line, read_job, f"req_id string, user_id string, messages {MESSAGES}, threshold double, reason string")


def plan_of(text: Column | str, accept_underscore_keys: bool = True) -> Column:
    """:func:`read_plan` of a column of plans, in Arrow batches."""

    fields = f"core array<{ACTION}>, general array<{ACTION}>, reason string"
    return _read(text, lambda x, decode: read_plan(x, accept_underscore_keys, decode), fields)


def _read(text: Column | str, reader: Callable[[str | None, Decode], dict], fields: str) -> Column:
    kind = to_arrow_type(StructType.fromDDL(fields))

    @F.arrow_udf(fields)
    def read(texts: pa.Array) -> pa.Array:
        decode = _decoder()
        return pa.array([reader(x, decode) for x in texts.to_pylist()], kind)

    return read(text)
