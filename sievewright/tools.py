"""The tools of a workspace by name, for callers that send arguments as JSON and want the answer as JSON."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import UTC, date, datetime

from sievewright.workspace import Workspace


@dataclass(frozen=True)
class Argument:
    """An argument as callers name it, the parameter of the method, its type, and if it must be there."""

    name: str
    parameter: str
    kind: type
    required: bool = False


def _needs(name: str, kind: type, parameter: str = "") -> Argument:
    return Argument(name, parameter or name, kind, True)


_BOX = Argument("mailbox", "box", str)
_FLAGGED = Argument("include_flagged_content", "include_flagged", bool)
_PAGE = (Argument("offset", "offset", int), Argument("limit", "limit", int))
_UID = _needs("uid", int)
_SOURCE = ("mailbox", "uid", "attachment_index", "sha256", "saved_path")

# Names of tools and of their arguments.
TOOLS: dict[str, tuple[str, tuple[Argument, ...]]] = {
    "list_messages": ("list_messages", (_BOX, Argument("limit", "limit", int), Argument("unseen_only", "unseen_only", bool), Argument("since_uid", "since_uid", int), Argument("since_date", "since_date", str), _FLAGGED)),
    "read_message": ("read_message", (_UID, _BOX, Argument("body_offset", "offset", int), Argument("body_limit", "limit", int), _FLAGGED)),
    "read_attachment": ("read_attachment", (_UID, _needs("attachment_index", int, "index"), _BOX, *_PAGE, _FLAGGED)),
    "read_quarantined": ("read_quarantined", (_UID, Argument("attachment_index", "index", int), _BOX, *_PAGE)),
    "save_attachment": ("save_attachment", (_UID, _needs("attachment_index", int, "index"), _BOX, Argument("filename", "name", str))),
    "get_attached_erechnung": ("get_attached_invoice", (_UID, Argument("attachment_index", "index", int), _BOX)),
    "add_registry": ("add_registry", (_needs("registry", str, "name"), _needs("description", str), Argument("fields", "fields", list))),
    "registries": ("registries", ()),
    "record_entry": ("record_entry", (_needs("registry", str), _needs("key", str), _needs("fields", dict), Argument("mailbox", "mailbox", str), *[Argument(n, n, int) for n in _SOURCE[1:3]], *[Argument(n, n, str) for n in _SOURCE[3:]])),
    "list_entries": ("list_entries", (_needs("registry", str), Argument("limit", "limit", int))),
    "remove_entry": ("remove_entry", (_needs("registry", str), _needs("key", str))),
    "drop_registry": ("drop_registry", (_needs("registry", str),)),
    "get_cursor": ("get_cursor", (_BOX,)),
    "set_cursor": ("set_cursor", (_needs("last_uid", int), _needs("uid_validity", int), _BOX)),
}


def typed(value: object, kind: type) -> object:
    """The value under its type, or None: a number may come as a whole or broken one, which is cut; lists and objects as JSON text as well; an empty text is none."""
    if kind is int:
        return int(value) if isinstance(value, int | float) and not isinstance(value, bool) and value == value and abs(value) < 1 << 63 else None
    if kind in (list, dict) and isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    return value if isinstance(value, kind) and value != "" else None


def encoded(value: object) -> str:
    """An answer as indented JSON; moments in UTC, bytes as base64."""

    def other(x: object) -> str:
        if isinstance(x, datetime):
            return (x.astimezone(UTC) if x.tzinfo else x).strftime("%Y-%m-%dT%H:%M:%SZ")
        if isinstance(x, date):
            return x.isoformat()
        if isinstance(x, bytes | bytearray):
            return base64.b64encode(bytes(x)).decode()
        raise TypeError(type(x).__name__)

    return json.dumps(value, indent=2, ensure_ascii=False, default=other)


def call(workspace: Workspace, tool: str, arguments: dict | str | None = None) -> tuple[str, bool]:
    """(answer as JSON, or what is wrong as text; if it went wrong). An argument of another type counts as not given; unknown ones are ignored."""
    if tool not in TOOLS:
        return f"no tool {tool!r}", True
    method, known = TOOLS[tool]
    given = typed(arguments or {}, dict)
    if given is None:
        return "the arguments are no object", True
    values = {a.parameter: v for a in known if (v := typed(given.get(a.name), a.kind)) is not None}
    if missing := [a.name for a in known if a.required and a.parameter not in values]:
        return f"{', '.join(missing)} must be given", True
    if tool == "record_entry":
        source = {n: values.pop(n) for n in _SOURCE if n in values}
        values["source"] = source or None
    try:
        return encoded(getattr(workspace, method)(**values)), False
    except (ValueError, LookupError, OSError) as e:
        return str(e), True
