"""Strings of content blocks that are protocol: the blocks of a request are listed once from its root, by rows.

HOLDERS says which arrays hold blocks, NESTED which blocks hold further ones, KEPT which strings of a block stay as they are. Places
are written a/b, relative to what the row starts from.
"""

from __future__ import annotations

from dataclasses import dataclass

Path = tuple
CHAT, RESPONSES, ANTHROPIC = "openai_chat", "openai_responses", "anthropic_messages"
# Fixed values of the protocols.
ROLES = ("system", "developer", "user", "assistant", "tool", "function")


@dataclass(frozen=True)
class Row:
    """protocols and types that it is for (no types: any), a place, and what must stand at another place, if anything."""

    protocols: tuple[str, ...]
    types: tuple[str, ...]
    places: tuple[str, ...]
    given: tuple[str, str] | None = None


#: Elements of these arrays are messages, and the field of a message that holds blocks; '' for an array of blocks itself.
HOLDERS = (
    (RESPONSES, "input", "content"),
    (CHAT, "messages", "content"),
    (ANTHROPIC, "messages", "content"),
    (ANTHROPIC, "system", ""),
)
NESTED = (
    Row((ANTHROPIC,), ("tool_result",), ("content",)),
    Row((ANTHROPIC,), ("document",), ("source/content",), given=("source/type", "content")),
)
KEPT = (
    Row((CHAT, RESPONSES, ANTHROPIC), (), ("type",)),
    Row((ANTHROPIC,), ("tool_use", "server_tool_use"), ("id", "name")),
    Row((ANTHROPIC,), ("tool_result", "web_search_tool_result", "web_fetch_tool_result"), ("tool_use_id",)),
    Row((ANTHROPIC,), ("image", "document"), ("source/type", "source/media_type")),
    Row((ANTHROPIC,), ("image", "document"), ("source/data",), given=("source/type", "base64")),
    Row((ANTHROPIC,), ("image", "document"), ("source/url",), given=("source/type", "url")),
    Row((RESPONSES,), ("input_image",), ("image_url", "file_id")),
    Row((RESPONSES,), ("input_file",), ("file_data", "file_id", "file_url")),
    Row((CHAT,), ("image_url",), ("image_url", "image_url/url", "image_url/detail")),
    Row((CHAT,), ("input_audio",), ("input_audio/data", "input_audio/format")),
    Row((CHAT,), ("file",), ("file/file_data", "file/file_id")),
)


def is_message(x) -> bool:
    role = x.get("role") if isinstance(x, dict) else None
    return isinstance(x, dict) and (isinstance(role, str) and role in ROLES or x.get("type") == "message")


def value(x, place: str):
    for step in place.split("/"):
        x = x.get(step) if isinstance(x, dict) else None
    return x


def _fits(row: Row, protocol: str, block: dict) -> bool:
    return protocol in row.protocols and (not row.types or block.get("type") in row.types) and (row.given is None or value(block, row.given[0]) == row.given[1])


def listed(root, protocol: str) -> list[tuple[Path, dict]]:
    """(path, block) of all content blocks."""
    todo: list[tuple[Path, object]] = []
    for p, name, inner in HOLDERS:
        some = value(root, name) if p == protocol else None
        for k, x in enumerate(some if isinstance(some, list) else []):
            if not inner:
                todo.append(((name, k), x))
            elif is_message(x) and isinstance(x.get(inner), list):
                todo += [((name, k, inner, j), y) for j, y in enumerate(x[inner])]
    out: list[tuple[Path, dict]] = []
    while todo:
        path, block = todo.pop()
        if not isinstance(block, dict):
            continue
        out.append((path, block))
        for row in NESTED:
            some = value(block, row.places[0]) if _fits(row, protocol, block) else None
            todo += [((*path, *row.places[0].split("/"), k), x) for k, x in enumerate(some if isinstance(some, list) else [])]
    return out


def kept_strings(root, protocol: str) -> frozenset[Path]:
    """Paths of the strings of content blocks that stay."""
    return frozenset(
        (*path, *place.split("/"))
        for path, block in listed(root, protocol)
        for row in KEPT
        if _fits(row, protocol, block)
        for place in row.places
        if isinstance(value(block, place), str)
    )
