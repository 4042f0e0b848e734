"""Signed keyset cursors, made and read on the driver."""

from __future__ import annotations

import hashlib
import hmac
import struct
import uuid

VERSION = 1


def _mark(key: bytes, body: bytes, scope: str, digest: str) -> bytes:
    return hmac.new(key, body + b"\x1f" + scope.encode() + b"\x1f" + digest.encode(), hashlib.sha256).digest()


def encode(key: bytes, created: int, row_id: str, scope: str, digest: str) -> str:
    """A cursor after (created, id), bound to a scope and a filter's digest."""
    body = struct.pack(">BQ16s", VERSION, created, uuid.UUID(row_id).bytes)
    return (body + _mark(key, body, scope, digest)).hex()


def decode(key: bytes, cursor: str, scope: str, digest: str) -> tuple[int, str]:
    """(created, id); ValueError if the cursor was made otherwise."""
    raw = bytes.fromhex(cursor)
    body, mark = raw[:25], raw[25:]
    if len(raw) != 57 or not hmac.compare_digest(mark, _mark(key, body, scope, digest)):
        raise ValueError("the cursor does not belong here")
    version, created, row_id = struct.unpack(">BQ16s", body)
    if version != VERSION:
        raise ValueError("the cursor is of another version")
    return created, str(uuid.UUID(bytes=row_id))
