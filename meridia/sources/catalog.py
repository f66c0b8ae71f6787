"""Small versioned catalogs on the driver: segments, journeys, sources and tokens."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import secrets
from dataclasses import dataclass, field

from ..operators import journeys
from ..plans import rules


@dataclass
class Version:
    number: int
    body: dict
    created_at: dt.datetime
    meta: object


@dataclass
class Entry:
    name: str
    status: str = "active"
    versions: list[Version] = field(default_factory=list)
    updated_at: dt.datetime | None = None

    @property
    def current(self) -> Version:
        return self.versions[-1]


class Catalog:
    """Named entries per tenant with immutable versions; an edit appends a version and reactivates."""

    def __init__(self) -> None:
        self.entries: dict[tuple[str, str], Entry] = {}

    def _meta(self, body: dict) -> object:
        raise NotImplementedError

    def put(self, tenant: str, key: str, name: str, body: dict, at: dt.datetime) -> Version:
        meta = self._meta(body)
        clash = [k for (t, k), e in self.entries.items() if t == tenant and k != key and e.name == name and e.status == "active"]
        if clash:
            raise rules.RuleError(f"name {name!r} is in use")
        entry = self.entries.setdefault((tenant, key), Entry(name))
        entry.versions.append(Version(len(entry.versions) + 1, body, at, meta))
        entry.name, entry.status, entry.updated_at = name, "active", at
        return entry.current

    def deactivate(self, tenant: str, key: str, at: dt.datetime) -> None:
        entry = self.entries[tenant, key]
        entry.status, entry.updated_at = "inactive", at

    def active(self, tenant: str) -> dict[str, Version]:
        return {k: e.current for (t, k), e in self.entries.items() if t == tenant and e.status == "active"}

    def version(self, tenant: str, key: str, number: int) -> Version:
        return self.entries[tenant, key].versions[number - 1]

    def epoch(self) -> tuple[int, dt.datetime | None, int]:
        """Changes whenever an active rule does; parsed rules may be kept while it is the same."""
        live = [e for e in self.entries.values() if e.status == "active"]
        return len(live), max((e.updated_at for e in live), default=None), sum(e.current.number for e in live)


class Segments(Catalog):
    def _meta(self, body: dict) -> rules.Analysis:
        return rules.analyze(rules.parse(body))


class Journeys(Catalog):
    def _meta(self, body: dict) -> tuple[list[str], int]:
        return journeys.metadata(journeys.parse(body))


@dataclass
class Key:
    hash: str
    owner: str
    disabled: bool = False


class Keys:
    """API keys and admin tokens: only hashes are kept, and compared in constant time."""

    def __init__(self, prefix: str):
        self.prefix, self.keys = prefix, {}

    @staticmethod
    def digest(key: str) -> str:
        return hashlib.sha256(key.encode()).hexdigest()

    def issue(self, owner: str) -> str:
        key = f"{self.prefix}_{secrets.token_urlsafe(32)}"
        self.keys[self.digest(key)] = Key(self.digest(key), owner)
        return key

    def rotate(self, owner: str) -> str:
        self.disable(owner)
        return self.issue(owner)

    def disable(self, owner: str) -> None:
        for k in self.keys.values():
            if k.owner == owner:
                k.disabled = True

    def owner(self, key: str) -> str | None:
        found = self.keys.get(self.digest(key))
        ok = found is not None and not found.disabled and hmac.compare_digest(found.hash, self.digest(key))
        return found.owner if ok else None
