"""Users, passwords and column-level grants, kept as one JSON file."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets
from pathlib import Path

from .errors import PermissionDenied, UserError


class Auth:
    def __init__(self, path: Path):
        self.path = path
        self.users: dict[str, dict] = {}
        self.sessions: dict[str, str] = {}
        if path.exists():
            self.users = json.loads(path.read_text())

    def _save(self) -> None:
        tmp = self.path.with_suffix(".tmp")
        tmp.write_text(json.dumps(self.users, sort_keys=True))
        os.replace(tmp, self.path)

    @staticmethod
    def _hash(password: str, salt: bytes) -> str:
        return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1).hex()

    def create(self, user: str, password: str, admin: bool = False) -> None:
        if user in self.users:
            raise UserError(f"user exists: {user}")
        salt = secrets.token_bytes(16)
        self.users[user] = {"salt": salt.hex(), "hash": self._hash(password, salt), "grants": [], "admin": admin}
        self._save()

    def is_admin(self, user: str | None) -> bool:
        """The owner (None) is one, too."""
        return user is None or self._user(user).get("admin", False)

    def need_admin(self, user: str | None, what: str) -> None:
        if not self.is_admin(user):
            raise PermissionDenied(f"{user}: {what} is for administrators")

    def need_owner(self, user: str | None, table: str, what: str) -> None:
        """An administrator, or a user with ALL on the whole table."""
        if not self.is_admin(user) and not any(g["kind"] == "ALL" and g["table"] == table.lower() and g["columns"] is None for g in self._user(user)["grants"]):
            raise PermissionDenied(f"{user}: {what} on {table}")

    def user_of(self, token: str) -> str:
        if token not in self.sessions:
            raise PermissionDenied("no such session")
        return self.sessions[token]

    def logout(self, token: str) -> None:
        self.sessions.pop(token, None)

    def forget(self, table: str) -> None:
        """Grants on a dropped table go with it."""
        for own in self.users.values():
            own["grants"] = [g for g in own["grants"] if g["table"] != table.lower()]
        self._save()

    def alter(self, user: str, password: str) -> None:
        former = self._user(user)
        del self.users[user]
        self.create(user, password, former.get("admin", False))
        self.users[user]["grants"] = former["grants"]
        self._save()

    def drop(self, user: str) -> None:
        self._user(user)
        del self.users[user]
        self.sessions = {t: u for t, u in self.sessions.items() if u != user}
        self._save()

    def login(self, user: str, password: str) -> str:
        found = self._user(user)
        if not hmac.compare_digest(found["hash"], self._hash(password, bytes.fromhex(found["salt"]))):
            raise PermissionDenied(f"wrong password: {user}")
        token = secrets.token_urlsafe(16)
        self.sessions[token] = user
        return token

    def _user(self, user: str) -> dict:
        if user not in self.users:
            raise UserError(f"no such user: {user}")
        return self.users[user]

    def grant(self, user: str, kind: str, table: str, columns: list[str] | None) -> None:
        """A new grant of a kind on a table replaces the former one."""
        own = self._user(user)
        own["grants"] = [g for g in own["grants"] if (g["kind"], g["table"]) != (kind, table.lower())]
        own["grants"].append({"kind": kind, "table": table.lower(), "columns": sorted(c.lower() for c in columns) if columns else None})
        self._save()

    def revoke(self, user: str, kind: str, table: str, columns: list[str] | None) -> None:
        """Takes back the grant with the very same columns."""
        own = self._user(user)
        gone = {"kind": kind, "table": table.lower(), "columns": sorted(c.lower() for c in columns) if columns else None}
        own["grants"] = [g for g in own["grants"] if g != gone]
        self._save()

    def check(self, user: str | None, kind: str, table: str, columns: list[str]) -> None:
        """The owner (None) and administrators may do all."""
        if self.is_admin(user):
            return
        for g in self._user(user)["grants"]:
            if g["table"] == table.lower() and g["kind"] in (kind, "ALL"):
                if g["columns"] is None or set(c.lower() for c in columns) <= set(g["columns"]):
                    return
        raise PermissionDenied(f"{user}: {kind} on {table}({', '.join(columns)})")
