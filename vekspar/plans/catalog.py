"""Databases, spaces, aliases, users, roles and settings, kept as versions of one JSON file beside the data."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any

from pyspark.sql import SparkSession

from vekspar.errors import Code, EngineError, param
from vekspar.schema import Space
from vekspar.sources.files import Files

# Resources, privileges and the roles that are there from the start.
RESOURCES = ("ResourceAll", "ResourceCluster", "ResourceServer", "ResourcePartition", "ResourceDB", "ResourceSpace", "ResourceDocument", "ResourceIndex", "ResourceAlias", "ResourceUser", "ResourceRole", "ResourceConfig", "ResourceCache")
PRIVILEGES = ("None", "WriteOnly", "ReadOnly", "WriteRead")
ROLES: dict[str, dict[str, str]] = {
    "root": {"ResourceAll": "WriteRead"},
    "defaultClusterAdmin": {f"Resource{x}": "WriteRead" for x in ("Cluster", "Server", "Partition", "DB", "Space", "Document", "Index", "Alias", "Config", "User", "Role")},
    "defaultSpaceAdmin": {"ResourceSpace": "WriteRead", "ResourceDocument": "WriteRead", "ResourceIndex": "WriteRead", "ResourceAlias": "ReadOnly"},
    "defaultDocumentAdmin": {"ResourceDocument": "WriteRead", "ResourceIndex": "WriteRead"},
    "defaultReadDBSpaceEditDocument": {"ResourceCluster": "ReadOnly", "ResourceDB": "ReadOnly", "ResourceSpace": "ReadOnly", "ResourceDocument": "WriteRead", "ResourceIndex": "WriteRead", "ResourceAlias": "ReadOnly"},
    "defaultReadSpaceEditDocument": {"ResourceSpace": "ReadOnly", "ResourceDocument": "WriteRead", "ResourceIndex": "WriteRead", "ResourceAlias": "ReadOnly"},
}
CONFIG = {"request_limit": {"enabled": True, "total_read_limit": 1_000_000, "total_write_limit": 1_000_000}, "memory_limit": {"enabled": True, "router_percent": 90, "ps_percent": 90}, "slow_search_isolation": True}


def is_slow(limit: int, nprobe: int = 0, ncentroids: int = 0, conditions: int = 0) -> bool:
    """Whether a search belongs in the pool of slow ones (run it under spark.scheduler.pool)."""
    return limit >= 500 or conditions >= 3 or ncentroids > 0 and nprobe >= ncentroids / 10


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.files, self.path = Files(spark), f"{root.rstrip('/')}/catalog"
        self.version, self.begun, state = self.files.newest(self.path)
        self.state: dict[str, Any] = state or {"dbs": {}, "aliases": {}, "users": {"root": {"role": "root"}}, "roles": {}, "config": CONFIG}

    def _save(self) -> None:
        """The next version; an error if another session has changed the catalog since this one read it (open it again then)."""
        try:
            self.files.commit(self.path, self.begun + 1, json.dumps(self.state))
        except FileExistsError:
            raise EngineError(Code.INTERNAL_ERROR, "the catalog was changed by another session") from None
        self.begun += 1
        self.version = self.begun
        for v in range(max(1, self.version - 12), self.version - 8):
            self.files.delete(f"{self.path}-{v}.json")

    @staticmethod
    def _new(where: dict, name: str, code: Code) -> None:
        if not name:
            raise param("a name must not be empty")
        if name in where:
            raise EngineError(code, name)

    @staticmethod
    def _has(where: dict, name: str, code: Code) -> Any:
        if name not in where:
            raise EngineError(code, name)
        return where[name]

    def create_db(self, db: str) -> None:
        self._new(self.state["dbs"], db, Code.DB_EXIST)
        self.state["dbs"][db] = {}
        self._save()

    def drop_db(self, db: str) -> None:
        if self._has(self.state["dbs"], db, Code.DB_NOT_EXIST):
            raise EngineError(Code.DB_NOT_EMPTY, db)
        del self.state["dbs"][db]
        self._save()

    def rename_db(self, db: str, to: str) -> None:
        spaces = self._has(self.state["dbs"], db, Code.DB_NOT_EXIST)
        self._new(self.state["dbs"], to, Code.DB_EXIST)
        del self.state["dbs"][db]
        self.state["dbs"][to] = spaces
        self._save()

    def dbs(self) -> list[str]:
        return sorted(self.state["dbs"])

    def spaces(self, db: str) -> list[str]:
        return sorted(self._has(self.state["dbs"], db, Code.DB_NOT_EXIST))

    def put_space(self, db: str, space: Space, new: bool = False) -> None:
        own = self._has(self.state["dbs"], db, Code.DB_NOT_EXIST)
        if new:
            self._new(own, space.name, Code.SPACE_EXIST)
        own[space.name] = space.to_json()
        self._save()

    def space(self, db: str, name: str) -> Space:
        """By name or alias."""
        own = self._has(self.state["dbs"], db, Code.DB_NOT_EXIST)
        alias = self.state["aliases"].get(name)
        if name not in own and alias and alias["db"] == db:
            name = alias["space"]
        return Space.from_json(self._has(own, name, Code.SPACE_NOT_EXIST))

    def drop_space(self, db: str, name: str) -> None:
        own = self._has(self.state["dbs"], db, Code.DB_NOT_EXIST)
        self._has(own, name, Code.SPACE_NOT_EXIST)
        del own[name]
        self.state["aliases"] = {k: v for k, v in self.state["aliases"].items() if (v["db"], v["space"]) != (db, name)}
        self._save()

    def create_alias(self, alias: str, db: str, space: str) -> None:
        self._new(self.state["aliases"], alias, Code.ALIAS_EXIST)
        self.space(db, space)
        self.state["aliases"][alias] = {"db": db, "space": space}
        self._save()

    def modify_alias(self, alias: str, db: str, space: str) -> None:
        self._has(self.state["aliases"], alias, Code.ALIAS_NOT_EXIST)
        self.space(db, space)
        self.state["aliases"][alias] = {"db": db, "space": space}
        self._save()

    def alias(self, alias: str) -> dict[str, str]:
        return self._has(self.state["aliases"], alias, Code.ALIAS_NOT_EXIST)

    def drop_alias(self, alias: str) -> None:
        self.alias(alias)
        del self.state["aliases"][alias]
        self._save()

    def create_role(self, name: str, privileges: dict[str, str]) -> None:
        self._new(self.state["roles"] | ROLES, name, Code.ROLE_EXIST)
        self._check(privileges)
        self.state["roles"][name] = dict(privileges)
        self._save()

    @staticmethod
    def _check(privileges: dict[str, str]) -> None:
        if bad := [k for k, v in privileges.items() if k not in RESOURCES or v not in PRIVILEGES]:
            raise param(f"privileges {bad}")

    def modify_role(self, name: str, operator: str, privileges: dict[str, str]) -> None:
        role = self._has(self.state["roles"], name, Code.ROLE_NOT_EXIST)
        self._check(privileges)
        if operator not in ("Grant", "Revoke"):
            raise param(f"operator {operator!r}")
        for k, v in privileges.items():
            if operator == "Grant":
                role[k] = v
            else:
                role.pop(k, None)
        self._save()

    def role(self, name: str) -> dict[str, str]:
        return self._has(ROLES | self.state["roles"], name, Code.ROLE_NOT_EXIST)

    def drop_role(self, name: str) -> None:
        self._has(self.state["roles"], name, Code.ROLE_NOT_EXIST)
        del self.state["roles"][name]
        self._save()

    @staticmethod
    def _hashed(password: str, salt: str) -> str:
        return hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), 100_000).hex()

    def create_user(self, name: str, password: str, role: str) -> None:
        self._new(self.state["users"], name, Code.USER_EXIST)
        self.role(role)
        salt = os.urandom(16).hex()
        self.state["users"][name] = {"role": role, "salt": salt, "hash": self._hashed(password, salt)}
        self._save()

    def drop_user(self, name: str) -> None:
        self._has(self.state["users"], name, Code.USER_NOT_EXIST)
        del self.state["users"][name]
        self._save()

    def authenticate(self, name: str, password: str) -> None:
        u = self.state["users"].get(name)
        if not u or "hash" not in u or self._hashed(password, u["salt"]) != u["hash"]:
            raise EngineError(Code.AUTHENTICATION_FAILED, name)

    def authorize(self, user: str, resource: str, write: bool) -> None:
        """Raises unless the user's role may read or write the resource."""
        own = self.role(self._has(self.state["users"], user, Code.USER_NOT_EXIST)["role"])
        have = own.get(resource, own.get("ResourceAll", "None"))
        if have != "WriteRead" and have != ("WriteOnly" if write else "ReadOnly"):
            raise EngineError(Code.AUTHENTICATION_FAILED, f"{user} may not {'write' if write else 'read'} {resource}")

    def config(self) -> dict[str, Any]:
        return self.state["config"]

    def set_config(self, name: str, value: Any) -> None:
        if name not in CONFIG:
            raise EngineError(Code.CONFIG_ERROR, name)
        self.state["config"] = {**self.state["config"], name: value}
        self._save()
