"""Registries of work-item and source-control adapters, their configuration checks and listing."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Hosts of source control and their adapter (fixed values).
HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}


@dataclass
class Factory:
    create: Callable[[dict], Any]
    title: str = ""
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    """Adapters by name: made ones and factories. A factory's description wins over an instance's."""

    kind: str
    instances: dict[str, Any] = field(default_factory=dict)
    factories: dict[str, Factory] = field(default_factory=dict)

    def register(self, name: str, adapter: Any, replace: bool = False) -> None:
        if name in self.instances and not replace:
            raise KeyError(f"{name} is registered already")
        self.instances[name] = adapter

    def add_factory(self, name: str, factory: Factory, replace: bool = False) -> None:
        if name in self.factories and not replace:
            raise KeyError(f"{name} has a factory already")
        self.factories[name] = factory

    def get(self, name: str) -> Any | None:
        return self.instances.get(name)

    def has(self, name: str) -> bool:
        return name in self.instances or name in self.factories

    def remove(self, name: str) -> bool:
        return self.instances.pop(name, None) is not None

    def remove_factory(self, name: str) -> bool:
        return self.factories.pop(name, None) is not None

    def create(self, name: str, config: dict) -> Any:
        factory = self.factories[name]
        missing = [k for k in factory.needs if not config.get(k)]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        return factory.create(config)

    def get_or_create(self, name: str, config: dict) -> Any:
        if name not in self.instances:
            self.instances[name] = self.create(name, config)
        return self.instances[name]

    def available(self) -> list[tuple[str, str, str, bool]]:
        """(kind, name, title, made): factories first, then instances without one."""
        made = [(self.kind, n, f.title, n in self.instances) for n, f in self.factories.items()]
        return made + [(self.kind, n, getattr(a, "title", ""), True) for n, a in self.instances.items() if n not in self.factories]


def listing(spark: SparkSession, *registries: Registry) -> DataFrame:
    rows = [r for g in registries for r in g.available()]
    return spark.createDataFrame(rows, "type string, name string, title string, made boolean")


def test_connection(spark: SparkSession, registry: Registry, name: str, config: dict) -> DataFrame:
    """(name, connected, message): whether an adapter can be made and its first row be read; never raises."""
    try:
        made = registry.get_or_create(name, config)
        made(spark).limit(1).collect()
        row = (name, True, "connected")
    except KeyError:
        row = (name, False, f"there is no adapter {name}")
    except Exception as e:  # any failure of a source is an answer here
        row = (name, False, str(e).split("\n")[0])
    return spark.createDataFrame([row], "name string, connected boolean, message string")


def memory_source(rows: list[tuple], schema: str) -> Callable[[SparkSession], DataFrame]:
    """A source that is seeded with rows, to stand in for an external one."""
    return lambda spark: spark.createDataFrame(rows, schema)


def scm_adapter(url: str) -> str | None:
    """Adapter of an address by its host."""
    return HOSTS.get((urlparse(url).hostname or "").removeprefix("www."))


def config_problems(config: dict, known: tuple[str, ...] = ("token", "databases", "base", "timeout")) -> list[str]:
    """What is wrong with a connector's configuration: unknown keys, a token without one of its prefixes, ids, timeouts."""
    out = [f"unknown key {k}" for k in config if k not in known]
    token = config.get("token", "")
    if token and not re.match(r"(secret_|ntn_)", token):
        out.append("the token has no known prefix")
    out += [f"not a database id: {x}" for x in config.get("databases", []) if not re.fullmatch(r"[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}", x)]
    if not 0 < config.get("timeout", 30) <= 600:
        out.append("the timeout is out of range")
    return out


def built_in() -> tuple[Registry, Registry]:
    """Work items from JSON and from pages, and one host of source control."""
    from vocabula.sources import imports

    items, scm = Registry("pm"), Registry("scm")
    items.add_factory("json", Factory(lambda c: lambda spark: imports.work_items(spark, c.get("path"), c.get("text")), "JSON import"))
    items.add_factory("pages", Factory(lambda c: lambda spark: spark.read.format("pages").options(**c).load(), "Pages of a database", ("base", "databases")))
    scm.add_factory("github", Factory(lambda c: lambda spark: imports.pull_requests(spark, c["path"]), "Pull requests", ("path",)))
    return items, scm
