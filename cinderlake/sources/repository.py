"""A data source of repository files.

    spark.dataSource.register(RepositorySource)
    spark.read.format("repository").option("repo", "owner/name").load()

The driver lists the tree, in the order the service gives, takes the source files up to ``limit``
and deals them to tasks, which fetch the contents. Any failure to list gives no rows; a file that cannot
be fetched has empty code. Only the branch main is listed; contents fall back to master on 404.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import SKIPPED_PATH_PARTS, SOURCE_ENDINGS

TIMEOUT = 10
FILES_PER_TASK = 8
#: Body of a URL; raises OSError (urllib.error.HTTPError among others).
Fetch = Callable[[str, str | None], str]


def http_get(url: str, token: str | None) -> str:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return answer.read().decode("utf-8", "replace")


def wanted(path: str) -> bool:
    """As functions.text.is_source_path, for the driver's listing."""
    slashed = "/" + path.lower().lstrip("/")
    return path.endswith(SOURCE_ENDINGS) and not any(p in slashed for p in SKIPPED_PATH_PARTS)


def list_tree(repo: str, token: str | None, api: str, fetch: Fetch = http_get) -> list[str]:
    try:
        tree = json.loads(fetch(f"{api}/repos/{repo}/git/trees/main?recursive=1", token)).get("tree", [])
        return [e["path"] for e in tree if e.get("type") == "blob" and wanted(e["path"])]
    except (OSError, ValueError, AttributeError, KeyError, TypeError):
        return []


def fetch_file(repo: str, path: str, token: str | None, raw: str, fetch: Fetch = http_get) -> str:
    for branch in ("main", "master"):
        try:
            return fetch(f"{raw}/{repo}/{branch}/{path}", token)
        except urllib.error.HTTPError as e:
            if e.code != 404:
                return ""
        except (OSError, ValueError):
            return ""
    return ""


@dataclass
class _Files(InputPartition):
    files: list[tuple[int, str]]


class RepositoryReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repo, self.token = options["repo"], options.get("token")
        self.api = options.get("api", "https://api.github.com")
        self.raw = options.get("raw", "https://raw.githubusercontent.com")
        self.limit = int(options.get("limit", "30"))

    def partitions(self) -> list[InputPartition]:
        files = list(enumerate(list_tree(self.repo, self.token, self.api)[: self.limit]))
        return [_Files(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for pos, path in partition.files:
            yield self.repo, pos, path, fetch_file(self.repo, path, self.token, self.raw)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "repo string, pos int, filepath string, code string"

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options)
