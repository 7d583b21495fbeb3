"""Snapshot tables kept as Parquet: git is asked once, whatever reads them afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from gatehouse.sources import repositories


@dataclass
class Snapshot:
    """The tables of ``repositories`` for one list of repositories; those about a base are None without one."""

    repos: DataFrame
    index: DataFrame
    files: DataFrame
    commits: DataFrame
    objects: DataFrame
    identities: DataFrame
    bases: DataFrame | None = None
    changes: DataFrame | None = None
    versions: DataFrame | None = None

    def configs(self, name: str) -> DataFrame:
        """``repo_id, content, error`` of the file ``name`` of each repository that has one."""
        return self.files.where(self.files["path"] == name).select("repo_id", "content", "error")


def stored(table: DataFrame, path: str) -> DataFrame:
    """``table`` written to ``path`` and read back. An existing one is an error: a snapshot is of one moment."""
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def snapshot(repos: DataFrame, folder: str, since: bool = False, parts: int = 1) -> Snapshot:
    """All tables of ``repos(repo_id, path)`` under ``folder``, which executors share; with a ``base`` column also those about each repository's base.

    Commits and objects are of all history, unless ``since`` asks for those after the base alone. The caller deletes the folder when nothing reads it any more.
    """
    based = "base" in repos.columns
    history = repos if since else repos.drop("base")
    read = {"repos": repositories.read_repositories(repos), "index": repositories.read_index(repos), "files": repositories.read_files(repos, parts), "commits": repositories.read_commits(history), "objects": repositories.read_objects(history), "identities": repositories.read_identities(repos)}
    if based:
        read |= {"bases": repositories.read_bases(repos), "changes": repositories.read_changes(repos), "versions": repositories.read_versions(repos)}
    return Snapshot(**{name: stored(df, f"{folder.rstrip('/')}/{name}") for name, df in read.items()})
