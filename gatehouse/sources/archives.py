"""Rows written out as Git repositories, for stores that keep texts and want what Git tells about them."""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.sources.staging import staged

ARCHIVES = "repo_id string, path string, error string"
_SETTINGS = ("-c", "commit.gpgsign=false", "-c", "core.autocrlf=false", "-c", "core.quotepath=false")


class _Writer:
    """One repository, written revision by revision."""

    def __init__(self, at: str, author: str) -> None:
        name, _, mail = author.partition(" <")
        self.at, self.who = at, ("-c", f"user.name={name}", "-c", f"user.email={mail.rstrip('>')}")
        os.makedirs(at)
        self._git("init", "-q", "-b", "main")

    def _git(self, *args: str) -> None:
        subprocess.run(["git", "-C", self.at, *_SETTINGS, *self.who, *args], capture_output=True, check=True)

    def put(self, path: str, content: bytes | None) -> None:
        full = os.path.normpath(os.path.join(self.at, path))
        if not full.startswith(self.at + os.sep) or full.startswith(os.path.join(self.at, ".git")):
            raise ValueError("path leaves the repository")
        if content is None:
            os.unlink(full)
            return
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content)

    def commit(self, revision: int, origin: str | None) -> None:
        self._git("add", "-A")
        self._git("commit", "-q", "--allow-empty", "-m", f"revision {revision}")
        if revision == 0:
            self._git("update-ref", "refs/remotes/origin/main", "HEAD")
            if origin:
                self._git("remote", "add", "origin", origin)


def write_archives(rows: DataFrame, folder: str, worktree: int, author: str = "Archive <archive@example.invalid>", origin: str | None = None) -> DataFrame:
    """``repo_id, path, error`` of repositories under ``folder`` (a path that executors share) made of ``rows(repo_id, revision, path, content)``.

    Revisions are committed in ascending order from 0, which is also origin's branch ``main``; those from ``worktree`` on stay uncommitted. A null content deletes the file.
    A repository is streamed by one task, a file at a time; each attempt of a task writes folders of its own, and the returned table is staged, so nothing is written twice
    for its readers. What can't be written is an error row and its repository incomplete.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        writer, repo, revision, fault = None, None, 0, None

        def close() -> None:
            nonlocal fault
            try:
                if writer is not None and fault is None and revision < worktree:
                    writer.commit(revision, origin)
            except (OSError, subprocess.CalledProcessError) as e:
                fault = type(e).__name__
            if writer is not None:
                done.append((repo, writer.at, fault))

        for batch in batches:
            for repo_id, at, path, content in batch[["repo_id", "revision", "path", "content"]].itertuples(index=False):
                if writer is None or repo_id != repo:
                    close()
                    writer, repo, revision, fault = _Writer(os.path.join(folder, f"{uuid.uuid4().hex}"), author), repo_id, 0, None
                if fault is not None:
                    continue
                try:
                    while revision < at:
                        if revision < worktree:
                            writer.commit(revision, origin)
                        revision += 1
                    writer.put(path, content)
                except (OSError, ValueError, subprocess.CalledProcessError) as e:
                    fault = type(e).__name__
        close()
        yield pd.DataFrame(done, columns=["repo_id", "path", "error"], dtype=object)

    wanted = rows.select(F.col("repo_id").cast("string"), F.col("revision").cast("int"), F.col("path").cast("string"), F.col("content").cast("binary"))
    return staged(wanted.repartition("repo_id").sortWithinPartitions("repo_id", "revision", "path").mapInPandas(run, ARCHIVES), "archives")
