"""Snapshot tables of Git repositories, read by tasks: a repository is one row of the input, or several ranges of one.

``repos`` has ``repo_id, path`` and may have ``base``, a revision: commits, objects, changes and versions are then those since it, where it isn't null. Paths must be readable
from the executors, as on a shared file system; a path inside a repository stands for the whole of it. What git or the disk can't tell is a row with an
``error``, never an empty result: with a ``path`` it is of that file, without one of everything that was asked. Batches are bounded by bytes.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX = "repo_id string, path string, mode string, stage int, tag string, on_disk boolean, error string"
FILES = "repo_id string, path string, mode string, stage int, tracked boolean, content binary, error string"
COMMITS = "repo_id string, author string, committer string, error string"
IDENTITIES = "repo_id string, author string, committer string, error string"
BASES = "repo_id string, oid string, ref string, valid boolean, error string"
REPOS = "repo_id string, head string, dirty boolean, origin string, error string"
CHANGES = "repo_id string, scope string, kind string, path string, old_path string, on_disk boolean, error string"
OBJECTS = "repo_id string, oid string, type string, size long, content binary, error string"
INVENTORY = "repo_id string, oid string, type string, size long, error string"
BLOBS = "oid string, content binary, error string"
VERSIONS = "repo_id string, path string, kind string, base_mode string, index_mode string, disk_mode string, before binary, after binary, error string"

#: A batch ends with so many rows, or once its contents have so many bytes.
BATCH_ROWS, BATCH_BYTES = 256, 8_000_000
LINK, SUBMODULE = "120000", "160000"
UNREADABLE, UNKNOWN_MODE, UNKNOWN_BASE = "FileUnreadable", "UnknownMode", "UnknownBase"
#: Files whose versions are compared by default: workflows of a repository, none in folders below.
WORKFLOWS = r"^\.github/workflows/[^/]+\.ya?ml\Z"


class NotARepository(ValueError):
    """The path is no folder of a Git repository."""


def _git(repo: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, "-c", "i18n.logOutputEncoding=UTF-8", *args], input=given, capture_output=True, check=True).stdout


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "backslashreplace")


def _answer(repo: str, *args: str) -> str | None:
    """What git says, None where it refuses."""
    try:
        return _text(_git(repo, *args)).strip()
    except subprocess.CalledProcessError:
        return None


def _root(path: str) -> str:
    top = _answer(path, "rev-parse", "--show-toplevel") if os.path.isdir(path) else None
    if not top:
        raise NotARepository
    return os.fsdecode(_git(path, "rev-parse", "--show-toplevel").rstrip(b"\n"))


def _commit(repo: str, base: str) -> str:
    if base.startswith("-"):
        raise ValueError(UNKNOWN_BASE)
    return _text(_git(repo, "rev-parse", "--verify", "--end-of-options", base + "^{commit}")).strip()


def _range(repo: str, base: str | None, otherwise: str) -> str:
    return f"{_commit(repo, base)}..HEAD" if base else otherwise


def _entries(repo: str) -> Iterator[tuple[str, str, int, bytes]]:
    """(tag, mode, stage, path) of the index."""
    for entry in _git(repo, "ls-files", "-z", "-v", "--stage").split(b"\0"):
        if entry:
            facts, path = entry.split(b"\t", 1)
            tag, mode, _, stage = facts.split(b" ")
            yield _text(tag), _text(mode), int(stage), path


def _disk_path(repo: str, path: bytes) -> bytes:
    return os.path.join(os.fsencode(repo), path)


def _index(repo: str) -> Iterator[tuple]:
    for tag, mode, stage, path in _entries(repo):
        yield _text(path), mode, stage, tag, os.path.exists(_disk_path(repo, path)), None


def _files(repo: str, part: int, parts: int) -> Iterator[tuple]:
    gone = set(_git(repo, "ls-files", "-z", "--deleted").split(b"\0"))
    listed = [(mode, stage, True, path) for tag, mode, stage, path in _entries(repo) if mode not in (LINK, SUBMODULE) and not (tag.upper() == "S" and not os.path.exists(_disk_path(repo, path)))]
    listed += [("100644", 0, False, path) for path in _git(repo, "ls-files", "-z", "--others", "--exclude-standard").split(b"\0") if path]
    for mode, stage, tracked, path in listed[part::parts]:
        name, full = _text(path), _disk_path(repo, path)
        if not mode.startswith("100"):
            yield name, mode, stage, tracked, None, UNKNOWN_MODE
        elif path not in gone:
            try:
                if not os.path.isfile(full):
                    raise OSError
                with open(full, "rb") as f:
                    yield name, mode, stage, tracked, f.read(), None
            except OSError:
                yield name, mode, stage, tracked, None, UNREADABLE


def _commits(repo: str, revisions: str) -> Iterator[tuple]:
    for line in sorted(set(_git(repo, "log", "--format=%an <%ae>%x00%cn <%ce>", revisions).splitlines())):
        yield (*map(_text, line.split(b"\0", 1)), None)


def _facts(repo: str) -> Iterator[tuple]:
    origin = _answer(repo, "remote", "get-url", "origin") or None
    yield _text(_git(repo, "rev-parse", "HEAD")).strip(), bool(_git(repo, "status", "--porcelain").strip()), origin, None


def _identities(repo: str) -> Iterator[tuple]:
    yield _answer(repo, "var", "GIT_AUTHOR_IDENT"), _answer(repo, "var", "GIT_COMMITTER_IDENT"), None


def _base(repo: str, name: str) -> Iterator[tuple]:
    oid = None if name.startswith("-") else _answer(repo, "rev-parse", "--verify", name + "^{commit}")
    ref = oid and _answer(repo, "rev-parse", "--symbolic-full-name", name)
    remote = bool(ref) and ref.startswith("refs/remotes/origin/")
    yield oid, ref or None, remote and _answer(repo, "merge-base", "--is-ancestor", oid, "HEAD") is not None, None


def _contents(repo: str, wanted: Iterable[tuple[bytes, int | None]]) -> Iterator[bytes]:
    """Contents of blobs in order, by one stream; every header, size and end is verified."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as stream:
        for oid, size in wanted:  # one at a time, so neither pipe fills
            stream.stdin.write(oid + b"\n")
            stream.stdin.flush()
            head = stream.stdout.readline().split()
            if len(head) != 3 or head[:2] != [oid, b"blob"] or (size is not None and int(head[2]) != size):
                raise ValueError("unexpected object")
            content = stream.stdout.read(int(head[2]) + 1)
            if len(content) != int(head[2]) + 1 or content[-1:] != b"\n":
                raise ValueError("unexpected object")
            yield content[:-1]
        stream.stdin.close()


def _inventory(repo: str, revisions: str) -> Iterator[tuple]:
    oids = list(dict.fromkeys(_git(repo, "rev-list", "--objects", "--no-object-names", revisions).split()))
    for line in _git(repo, "cat-file", "--batch-check", given=b"\n".join(oids)).splitlines():
        oid, kind, size = line.split(b" ")
        yield _text(oid), _text(kind), int(size), None


def _objects(repo: str, revisions: str, max_bytes: int) -> Iterator[tuple]:
    wanted = [(oid.encode(), size) for oid, kind, size, _ in _inventory(repo, revisions) if kind == "blob" and size <= max_bytes]
    for (oid, size), content in zip(wanted, _contents(repo, wanted), strict=True):
        yield _text(oid), "blob", size, content, None


def _changes(repo: str, base: str | None) -> Iterator[tuple]:
    there = lambda path: os.path.exists(_disk_path(repo, path))
    if base is not None:
        commit = _commit(repo, base)
        yield "base", None, commit, None, None, None
        for scope, args in (("committed", [f"{commit}...HEAD"]), ("worktree", [commit])):
            fields = iter([x for x in _git(repo, "diff", "--name-status", "-z", *args, "--").split(b"\0") if x])
            for kind in fields:
                paths = [next(fields)] + ([next(fields)] if kind[:1] in (b"R", b"C") else [])
                old = _text(paths[0]) if len(paths) > 1 else None
                yield scope, _text(kind[:1]), _text(paths[-1]), old, there(paths[-1]), None
    for path in _git(repo, "ls-files", "-z", "--deleted").split(b"\0"):
        if path:
            yield "deleted", "D", _text(path), None, False, None


def _versions(repo: str, base: str, matching: str) -> Iterator[tuple]:
    commit = _commit(repo, base)
    index: dict[bytes, str] = {}
    for _, mode, _, path in _entries(repo):
        index.setdefault(path, mode)
    fields = iter([x for x in _git(repo, "diff", "--raw", "-z", "--no-abbrev", "--no-renames", commit, "--").split(b"\0") if x])
    rows = []
    for facts in fields:
        old_mode, disk_mode, oid, _, kind = facts.lstrip(b":").split()
        path = next(fields)
        if re.search(matching, _text(path)):
            rows.append((path, _text(kind[:1]), _text(old_mode), _text(disk_mode), oid))
    readable = lambda mode: mode.startswith("100")
    before = _contents(repo, [(oid, None) for _, _, old_mode, _, oid in rows if readable(old_mode)])
    for path, kind, old_mode, disk_mode, _ in rows:
        old = next(before) if readable(old_mode) else None
        now, error, full = None, None, _disk_path(repo, path)
        if readable(disk_mode) and not os.path.islink(full):
            try:
                with open(full, "rb") as f:
                    now = f.read()
            except OSError:
                error = UNREADABLE
        yield _text(path), kind, old_mode, index.get(path), disk_mode, old, now, error


def _read(repos: DataFrame, schema: str, rows_of: Callable[[str, str | None, int], Iterator[tuple]], parts: int = 1) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for repo_id, path, base, part in batch.itertuples(index=False):
                try:
                    for row in rows_of(_root(path), base, part):
                        rows.append((repo_id, *row))
                        size += sum(len(x) for x in row if isinstance(x, bytes))
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (OSError, ValueError, subprocess.CalledProcessError, TypeError) as e:
                    rows.append((repo_id, *[None] * (len(names) - 2), type(e).__name__))  # its kind only: messages may hold paths
        if rows:
            yield batch_of(rows)

    base = F.col("base").cast("string") if "base" in repos.columns else F.lit(None).cast("string")
    asked = repos.select(F.col("repo_id").cast("string"), F.col("path").cast("string"), base.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return asked.repartition("repo_id", "part").mapInPandas(run, schema)


def read_index(repos: DataFrame) -> DataFrame:
    """Every entry of the index, links, submodules and all stages of a conflict included, with git's tag and whether its path exists on disk."""
    return _read(repos, INDEX, lambda repo, _, __: _index(repo))


def read_files(repos: DataFrame, parts: int = 1) -> DataFrame:
    """Files of the index and untracked ones, with what is on disk under their paths; ``parts`` tasks share a repository's files.

    Links and submodules (by the index) and files deleted on disk are left out, as are those a sparse checkout left away. An entry of an unknown mode, and
    one that is no readable file, is an error row of its path.
    """
    return _read(repos, FILES, lambda repo, _, part: _files(repo, part, parts), parts)


def read_commits(repos: DataFrame, revisions: str = "--all") -> DataFrame:
    return _read(repos, COMMITS, lambda repo, base, _: _commits(repo, _range(repo, base, revisions)))


def read_identities(repos: DataFrame) -> DataFrame:
    """The author and committer of a commit made now, each with time and zone; null where git knows none."""
    return _read(repos, IDENTITIES, lambda repo, _, __: _identities(repo))


def read_bases(repos: DataFrame, name: str | None = None) -> DataFrame:
    """The commit and full name of a base (``name``, or each repository's own); valid if it is a branch of origin and an ancestor of HEAD."""
    return _read(repos, BASES, lambda repo, base, _: _base(repo, name or base or ""))


def read_repositories(repos: DataFrame) -> DataFrame:
    return _read(repos, REPOS, lambda repo, _, __: _facts(repo))


def read_objects(repos: DataFrame, revisions: str = "--all", max_bytes: int = 2_000_000) -> DataFrame:
    return _read(repos, OBJECTS, lambda repo, base, _: _objects(repo, _range(repo, base, revisions), max_bytes))


def read_inventory(repos: DataFrame, revisions: str = "--all") -> DataFrame:
    """What ``read_objects`` would read, of any type and size, without contents."""
    return _read(repos, INVENTORY, lambda repo, base, _: _inventory(repo, _range(repo, base, revisions)))


def read_shared_blobs(repos: DataFrame, inventory: DataFrame, max_bytes: int = 2_000_000, parts: int = 1) -> DataFrame:
    """``oid, content, error`` of the distinct blobs of all repositories together: what forks share is read from one of them, once.

    ``parts`` tasks share a repository's objects. An object that can't be read is an error row of its own.
    """
    holders = inventory.where((F.col("type") == "blob") & (F.col("size") <= max_bytes)).groupBy("oid").agg(F.min("repo_id").alias("repo_id"))
    wanted = holders.join(repos.select(F.col("repo_id").cast("string").alias("repo_id"), F.col("path").cast("string").alias("path")), "repo_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for path, own in groupby(((path, oid) for batch in batches for path, oid in batch[["path", "oid"]].itertuples(index=False)), key=lambda x: x[0]):
            oids = [oid for _, oid in own]
            done = 0
            try:
                for content in _contents(_root(path), ((oid.encode(), None) for oid in oids)):
                    rows.append((oids[done], content, None))
                    done, size = done + 1, size + len(content)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["oid", "content", "error"], dtype=object)
                        rows, size = [], 0
            except (OSError, ValueError, subprocess.CalledProcessError) as e:
                rows += [(oid, None, type(e).__name__) for oid in oids[done:]]
        if rows:
            yield pd.DataFrame(rows, columns=["oid", "content", "error"], dtype=object)

    part = F.pmod(F.xxhash64("oid"), F.lit(parts))
    return wanted.repartition("repo_id", part).sortWithinPartitions("path", "oid").select("path", "oid").mapInPandas(run, BLOBS)


def read_changes(repos: DataFrame, base: str | None = None) -> DataFrame:
    """Changed paths by scope, each with git's letter, the path before a rename or copy, and whether the path is on disk.

    Scope 'committed' is since the two lines parted, 'worktree' what differs on disk now, 'deleted' what is gone from disk. A base that was read has a row of scope
    'base' (its path is the commit), so no change and no answer are told apart; a base that names no commit is an error row.
    """
    return _read(repos, CHANGES, lambda repo, own, _: _changes(repo, base or own))


def read_versions(repos: DataFrame, base: str | None = None, matching: str = WORKFLOWS) -> DataFrame:
    """Files that differ from a base on disk and whose path has ``matching``: their modes at the base, in the index and on disk, and contents before and now.

    A content is null where there is none or where it is a link's; one that can't be read is an error row of its path.
    """
    return _read(repos, VERSIONS, lambda repo, own, _: _versions(repo, base or own or "", matching))


def changed_paths(changes: DataFrame, scope: str = "worktree") -> DataFrame:
    """``repo_id, path``, each once: of a rename both paths changed. Error rows are none; ``broken`` has them."""
    rows = changes.where(F.col("error").isNull() & (F.col("scope") == scope))
    return rows.select("repo_id", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()


def broken(table: DataFrame) -> DataFrame:
    """``repo_id``, each once, of which something could not be read."""
    return table.where("error is not null").select("repo_id").distinct()


def files_since(files: DataFrame, index: DataFrame, changes: DataFrame) -> DataFrame:
    """``files`` narrowed to what was committed since the base, for a scan that leaves older findings out.

    A changed path that is on disk must have one entry in the index: with none or several it is an error row, with an unknown mode too; links and
    submodules are left out, and paths no longer on disk. A repository's own error rows stay, those of its changes and its index come along.
    """
    committed = changes.where("error is null and scope = 'committed' and on_disk").select("repo_id", "path").distinct()
    entries = index.where("error is null").groupBy("repo_id", "path").agg(F.count("*").alias("n"), F.min("mode").alias("mode"))
    found = committed.join(entries, ["repo_id", "path"], "left").withColumn("one", F.coalesce(F.col("n") == 1, F.lit(False)))
    regular = found.where(F.col("one") & F.startswith("mode", F.lit("100")))
    kept = files.where("path is not null").join(regular.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    odd = found.where(~F.col("one") | ~(F.startswith("mode", F.lit("100")) | F.col("mode").isin(LINK, SUBMODULE)))
    as_error = lambda rows, path, error: rows.select("repo_id", path.alias("path"), *[F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns if c not in ("repo_id", "path", "error")], error.alias("error"))
    whole = files.where("path is null and error is not null")
    none = F.lit(None).cast("string")
    # without a path: what git could not tell is the repository's error, not a file's
    more = [as_error(odd, none, F.lit(UNKNOWN_MODE))] + [as_error(t.where("error is not null and path is null"), none, F.col("error")) for t in (changes, index)]
    out = kept.unionByName(whole)
    for rows in more:
        out = out.unionByName(rows)
    return out
