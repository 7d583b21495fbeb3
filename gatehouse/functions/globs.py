"""Path patterns as regular expressions, built on the driver so that plans hold literals.

``*`` also crosses ``/``; a pattern without a leading part matches any tail of a path, part by part; and a
pattern matches too with its first ``**/`` left out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _piece(glob: str, star: str, one: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += star
        elif c == "?":
            out += one
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(glob: str) -> str:
    """Unanchored at no side: use with rlike."""
    forms = []
    for g in dict.fromkeys([glob, glob.replace("**/", "", 1)]):
        forms.append(f"^{_piece(g, '.*', '.')}$")
        parts = [x for x in g.split("/") if x]
        if parts:
            forms.append("(?:^|/)" + "/".join(_piece(x, "[^/]*", "[^/]") if x != "**" else "[^/]*" for x in parts) + "$")
    return "(?s)" + "|".join(f"(?:{f})" for f in forms)


def globs_regex(globs: Sequence[str]) -> str:
    return "|".join(f"(?:{glob_regex(g)})" for g in globs) or "(?!)"


def _literals(glob: str) -> list[list[str]]:
    """Runs of adjacent parts without wildcards."""
    runs: list[list[str]] = [[]]
    for part in glob.split("/"):
        if part and not re.search(r"[*?\[]", part):
            runs[-1].append(part)
        else:
            runs.append([])
    return [r for r in runs if r]


def glob_keys(glob: str) -> list[str]:
    """Keys of which every matching path has one: two adjacent parts, one part, an extension, or '*' where the glob tells nothing.

    A part without wildcards is a part of every path that matches, by either reading of a glob. The longest key tells most.
    """
    keys = []
    for g in dict.fromkeys([glob, glob.replace("**/", "", 1)]):
        pairs = [f"2:{a}/{b}" for run in _literals(g) for a, b in zip(run, run[1:], strict=False)]
        parts = [f"1:{a}" for run in _literals(g) for a in run]
        ending = re.search(r"[*?\]]([^*?\[\]/]*)\Z", g)
        extension = [f"e:{ending[1].rpartition('.')[2]}"] if ending and "." in ending[1] else []
        keys.append(max(pairs or parts or extension or ["*"], key=len))
    return list(dict.fromkeys(keys))


def path_keys(path: Column) -> Column:
    """A path's keys, as ``glob_keys`` gives them."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    ones = F.transform(parts, lambda p: F.concat(F.lit("1:"), p))
    twos = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.concat(F.lit("2:"), a, F.lit("/"), b))
    return F.array_distinct(F.concat(F.array(F.lit("*"), F.concat(F.lit("e:"), F.substring_index(path, ".", -1))), ones, twos))


def glob_matches(globs: DataFrame, paths: DataFrame) -> DataFrame:
    """``globs``' rows joined with the ``path`` of ``paths(repo_id, path)`` that they match, each pair once.

    ``globs`` has ``repo_id``, ``glob`` and columns of its own, none named path. Candidates meet by repository and key, so pairs grow with what may match, not with globs times
    paths, and a large repository is dealt out by key; the expression only verifies.
    """
    own = [c for c in globs.columns if c != "repo_id"]
    read = F.pandas_udf(lambda s: pd.DataFrame({"rx": [glob_regex(g) for g in s], "keys": [glob_keys(g) for g in s]}, index=s.index), "rx string, keys array<string>")
    wanted = globs.where("glob is not null").withColumn("read", read("glob")).select("repo_id", *own, F.col("read.rx").alias("rx"), F.explode("read.keys").alias("key"))
    keyed = paths.select("repo_id", F.col("path").alias("matched"), F.explode(path_keys(F.col("path"))).alias("key"))
    found = wanted.join(keyed, ["repo_id", "key"]).where(F.expr("matched rlike rx"))
    return found.select("repo_id", *own, F.col("matched").alias("path")).distinct()
