"""Detectors' patterns, with white space written out so that Java's expressions match what Unicode-aware ones do."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class: Unicode white space (fixed values).
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Secret-shaped strings (fixed values).
SECRETS = (
    r"sk-[A-Za-z0-9_-]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY",
)
#: Home folders of three systems (fixed values).
HOME_PATHS = (rf"[A-Za-z]:[/\\]Users[/\\][^/\\{SPACE}]+", rf"/Users/[^/{SPACE}]+", rf"/home/[^/{SPACE}]+")
JAPANESE = "[ぁ-んァ-ヶ一-龠]"
#: Markdown: an opening fence and its info string, code spans, links and their destinations (fixed values).
FENCE = rf"^[{SPACE}]*(`{{3,}}|~{{3,}})([^`]*)$"
CODE_SPAN = "`[^`]+`"
TABLE_DIVIDER = r"^:?-{3,}:?\z"
LINK = r"(?<!!)\[[^\]]*\]\(([^)]+)\)"
LINK_DESTINATION = r"(?<=\])\([^)]*\)"
#: Mermaid: labels of nodes, asymmetric nodes, edges and messages, and beginnings of lines that have none (fixed values).
NODE_LABEL = r"[\[(\"{]([^\[\]()\"{}]{2,}?)[\])\"}]"
ASYMMETRIC_LABEL = r"[\p{L}\p{N}_]>([^\]\n]{2,})\]"
PIPE_EDGE_LABEL = rf"(?:-->|---|-\.->|==>)[{SPACE}]*\|([^|]{{2,}})\|"
TEXT_EDGE_LABEL = rf"--[{SPACE}]+(.+?)[{SPACE}]+-->"
MESSAGE_LABEL = rf"(?:-{{1,2}}>>?|--?[x)])[^:]*:[{SPACE}]*(.+)$"
DIRECTIVES = ("style ", "classDef ", "class ", "linkStyle ", "click ", "subgraph", "end", "direction ", "%%")


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def percent_decoded(text: Column) -> Column:
    """Well-formed ``%XX`` of printable ASCII decoded; everything else as it is."""
    parts = F.regexp_extract_all(text, F.lit("%[2-7][0-9A-Fa-f]"), F.lit(0))
    gaps = F.split(text, "%[2-7][0-9A-Fa-f]", -1)
    chars = F.concat(F.transform(parts, lambda p: F.chr(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, chars, lambda gap, char: F.concat(gap, char)), "")


def has_any(text: Column, patterns: Sequence[str]) -> Column:
    """A match in the text or in its percent-decoded form; false for null."""
    rx = any_of(patterns)
    return F.coalesce(text.rlike(rx) | (F.contains(text, F.lit("%")) & percent_decoded(text).rlike(rx)), F.lit(False))


def utf16_text(data: bytes | None) -> str | None:
    """Bytes as UTF-16, little-endian without a byte order mark; None if they aren't."""
    try:
        return None if data is None else bytes(data).decode("utf-16")
    except UnicodeDecodeError:
        return None


def content_has_any(content: Column, patterns: Sequence[str]) -> Column:
    """A match in a file's bytes read as UTF-8 or as UTF-16, each also percent-decoded; a reading that fails is left out. False for null.

    Texts are taken by their UTF-8 bytes. Every pattern needs an ASCII character, so in UTF-16 a zero byte: only bytes with one go to Python.
    """
    data, text = content.cast("binary"), content.cast("string")
    wide = F.pandas_udf(lambda s: pd.Series([utf16_text(x) for x in s], index=s.index, dtype=object), "string")
    return has_any(F.when(F.is_valid_utf8(text), text), patterns) | has_any(wide(F.when(F.contains(data, F.lit(b"\0")), data)), patterns)


def evidence_label(label: Column) -> Column:
    """A label that can be shown: withheld whole if it looks like a secret or a home folder."""
    return F.when(has_any(label, SECRETS + HOME_PATHS), F.lit("<redacted-path>")).otherwise(label)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def redacted_remote(url: Column) -> Column:
    """A remote's scheme, host (both in lower case), port and path only; null if nothing is left."""
    bare = F.regexp_replace(url, "(?s)[?#].*$", "")
    host = F.regexp_extract(bare, r"(?s)^[^:]*://(?:[^/]*@)?([^/]*)", 1)
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), r":0*\z", ""), r":0+(?=[1-9][0-9]*\z)", ":"), r"^\[([^\]]*)\]", "$1")
    with_scheme = F.concat(F.lower(F.regexp_extract(bare, "(?s)^[^:]*://", 0)), named, F.regexp_replace(bare, r"(?s)^[^:]*://[^/]*", ""))
    # user@host:path; what stands before the first @ is the user's, whatever follows
    scp = F.regexp_replace(bare, r"^[^@/:]+@(?=[^/:]+:[^\n]+\z)", "")
    return F.nullif(F.when(F.contains(url, F.lit("://")), with_scheme).otherwise(scp), F.lit(""))


def effective_identity(value: Column) -> Column:
    """An identity without its time and zone, and without white space around it."""
    return F.regexp_replace(F.regexp_replace(value, rf"[{SPACE}]+\p{{Nd}}+[{SPACE}]+[+-]\p{{Nd}}{{4}}(?=\n?\z)", ""), rf"^[{SPACE}]+|[{SPACE}]+\z", "")
