"""Names, paths, URLs, stamps and digests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: U+001F, which joins the cells of a fingerprinted row.
UNIT = "\x1f"
# Names of image files that may be served.
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9_. -]*\.(?i:jpe?g)$"
# Fixed value: aliases of people.
ALIAS = r"^s[0-9]{3}$"


def folded(c: Column) -> Column:
    return F.lower(F.trim(c))


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a name that only starts with a dot keeps it."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1)


def tile_parent(path: Column) -> Column:
    """The stem before _digits; null where there is none."""
    return F.nullif(F.regexp_extract(stem(path), r"^(.+)_\d+$", 1), F.lit(""))


def parent_group(path: Column) -> Column:
    """The folded stem less _digits; always a value."""
    return F.lower(F.regexp_replace(stem(path), r"_\d+$", ""))


def short_id(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def reasons(*conditions: tuple[Column, str]) -> Column:
    """'; '-joined sorted distinct reasons whose condition holds; empty if none does."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in conditions)))
    return F.array_join(F.array_sort(F.array_distinct(found)), "; ")


def stamp(*candidates: Column) -> Column:
    """The first of the stamps given, read as ISO 8601 with or without Z; epoch zero if none is, null if it is bad."""
    first = F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))
    return F.when(first.isNull(), F.timestamp_seconds(F.lit(0))).otherwise(F.try_to_timestamp(first))


def safe_name(c: Column) -> Column:
    return c.rlike(SAFE_NAME) & ~c.contains("..")


def task_path(url: Column) -> Column:
    """The image path that a task's URL names: its only ``d`` parameter, else its path; decoded."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    asked = F.filter(F.split(query, "&"), lambda kv: kv.startswith("d="))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    one = F.when(F.size(asked) == 1, F.substring(F.get(asked, F.lit(0)), 3, 1 << 20))
    return F.url_decode(F.coalesce(F.nullif(one, F.lit("")), path))


def task_filename(url: Column) -> Column:
    """The file that a task's URL names; null where the path climbs or holds a NUL."""
    path = posix(task_path(url))
    parts = F.split(path, "/")
    bad = F.array_contains(parts, "..") | path.contains("\0")
    return F.when(~bad, F.element_at(parts, -1))


def mentions(c: Column, wanted: str) -> Column:
    """Whether the text has the wanted one, whatever its case and accents."""
    return F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(wanted), "UNICODE_CI_AI"))


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def http_base(url: Column) -> Column:
    """The address without slashes at its end, if it's http or https, has a host, and no name, password, query or fragment; else null."""
    rest = F.regexp_extract(url, r"^(?i:https?)://(.*)$", 1)
    authority, tail = F.regexp_extract(rest, r"^([^/?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1)
    who = F.regexp_extract(authority, r"^(.*)@", 1)
    return F.when((authority != "") & who.isin("", ":") & tail.isin("", "?", "#", "?#"), F.regexp_replace(F.regexp_replace(url, r"[?#]+$", ""), "/+$", ""))


def project_link(base: Column, project: Column) -> Column:
    """The address of a project's data below a base that may be linked; null for others."""
    return F.concat(http_base(base), F.lit("/projects/"), project.cast("string"), F.lit("/data"))


def path_parts(path: Column) -> Column:
    """The names of a path, with . and .. followed by their names alone: links can't be seen here. Those above the root stay there."""
    step = lambda done, name: F.when(name.isin("", "."), done).when(name == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(name)))
    return F.aggregate(F.split(posix(path), "/"), F.array().cast("array<string>"), step)


def inside(path: Column, folder: Column) -> Column:
    """Whether a path lies in a folder or is it, once both are followed."""
    there = path_parts(folder)
    return F.slice(path_parts(path), 1, F.size(there)).eqNullSafe(there)
