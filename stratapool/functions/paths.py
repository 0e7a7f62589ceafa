"""Path expressions. All take and return Columns of absolute, slash-separated paths."""

from __future__ import annotations

import posixpath
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(path: Column | str) -> Column:
    """A-Z in lower case, everything else as it is: how prefixes are compared."""
    return F.translate(_col(path), UPPER, LOWER)


def fold_text(path: str) -> str:
    return path.translate(str.maketrans(UPPER, LOWER))


def norm_dir(path: str) -> str:
    """A directory with one slash at its end; the root is one slash."""
    return "/" if path in ("", "/") else path.rstrip("/") + "/"


def under(path: Column | str, root: str, case_sensitive: bool = False) -> Column:
    """If the path lies below root, by prefix."""
    root = norm_dir(root)
    return _col(path).startswith(root) if case_sensitive else fold(path).startswith(fold_text(root))


def rest(path: Column | str, root: str) -> Column:
    """What follows root's prefix."""
    return F.substring(_col(path), len(norm_dir(root)) + 1, 1 << 30)


def base(path: Column | str) -> Column:
    p = _col(path)
    return F.when(p == "/", p).otherwise(F.substring_index(p, "/", -1))


def parent(path: Column | str) -> Column:
    p = F.regexp_replace(_col(path), "/[^/]*$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def parts(path: Column | str) -> Column:
    return F.filter(F.split(_col(path), "/"), lambda x: x != "")


def ancestors(path: Column | str) -> Column:
    """'/a/b/c' -> ['/a', '/a/b', '/a/b/c']; of the root: none."""
    p = parts(path)
    return F.transform(p, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), i + 1), "/")))


def clean(raw: str) -> str:
    """A request's path, rooted first and then cleaned."""
    out = posixpath.normpath("/" + raw)
    return "/" + out.lstrip("/")


def clean_mount(raw: str) -> str:
    """A mount's path, cleaned first and then rooted."""
    out = posixpath.normpath(raw) if raw else "."
    return out if out.startswith("/") else "/" + out


def _cleaned(path: Column, rooted: bool) -> Column:
    """The names of a path without '.' and with '..' resolved; those that lead above the start stay if it isn't rooted."""
    up = F.array(F.lit(".."))
    names = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    top = lambda a: F.coalesce(F.element_at(F.concat(up, a), -1), F.lit(".."))
    return F.aggregate(
        names,
        F.array().cast("array<string>"),
        lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(top(a) != "..", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a if rooted else F.concat(a, up)),
    )


def clean_path(raw: Column | str) -> Column:
    """clean() of a column."""
    return F.concat(F.lit("/"), F.array_join(_cleaned(_col(raw), True), "/"))


def clean_mount_path(raw: Column | str) -> Column:
    """clean_mount() of a column."""
    p = _col(raw)
    bare = F.array_join(_cleaned(p, False), "/")
    rooted = p.startswith("/")
    return F.when(rooted, clean_path(p)).otherwise(F.concat(F.lit("/"), F.when(bare == "", F.lit(".")).otherwise(bare)))


def join_paths(*names: Column | str) -> Column:
    """join() of columns."""
    out = F.regexp_replace(F.concat_ws("/", *[_col(n) for n in names]), "/+", "/")
    out = F.when(F.length(out) > 1, F.regexp_replace(out, "/$", "")).otherwise(out)
    return F.when(out == "", F.lit("/")).otherwise(out)


def virtual_path(local: Column | str, root: str) -> Column:
    """A local path below root as a rooted path of the catalog, with slashes; of root itself: '/.'."""
    p = F.replace(_col(local), F.lit("\\"), F.lit("/"))
    own = root.replace("\\", "/").rstrip("/") + "/"
    return F.concat(F.lit("/"), F.when(F.concat(p, F.lit("/")) == own, F.lit(".")).otherwise(F.substring(p, len(own) + 1, 1 << 30)))


def join(*names: str) -> str:
    out = "/".join(names)
    while "//" in out:
        out = out.replace("//", "/")
    return out.rstrip("/") or "/"


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a glob on a base name; None if the glob is malformed."""
    out, i, n = [], 0, len(pattern)
    literal = lambda c: "\\" + c if c in r"\.^$|?*+()[]{}-&~#" else c
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == n:
                return None
            out.append(literal(pattern[i]))
            i += 1
        elif c == "[":
            no = i < n and pattern[i] == "^"
            i += no
            members = []
            while True:
                if i >= n:
                    return None
                if pattern[i] == "]" and members:
                    i += 1
                    break
                bounds = []
                for k in range(2):
                    if i >= n or pattern[i] in "]-":
                        return None
                    i += pattern[i] == "\\"
                    if i >= n:
                        return None
                    bounds.append(pattern[i])
                    i += 1
                    if k or i >= n or pattern[i] != "-":
                        break
                    i += 1
                members.append("-".join(map(literal, bounds)))
            out.append(f"[{'^' if no else ''}{''.join(members)}]")
        else:
            out.append(literal(c))
    return f"^{''.join(out)}$"


def glob_matches(name: Column | str, pattern: str) -> Column:
    """An empty glob matches all, a malformed one what contains it."""
    if not pattern:
        return F.lit(True)
    regex = glob_regex(pattern)
    return F.contains(_col(name), F.lit(pattern)) if regex is None else F.rlike(_col(name), F.lit(regex))
