"""Names and keys of types and methods as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = {"%": "%25", "-": "%2D", "=": "%3D", ":": "%3A", "<": "%3C", ">": "%3E", ",": "%2C"}


def _quoted(x: str) -> str:
    return "".join(_MARKS.get(c, c) for c in x)


def _plain(x: str) -> str:
    for c, q in reversed(_MARKS.items()):
        x = x.replace(q, c)
    return x


def type_key(assembly: str, namespace: str, name: str, args: list | None = None) -> str:
    """A type's key; args are keys of its type arguments, to any depth.  Separators within names are quoted, so that keys can be read back."""
    return ":".join(map(_quoted, (assembly, namespace, name))) + (f"<{','.join(args)}>" if args else "")


def parse_type_key(key: str) -> tuple[str, str, str, list]:
    """(assembly, namespace, name, arguments) with the arguments read in the same way."""
    head, _, rest = key.partition("<")
    args, depth, start = [], 0, 0
    inner = rest[:-1] if rest else ""
    for k, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            args.append(inner[start:k])
            start = k + 1
    if inner:
        args.append(inner[start:])
    assembly, namespace, name = map(_plain, head.split(":"))
    return assembly, namespace, name, list(map(parse_type_key, args))


def metadata_name(name: Column, arity: Column) -> Column:
    """C`2 for a generic class of two parameters."""
    return F.when(arity > 0, F.concat_ws("`", name, arity.cast("string"))).otherwise(name)


def display_name(name: Column, args: Column) -> Column:
    """C<A, B>."""
    return F.when(F.size(args) > 0, F.concat(name, F.lit("<"), F.array_join(args, ", "), F.lit(">"))).otherwise(name)


def full_name(assembly: Column, namespace: Column, name: Column) -> Column:
    return F.concat(assembly, F.lit(": "), F.concat_ws(".", F.when(namespace != "", namespace), name))


def own_file(path: Column) -> Column:
    """Whether a file is the program's own: those that a compiler writes begin with .NETFramework,."""
    return ~F.element_at(F.split(path, r"[\\/]"), -1).startswith(".NETFramework,")


def relative_path(path: Column, root: str) -> Column:
    """The path below root, with forward slashes."""
    plain = F.translate(path, "\\", "/")
    return F.regexp_replace(plain, "^" + re.escape(root.replace("\\", "/").rstrip("/")) + "/", "")
