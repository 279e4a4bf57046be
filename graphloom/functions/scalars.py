"""Scalar functions as column expressions; integers stay integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b) -> Column:
    """Whole part of a quotient of longs."""
    return F.call_function("div", a.cast("bigint"), (b if isinstance(b, Column) else F.lit(b)).cast("bigint"))


def micro_ratio(n: Column, d: Column) -> Column:
    """A fraction in millionths, rounded down; 0 if there is nothing to divide by."""
    return F.when(d > 0, div(n * F.lit(1_000_000), F.when(d > 0, d).otherwise(1))).otherwise(F.lit(0).cast("bigint"))


def percent(covered: Column, total: Column) -> Column:
    """Whole percent, half up; 100 if the total is 0."""
    safe = F.when(total > 0, total).otherwise(1)
    return F.when(total > 0, div(covered * 100 + div(safe, 2), safe)).otherwise(F.lit(100).cast("bigint"))


def crap(complexity: Column, covered: Column, executable: Column) -> Column:
    """complexity² · (share not covered)³ + complexity, rounded up, in exact decimals."""
    wide = lambda x: x.cast("decimal(20,0)")
    missed, safe = executable - covered, F.when(executable > 0, executable).otherwise(1)
    num = (wide(complexity * complexity) * wide(missed * missed * missed)).cast("decimal(37,0)")
    den = wide(safe * safe * safe).cast("decimal(37,0)")
    part = F.call_function("div", num + den - 1, den)
    return F.when(executable > 0, part + complexity).otherwise(complexity * complexity + complexity).cast("bigint")


def allowed_increase(base: Column, basis_points: Column) -> Column:
    """Tolerance in basis points of a base count, rounded up."""
    return div(base * basis_points + 9999, 10000)


def argb_distance2(a: Column, b: Column) -> Column:
    """Squared distance of two packed colours over their four channels."""
    total = F.lit(0).cast("bigint")
    for shift in (24, 16, 8, 0):
        d = F.shiftright(a.cast("bigint"), shift).bitwiseAND(255) - F.shiftright(b.cast("bigint"), shift).bitwiseAND(255)
        total = total + d * d
    return total


def fnv32(text: Column) -> Column:
    """Low 32 bits of the 64-bit FNV-1a of the UTF-8 bytes, as 8 hex digits.

    Only the low halves of offset and prime matter to the low half of the
    product, so no product leaves 64 bits.
    """
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))
    octets = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(octets, F.lit(2216829733).cast("bigint"), lambda a, x: (a.bitwiseXOR(x) * F.lit(435)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def normalized_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` at the root of a relative path stays."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    # element_at of an empty array raises, so a guard stands before the parts and is dropped
    folded = F.aggregate(parts, F.array(F.lit("^")), lambda acc, s: F.when((s == "..") & ~F.element_at(acc, -1).isin("..", "^"), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))))
    body = F.array_join(F.slice(folded, F.lit(2), F.size(folded)), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.regexp_replace(body, r"^(\.\./)+|^\.\.$", ""))).otherwise(body)


def route_path(path: Column) -> Column:
    """Double slashes collapse in one pass, a trailing slash goes, a leading one is added."""
    once = F.rtrim(F.replace(path, F.lit("//"), F.lit("/")), F.lit("/"))
    return F.when(once.startswith("/"), once).otherwise(F.concat(F.lit("/"), once))


def route_key(path: Column) -> Column:
    """Route path with the names of its parameters left out."""
    return F.array_join(F.transform(F.split(route_path(path), "/"), lambda s: F.when(s.startswith(":"), F.lit(":")).otherwise(s)), "/")


def package_of(uri: Column) -> Column:
    """Package of a ``package:name/...`` uri, null if it is another kind."""
    name = F.regexp_extract(uri, r"^package:([^/]+)/", 1)
    return F.when(name != "", name)


def imports_private_src(uri: Column) -> Column:
    return uri.rlike(r"^package:[^/]+/src(/|$)")


def is_package_name(name: Column) -> Column:
    return name.rlike("^[a-z_][a-z0-9_]*$")


ZONES = ("core", "data", "domain", "presentation", "ui")


def zone(path: Column) -> Column:
    """First architectural zone among the folders of a path, null if none."""
    hits = F.filter(F.split(path, "/"), lambda s: s.isin(*ZONES))
    return F.when(F.size(hits) > 0, F.get(hits, F.lit(0)))


def line_and_column(text: Column, at: Column) -> tuple[Column, Column]:
    """1-based line and 0-based UTF-8 column of a character offset."""
    head = F.substring(text, F.lit(1), at.cast("int"))
    return (F.size(F.split(head, "\n"))).cast("bigint"), F.octet_length(F.element_at(F.split(head, "\n"), -1)).cast("bigint")


SECRET_SHAPES = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": r"(?i)bearer [A-Za-z0-9._-]{8,}",
    "forge-token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "signed-token": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "hex": r"[0-9a-fA-F]{32,}",
}


def secret_shape(value: Column) -> Column:
    """Name of the first secret shape that occurs, null if none does."""
    out = None
    for name, pattern in SECRET_SHAPES.items():
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out


def redact(line: Column) -> Column:
    """Quoted literals of a line become stars."""
    return F.regexp_replace(F.regexp_replace(line, r'"[^"]*"', '"***"'), r"'[^']*'", "'***'")


def glob_regex(pattern: str) -> str:
    """A glob as a whole-string regex; ``*`` crosses separators, as the matcher's defaults have it."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append("\\" + c if c in ".^$+{}()|[]\\" else c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob_match(value: Column, pattern: Column) -> Column:
    """Glob match of two columns, for tables of patterns: the regex is made in SQL."""
    escaped = F.regexp_replace(pattern, r"([.^$+{}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*+", ".*"), r"\?", "."), F.lit("$"))
    return (value == pattern) | F.regexp_like(value, regex)


def visible_last_show_wins(name: Column, combinators: Column) -> Column:
    """Export visibility: each show overwrites what was before, hide takes away."""
    return F.aggregate(combinators, F.lit(True), lambda seen, c: F.when(c["kind"] == "show", F.array_contains(c["names"], name)).otherwise(seen & ~F.array_contains(c["names"], name)))


def visible_all(name: Column, combinators: Column) -> Column:
    """Resolver visibility: every combinator must let the name through, so a later show revives nothing."""
    return F.aggregate(combinators, F.lit(True), lambda seen, c: seen & F.when(c["kind"] == "show", F.array_contains(c["names"], name)).otherwise(~F.array_contains(c["names"], name)))


def extension_visible(name: Column, combinators: Column, prefix: Column) -> Column:
    """Extensions: all combinators hold and the import has no prefix."""
    return prefix.isNull() & visible_all(name, combinators)
