"""Column helpers: rates, intervals, names and paths. All are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def rate(part: Column, whole: Column) -> Column:
    """part / whole; an empty denominator is "not measured", so NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(part: Column, whole: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval, clamped to 0..1; NULL for an empty denominator."""
    n = F.when(whole > 0, whole.cast("double"))
    p = part.cast("double") / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def exact_paired_p(a_only: Column, b_only: Column) -> Column:
    """Two-sided exact binomial p for discordant pairs, its terms summed from logarithms; 1.0 without any."""
    n, low = (a_only + b_only).cast("double"), F.least(a_only, b_only)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((n - k + 1) / k)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.filter(F.sequence(F.lit(0).cast("bigint"), low), lambda k: k > 0)
    return F.when(a_only + b_only == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add, lambda acc: acc["total"])))


#: Container types whose element type is what a field refers to.
CONTAINERS = ("List", "list", "Optional", "Set", "set", "Iterable", "Sequence", "Array", "Collection", "ArrayList", "Mapping")
#: Language of a file extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cs": "csharp", "php": "php"}
#: Extensions an import string may carry, in the order they are taken off.
IMPORTED = ("js", "jsx", "ts", "tsx", "py", "java", "mjs")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def type_head(text: Column) -> Column:
    """The type a declaration refers to: what stands before the first bracket, or, in a list-like container, the last type inside it.

    Of the brackets [, < and ( the first kind that occurs counts. Alternatives after | are left out, then quotes; NULL if nothing is left.
    """
    bare = _stripped(F.regexp_replace(_stripped(text), "^:+", ""))
    found = bare
    for opener in ("(", "<", "["):
        head = _stripped(F.substring_index(bare, opener, 1))
        inner = F.regexp_replace(F.substr(bare, F.locate(opener, bare) + F.lit(1)), r"[\]>)]+$", "")
        inside = F.when(head.isin(*CONTAINERS), _stripped(F.element_at(F.split(inner, ","), -1))).otherwise(head)
        found = F.when(F.contains(bare, F.lit(opener)), inside).otherwise(found)
    first = _stripped(F.substring_index(found, "|", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(first, '^"+|"+$', ""), "^'+|'+$", ""), F.lit(""))


def callee(text: Column) -> Column:
    """[receiver, name] of a call expression; the receiver is NULL where there is none. NULL if the part before the arguments is over
    200 characters or ends in no identifier."""
    joined = F.regexp_replace(F.regexp_replace(_stripped(F.regexp_replace(text, r"\s+", " ")), r"->|::", "."), r"^\$+", "")
    plain = _stripped(F.substring_index(joined, "(", 1))
    parts = F.filter(F.split(plain, r"\."), lambda x: x != "")
    name = _stripped(F.try_element_at(parts, F.lit(-1)))
    receiver = F.nullif(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "."), F.lit(""))
    good = (F.length(plain) <= 200) & name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")
    return F.when(good, F.struct(receiver.alias("receiver"), name.alias("name")))


def module_name(text: Column) -> Column:
    """An import string without quotes around it, leading dots and slashes, and known extensions."""
    bare = F.regexp_replace(F.regexp_replace(_stripped(text), "^['\"]+|['\"]+$", ""), r"\\", "/")
    bare = F.regexp_replace(bare, r"^[./]+", "")
    for extension in IMPORTED:
        bare = F.regexp_replace(bare, rf"\.{extension}$", "")
    return bare


def module_keys(path: Column) -> Column:
    """All names a file may be imported by: its path, and every suffix of it with slashes and with dots; a package by its folder too."""
    stem = F.regexp_replace(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""), r"\\", "/")
    parts = F.split(stem, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, i, F.size(parts)))
    spelled = F.flatten(F.transform(tails, lambda t: F.array(F.array_join(t, "/"), F.array_join(t, "."))))
    folder = F.regexp_extract(stem, r"^(.+)/__init__$", 1)
    package = F.array(folder, F.replace(folder, F.lit("/"), F.lit(".")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(path), spelled, package), lambda k: k != "")))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws("::", F.lit(kind), *parts)


def tokens(length: Column) -> Column:
    """Estimated tokens of a payload of that many characters: a quarter, at least one."""
    return F.greatest(F.lit(1), F.floor(length / 4)).cast("bigint")


def round2(x: Column) -> Column:
    """x to two places as its binary value rounds, ties to even: 2.675, a little less than that in binary, gives 2.67.

    100 x is worked out without error as a rounded product and what it lacks; that decides where the product alone lies on a half.
    """
    x = x.cast("double")
    whole = 100 * x
    c = F.lit(134217729.0) * x  # splits x into two parts of at most 26 bits
    high = c - (c - x)
    lacks = (x - high) * 100 - (whole - high * 100)
    near = F.rint(whole)
    half = F.abs(whole - near) == 0.5
    up, down = F.ceil(whole).cast("double"), F.floor(whole).cast("double")
    exact = F.when(half & (lacks > 0), up).when(half & (lacks < 0), down).otherwise(near) / 100
    return F.when(F.abs(whole) < 2.0**52, exact).otherwise(x)
