"""Column functions: paths, names, bands, identities and escapes.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "rs": "rust", "c": "c"} | dict.fromkeys("cc cpp cxx hh hpp hxx".split(), "cpp")
#: Review bands as (name, least score), ascending.
BANDS = (("low", 0), ("moderate", 6), ("high", 11), ("critical", 21))
RISK_RANK = {"low": 0, "moderate": 1, "high": 2, "critical": 3, "unknown": 4}
ACTION_RANK = {"none": 0, "human-review": 1, "block": 2}
IDENTIFIER = r"\A[\p{L}_][\p{L}\p{N}_]*\z"


def name_of(path: Column) -> Column:
    """Last component."""
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """Lower-cased extension of the file name; ``[none]`` without one, ``[non-utf8]`` if it holds an encoded byte.  A leading dot starts no extension."""
    found = F.lower(F.regexp_extract(name_of(path), r"\A.+\.([^.]+)\z", 1))
    return F.when(found == "", "[none]").when(found.rlike("%[89a-f][0-9a-f]"), "[non-utf8]").otherwise(found)


def language_of(path: Column) -> Column:
    """Language by extension, null if none is known."""
    ext = extension_of(path)
    out = F.when(ext == "py", "python")
    for k, v in list(LANGUAGES.items())[1:]:
        out = out.when(ext == k, v)
    return out


def is_test_path(path: Column) -> Column:
    """A component test or tests, or a name conftest.py, test_* or *_test.py."""
    parts, name = F.split(path, "/"), name_of(path)
    return F.exists(parts, lambda p: p.isin("test", "tests")) | (name == "conftest.py") | name.startswith("test_") | name.endswith("_test.py")


def forward(path: Column) -> Column:
    """A relative path with forward slashes."""
    return F.translate(path, "\\", "/")


def short_name(node: Column) -> Column:
    """What a reader calls a graph node: the last part of a module or symbol, without its path."""
    return F.element_at(F.split(F.split_part(node, F.lit("@"), F.lit(1)), "::|[.:]"), -1)


def subtitle(node: Column) -> Column:
    """The path of a local node, the kind of any other."""
    kind = F.split_part(node, F.lit(":"), F.lit(2))
    return F.when(F.contains(node, F.lit("@")), F.element_at(F.split(node, "@"), -1)).otherwise(kind)


def path_key(path: Column) -> Column:
    """Sort key of paths: component-wise, so that a/b.py precedes a.py."""
    return F.split(path, "/")


def full_match(subject: Column, pattern: str) -> Column:
    return subject.rlike(rf"\A(?:{pattern})\z")


def risk_band(score: Column, bands: tuple[tuple[str, int], ...] = BANDS) -> Column:
    """Name of the highest band whose least score is reached; null scores are unknown."""
    out = F.when(score.isNull(), "unknown")
    for name, least in reversed(bands[1:]):
        out = out.when(score >= least, name)
    return out.otherwise(bands[0][0])


def rank_of(name: Column, ranks: dict[str, int]) -> Column:
    """Position of a name in its declared order, for sorting."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), name)


def basis_points(documented: Column, measured: Column) -> Column:
    """floor(documented * 10000 / measured), null if nothing was measured."""
    return F.when(measured > 0, F.call_function("div", documented.cast("long") * 10000, measured.cast("long")))


def threshold_met(documented: Column, measured: Column, unavailable: Column, percent: int) -> Column:
    """Exact test of a percentage; null while it can't be decided."""
    return F.when((measured > 0) & (unavailable == 0), documented * 100 >= measured * percent)


def percent_text(points: Column) -> Column:
    """Basis points as d.dd%."""
    return F.concat(F.floor(points / 100).cast("string"), F.lit("."), F.lpad((points % 100).cast("string"), 2, "0"), F.lit("%"))


def module_name(path: Column, roots: tuple[str, ...] = ("src",)) -> Column:
    """Dotted module of a .py path under the first matching root; null if some part is no identifier."""
    bare = path
    for root in roots:
        bare = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 20)).otherwise(bare) if root else bare
    stem = F.regexp_replace(F.regexp_replace(bare, r"\.py\z", ""), r"(\A|/)__init__\z", "")
    parts = F.split(stem, "/")
    return F.when(path.endswith(".py") & (stem != "") & F.forall(parts, lambda p: p.rlike(IDENTIFIER)), F.array_join(parts, "."))


def requested_module(module: Column, is_package: Column, level: Column, name: Column) -> Column:
    """Absolute module that an import of relative ``level`` asks for; null beyond the root or without a package."""
    parts = F.split(module, "[.]")
    package = F.when(is_package, parts).otherwise(F.slice(parts, 1, F.size(parts) - 1))
    left = F.size(package) - level + 1
    base = F.when(left > 0, F.slice(package, 1, F.greatest(left, F.lit(0)))).when((left == 0) & (F.coalesce(name, F.lit("")) != "") & (level == 1), F.array().cast("array<string>"))
    joined = F.array_join(F.concat(base, F.when(F.coalesce(name, F.lit("")) != "", F.array(name)).otherwise(F.array().cast("array<string>"))), ".")
    return F.when(level == 0, name).otherwise(joined)


def reference_text(level: Column, name: Column, imported: Column) -> Column:
    """Spelling of an import: dots, module and ::name."""
    return F.concat(F.repeat(F.lit("."), level), F.coalesce(name, F.lit("")), F.when(imported.isNotNull(), F.concat(F.lit("::"), imported)).otherwise(""))


def distribution_name(name: Column) -> Column:
    """Normalised distribution name: lower case, runs of -, _ and . as one hyphen."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def identity(kind: Column, language: Column, *parts: Column) -> Column:
    """Key of a graph node: language:kind:parts, the kind left out for local nodes (language:name@path)."""
    rest = F.concat_ws(":", *parts)
    return F.when(kind == "local", F.concat(language, F.lit(":"), parts[0], F.lit("@"), parts[1] if len(parts) > 1 else F.lit(""))).otherwise(F.concat_ws(":", language, kind, rest))


def is_overload(decorator: Column) -> Column:
    return F.element_at(F.split(F.trim(decorator), "[.]"), -1) == "overload"


def node_id(position: Column, letter: str = "n") -> Column:
    """Stable id of a 0-based position: n0000, n0001, ..."""
    return F.format_string(f"{letter}%04d", position)


def escape_mermaid(text: Column) -> Column:
    """Label text of a Mermaid node."""
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\n", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_dot(text: Column) -> Column:
    """Content of a DOT string."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_script_json(text: Column) -> Column:
    """JSON that can stand inside an HTML script element."""
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
