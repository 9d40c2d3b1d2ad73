"""Column functions over identifiers, paths and token lists (FN1 to FN21)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon as L


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def identifier_terms(text: Column) -> Column:
    """FN1: ASCII word runs, cut at underscores and at acronym, capital and
    digit bounds, lower-cased; repeats and order stay.  An upper-case run right
    before a digit yields nothing."""
    # a run ends before anything that is no ASCII letter or digit, so one pattern does for the whole text
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z]+(?=[A-Z][a-z]|(?![A-Za-z0-9]))|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(parts, F.lower)


def is_noise(token: Column) -> Column:
    """FN2."""
    return token.isin(L.NOISE) | ((F.char_length(token) < 3) & ~token.isin(L.SHORT_TECH))


def useful_terms(text: Column) -> Column:
    """FN6: terms without noise, repeats kept."""
    return F.filter(identifier_terms(text), lambda t: ~is_noise(t))


def query_tokens(text: Column) -> Column:
    """FN3: distinct useful terms in order."""
    return F.array_distinct(useful_terms(text))


def trace_tokens(text: Column) -> Column:
    """FN4: lower-case words over one character minus stop words; underscores stay."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(L.TRACE_STOP)))


def path_tokens(text: Column) -> Column:
    """FN5: distinct terms of three or more characters."""
    return F.array_distinct(F.filter(identifier_terms(text), lambda t: F.char_length(t) >= 3))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    """FN7."""
    pairs = [x for k, v in L.LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def role_of(path: Column) -> Column:
    """FN8: the first rule that holds; ``docs/`` counts below the top level only."""
    lower, name, ext = F.lower(path), F.lower(file_name(path)), extension(path)
    parts = F.split(lower, "/")
    test = (
        F.arrays_overlap(parts, strings(L.TEST_PARTS))
        | name.startswith("test_")
        | name.rlike(r"_test\.(py|go|rs)$")
        | name.contains(".test.")
        | name.contains(".spec.")
        | name.rlike(r"\.(test|spec)\.[^.]+$")
    )
    return (
        F.when(name.isin(L.CONFIG_NAMES) | name.contains("config") | ext.isin(".toml", ".yaml", ".yml", ".json"), "config")
        .when(name.startswith("readme") | ext.isin(".md", ".rst") | lower.contains("/docs/"), "documentation")
        .when(ext.isin(L.ASSET_SUFFIXES), "asset")
        .when(test, "test")
        .when(lower.contains("migration"), "migration")
        .when(lower.contains("route"), "route")
        .when(lower.contains("/views/") | lower.contains("/templates/") | ext.isin(".html", ".tsx", ".jsx"), "view")
        .when(ext.isin(L.SOURCE_SUFFIXES), "source")
        .otherwise("unknown")
    )


def normal_path(path: Column) -> Column:
    """FN9: forward slashes, and any leading run of dots and slashes falls away."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"/(\./)+|/{2,}", "/"), r"^[./]+", "")


def scope_of(scope: Column) -> Column:
    """FN23: a note without a scope is about a file."""
    return F.coalesce(F.nullif(scope, F.lit("")), F.lit("file"))


def jaccard(a: Column, b: Column) -> Column:
    """FN10: 0 if either side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def estimated_tokens(chars: Column) -> Column:
    """FN12."""
    return F.ceil(chars / 4)


def savings_percent(smaller: Column, baseline: Column) -> Column:
    """FN13: percentage saved, never below 0; 0 without a baseline."""
    return F.when(baseline <= 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), (1 - smaller / baseline) * 100), 1))


def reduction_percent(total: Column, candidates: Column) -> Column:
    """FN14: null without a total."""
    return F.when(total > 0, F.round(F.greatest(total - candidates, F.lit(0)) / total * 100, 1))


def subsystem(path: Column) -> Column:
    """FN18."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, ".").when(parts[0].isin("src", "lib", "app", "packages", "cmd"), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def depth(path: Column) -> Column:
    """FN19."""
    return F.size(F.split(path, "/"))


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path at its slashes, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def is_indexable(path: Column, dirs=(), files=(), suffixes=(), hidden=()) -> Column:
    """SRC2: no excluded or hidden folder, file name or suffix; what a project
    excludes (or, of hidden folders, includes) comes on top of the fixed lists."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    excluded = F.exists(folders, lambda p: p.isin([*L.EXCLUDED_DIRS, *dirs]) | p.endswith(".egg-info") | p.endswith(".dist-info") | (p.startswith(".") & ~p.isin([".", "..", *hidden])))
    return ~(excluded | file_name(path).isin([*L.EXCLUDED_FILES, *files]) | extension(path).isin([*L.EXCLUDED_SUFFIXES, *suffixes]))


_SPLIT = 134217729.0  # 2^27 + 1: cuts a double into two halves whose products are exact


def round_even(x: Column, places: int) -> Column:
    """FN26: ``x`` rounded to ``places`` (0 to 22) by its exact binary value,
    ties to even; nulls, infinities and NaN stay.

    ``x`` times a power of ten is taken without error, as a sum of two doubles:
    the nearest whole number to the first is right, unless it lies exactly in
    the middle, and then the sign of the second decides."""
    if not 0 <= places <= 22:
        raise ValueError("places are 0 to 22, as larger powers of ten aren't exact")
    scale = float(10**places)
    high = scale * _SPLIT - (scale * _SPLIT - scale)
    low = scale - high

    def rounded(v: Column) -> Column:
        return F.transform(F.array(F.struct(v.alias("v"), (v * scale).alias("p"), (v * _SPLIT - (v * _SPLIT - v)).alias("h"))), settled)[0]

    def settled(s: Column) -> Column:
        v, p, h = s["v"], s["p"], s["h"]
        rest = v - h
        error = ((h * high - p) + h * low + rest * high) + rest * low
        whole, below = F.rint(p), F.floor(p).cast("double")
        middle = (p - below == 0.5) & (error != 0)
        k = F.when(middle, F.when(error > 0, below + 1).otherwise(below)).otherwise(whole)
        return F.when(F.isnan(v) | (F.abs(p) >= float(2**52)), v).otherwise(k / scale)

    return F.transform(F.array(x.cast("double")), rounded)[0]
