"""Column resolution, cleaning and small predicates on manifest text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRUCTURE_ID_ALIASES = ["structure_id", "pdb_id", "id"]
STRUCTURE_PATH_ALIASES = ["pdb_path", "path"]
SAMPLE_PATH_ALIASES = ["sample_path", "path", "sample_file"]
ACTIVITY_ALIASES = ["activity_value", "label", "y"]
RES_NO_ALIASES = ["res_no", "resi", "position"]


class ManifestError(ValueError):
    """A manifest does not have the columns or rows an operator needs."""


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters and projections above are not merged into these expressions, so a
    long chain of formulas keeps a linear size in the optimised plan.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(row))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def first_alias(df: DataFrame, names: Sequence[str], required: bool = True) -> Column:
    """First non-empty value among the alias columns that exist."""
    present = [n for n in names if n in df.columns]
    if not present:
        if required:
            raise ManifestError(f"manifest needs one of the columns {list(names)}")
        return F.lit(None).cast("string")
    return F.coalesce(*[blank_to_null(F.col(n)) for n in present])


def resolve_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Add one column per target, taken from its first present alias."""
    return df.withColumns({t: first_alias(df, names) for t, names in aliases.items()})


def sample_path_column(df: DataFrame) -> Column:
    """Path column of an example manifest; a structure manifest is refused."""
    for name in SAMPLE_PATH_ALIASES:
        if name in df.columns:
            return F.col(name)
    if "pdb_path" in df.columns:
        raise ManifestError(
            "a structure-level manifest (pdb_path) was given; "
            "build the example manifest first"
        )
    raise ManifestError("manifest is missing the column sample_path")


def chain_column(df: DataFrame) -> Column:
    """NULL when no chain was given, '_' when it is blank."""
    present = [n for n in ("chain_id", "chain") if n in df.columns]
    if not present:
        return F.lit(None).cast("string")
    value = F.coalesce(*[blank_to_null(F.col(n)) for n in present], F.col(present[-1]))
    return F.when(value.isNull(), None).otherwise(
        F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("_"))
    )


def resolve_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(
        F.concat_ws("/", F.lit(root.rstrip("/")), path)
    )


def sanitize(c: Column) -> Column:
    """Text on one line, trimmed, '' for NULL; only text with a line break is translated, which is slow."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.trim(F.when(text.contains("\n") | text.contains("\r"), F.translate(text, "\r\n", "  ")).otherwise(text))


def is_blank(c: Column) -> Column:
    """Whether ``sanitize`` leaves nothing."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \r\n")) == ""


def number_in(text: Column, kind: str) -> Column:
    """``try_cast`` of text; what cannot be a number is NULL without a cast, as a failing one raises inside and costs most."""
    shape = "(?i)[0-9]|inf|nan" if kind == "double" else "^[\\x00-\\x20\\x7f]*[+-]?[0-9]+[\\x00-\\x20\\x7f]*$"
    return F.when(text.rlike(shape), text.try_cast(kind))


def coerce_label(raw: Column, task: str) -> Column:
    """Label text per task; '' stays '', text that is no number gives NULL."""
    text = F.trim(raw)
    number = number_in(text, "double")
    if task == "regression":
        parsed = number.cast("string")
    else:
        parsed = number.try_cast("bigint").cast("string")
    return F.when(text == "", F.lit("")).otherwise(parsed)


def label_value(text: Column, task: str | None) -> Column:
    """Comparable form of a manifest label: number as text, or the text itself."""
    trimmed = F.trim(text)
    number = number_in(trimmed, "double")
    if task == "regression":
        return number.cast("string")
    return F.coalesce(
        number_in(trimmed, "bigint").cast("string"),
        F.when(number == F.floor(number), number.try_cast("bigint").cast("string")),
        number.cast("string"),
        trimmed,
    )


def labels_match(manifest: Column, stored: Column, task: str | None) -> Column:
    """Task-aware equality of a manifest label and a stored value (double)."""
    if task == "regression":
        a, b = number_in(F.trim(manifest), "double"), stored.cast("double")
        close = F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)
        return F.coalesce((F.isnan(a) & F.isnan(b)) | (a == b) | close, F.lit(False))
    value = label_value(manifest, task)
    whole = number_in(value, "bigint")
    return F.coalesce(
        F.when(whole.isNotNull(), whole == stored.try_cast("bigint")).otherwise(
            value == stored.cast("string")
        ),
        F.lit(False),
    )


def in_target_list(res_no: Column, listed: Column) -> Column:
    """Residue number occurs in a ';' or ',' separated list; no list, no match."""
    numbers = F.transform(
        F.split(F.translate(listed, ";", ","), ","), lambda t: number_in(F.trim(t), "int")
    )
    return F.coalesce(F.array_contains(F.array_compact(numbers), res_no), F.lit(False))


def file_stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, "\\.[^.]*$", "")


def parse_example_name(stem: Column) -> Column:
    """chain, residue number and residue from the last three '_' tokens."""
    tokens = F.split(stem, "_")
    return F.when(
        F.size(tokens) >= 4,
        F.struct(
            F.element_at(tokens, -3).alias("chain_id"),
            F.element_at(tokens, -2).alias("res_no"),
            F.element_at(tokens, -1).alias("res_name"),
        ),
    )


def parse_shard_name(stem: Column) -> Column:
    """residue, structure, chain and number from the first four '_' tokens."""
    tokens = F.split(stem, "_")
    names = ["residue", "pdb_id", "chain", "resnum"]
    return F.struct(
        *[F.coalesce(F.get(tokens, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    )


def infer_metadata(path: Column, root: str) -> Column:
    """Structure, chain, residue number and name read off a sample path.

    The rightmost token that is followed by a whole number and a non-empty
    token is the chain; the structure is the first folder below ``root``,
    else the parent folder, else the tokens before the chain.
    """
    prefix = root.rstrip("/") + "/"
    stem = file_stem(path)
    tokens = F.split(stem, "_")
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(tokens) - 3, F.lit(0))),
        lambda i: (F.size(tokens) >= 3)
        & number_in(F.get(tokens, i + 1), "int").isNotNull()
        & (F.get(tokens, i) != "")
        & (F.get(tokens, i + 2) != ""),
    )
    at = F.array_max(starts)
    below = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))
    parent = F.element_at(F.split(F.concat(F.lit("/"), path), "/"), -2)
    before = F.array_join(F.slice(tokens, 1, F.coalesce(at, F.greatest(F.size(tokens) - 3, F.lit(0)))), "_")
    structure = F.coalesce(
        F.when(F.size(F.split(below, "/")) >= 2, blank_to_null(F.split_part(below, F.lit("/"), F.lit(1)))),
        blank_to_null(parent),
        before,
        F.lit(""),
    )
    return F.struct(
        stem.alias("example_id"),
        structure.alias("structure_id"),
        F.coalesce(F.get(tokens, at), F.lit("")).alias("chain_id"),
        F.coalesce(number_in(F.get(tokens, at + 1), "int").cast("string"), F.lit("")).alias("res_no"),
        F.coalesce(F.get(tokens, at + 2), F.lit("")).alias("res_name"),
        at.isNotNull().alias("parse_clean"),
    )


def npz_hits(text: Column) -> Column:
    """All sample paths that occur in a damaged manifest row.

    A path begins where a token begins, so no other place is tried.
    """
    return F.regexp_extract_all(text, F.lit("(?<![^,\\s\"'])[^,\\s\"']+\\.npz"), F.lit(0))


def config_fingerprint(config: dict) -> Column:
    """Short hash of a configuration, independent of the key order; values may be columns."""
    items = [
        x for k in sorted(config) for x in
        (F.lit(str(k)), config[k].cast("string") if isinstance(config[k], Column) else F.lit(str(config[k])))
    ]
    return F.substring(F.sha2(F.to_json(F.create_map(*items)), 256), 1, 16)


def edge_bin(value: Column, edges: Column) -> Column:
    """Number of edges that are <= value (edges ascending)."""
    return F.size(F.filter(edges, lambda e: e <= value))


def bin_labels(edges: Column) -> Column:
    """'[a, b)' text for each pair of neighbouring edges."""
    return F.transform(
        F.sequence(F.lit(0), F.size(edges) - 2),
        lambda i: F.format_string("[%.2f, %.2f)", F.get(edges, i), F.get(edges, i + 1)),
    )
