"""Residue vocabulary lookups as map literals (no join, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake import constants as K


def literal_map(pairs: dict) -> Column:
    """A constant map; an unknown key gives NULL."""
    flat = [F.lit(v) for item in pairs.items() for v in item]
    return F.create_map(*flat)


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key)


def residue_letter(res_name: Column) -> Column:
    return F.coalesce(lookup(K.LETTER_OF, res_name), F.lit("X"))


def residue_label(res_name: Column) -> Column:
    return lookup(K.LABEL_OF, res_name)


def template_atoms(res_name: Column) -> Column:
    """Sorted heavy-atom names a complete residue has."""
    flat = []
    for name, atoms in K.TEMPLATE_OF.items():
        flat += [F.lit(name), F.array(*map(F.lit, atoms))]
    return F.try_element_at(F.create_map(*flat), res_name)


def residue_group(label: Column) -> Column:
    return lookup(K.GROUP_OF, label.cast("int"))


def parse_label(text: Column) -> Column:
    """Class label from a number, a three-letter or a one-letter code."""
    code = F.upper(F.trim(text))
    one = {letter: K.LABEL_OF[name] for name, letter in K.LETTER_OF.items()}
    return F.coalesce(code.try_cast("int"), lookup(K.LABEL_OF, code), lookup(one, code))


def canonical_name(text: Column) -> Column:
    """Title-case three-letter form; blanks give ''."""
    code = F.upper(F.trim(text))
    three = F.coalesce(lookup({v: k for k, v in K.LETTER_OF.items()}, code), code)
    return F.coalesce(
        F.concat(F.substring(three, 1, 1), F.lower(F.substring(three, F.lit(2), F.length(three)))), F.lit("")
    )


def label_name(label: Column) -> Column:
    """Title-case residue of a class label; other numbers stay numbers."""
    names = {i: n for i, n in enumerate(K.TITLE_NAMES)}
    return F.coalesce(lookup(names, label.cast("int")), label.cast("string"))


def normalize_label(text: Column) -> Column:
    number = parse_label(text)
    return F.when(number.isNotNull(), label_name(number)).otherwise(canonical_name(text))


def property_type(name: Column) -> Column:
    return F.coalesce(lookup(K.TYPE_OF, canonical_name(name)), F.lit("Unknown"))


def three_letter(text: Column, case: str = "upper") -> Column:
    """First three characters in the wanted case; NULL gives ''."""
    cut = F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 3)
    if case == "upper":
        return F.upper(cut)
    if case == "title":
        return F.concat(F.upper(F.substring(cut, 1, 1)), F.lower(F.substring(cut, 2, 2)))
    raise ValueError(f"unknown case {case!r}")


def channel_index(atom: Column, element: Column, scheme: str) -> Column:
    """Channel number, NULL for atoms the scheme does not carry."""
    order = K.CHANNEL_SCHEMES[scheme]
    token = F.upper(F.substring(element, 1, 1)) if scheme == "element4" else atom
    return lookup({name: i for i, name in enumerate(order)}, token)


def residue_dim(spark: SparkSession) -> DataFrame:
    """The 20 residues with every attribute, one row each."""
    rows = [
        (n, K.LETTER_OF[n], i, K.GROUP_OF[i], K.TYPE_OF[n.title()], K.TEMPLATE_OF[n])
        for i, n in enumerate(K.RESIDUES)
    ]
    return spark.createDataFrame(
        rows, "res3 string, res1 string, label int, grp string, aa_type string, atoms array<string>"
    )


def bond_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.bonds(), "res3 string, atom1 string, atom2 string, energy int")
