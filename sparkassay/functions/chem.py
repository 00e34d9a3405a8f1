"""Facts about line notations that a tokenizer can read; no chemistry toolkit is needed.

Canonical forms, keys, descriptors such as QED, stereo labels and 3-D structures
need a toolkit: ``require_toolkit`` says so instead of approximating.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Supported elements in encoder order, and charges an atom may have.
ELEMENTS = ("H", "B", "C", "N", "O", "F", "Al", "Si", "P", "S", "Cl", "As", "Br", "I", "Hg", "Bi", "Se")
CHARGES = (-2, -1, 0, 1, 2, 3)
#: Valences that count as stable by element and charge; without a charge, for every charge.
STABLE = {
    "H": {0: (1,), 1: (0,), -1: (0,)}, "C": {0: (3, 4), 1: (3,), -1: (3,)}, "N": {0: (2, 3), 1: (2, 3, 4), -1: (2,)}, "O": {0: (2,), 1: (3,), -1: (1,)},
    "F": {0: (1,), -1: (0,)}, "B": {None: (3,)}, "Al": {None: (3,)}, "Si": {None: (4,)}, "P": {0: (3, 5), 1: (4,)},
    "S": {0: (2, 6), 1: (2, 3), 2: (4,), 3: (5,), -1: (3,)}, "Cl": {None: (1,)}, "As": {None: (3,)}, "Br": {0: (1,), 1: (2,)}, "I": {None: (1,)},
    "Hg": {None: (1, 2)}, "Bi": {None: (3, 5)}, "Se": {None: (2, 4, 6)},
}

TOKEN = re.compile(
    r"(?P<bracket>\[(?P<isotope>\d+)?(?P<symbol>[A-Z][a-z]?|[a-z][a-z]?|\*)(?P<chiral>@{0,2}\w*?)(?P<hs>H\d*)?(?P<charge>\++\d*|-+\d*)?(?::\d+)?\])"
    r"|(?P<organic>Br|Cl|[BCNOPSFIbcnops*])|(?P<bond>[-=#$:/\\])|(?P<ring>%\d\d|\d)|(?P<branch>[()])|(?P<dot>\.)"
)
FACTS = "valid boolean, elements array<string>, n_atoms int, n_rings int, n_fragments int, net_charge int, max_charge int, has_isotope boolean, n_aromatic int"


def read_notation(text: str | None) -> tuple:
    """The fields of FACTS; an unreadable text has valid false and nulls."""
    bad = (False, None, None, None, None, None, None, None, None)
    if not text:
        return bad
    at, elements, charges, rings, depth = 0, [], [], {}, 0
    n_rings, fragments, isotope, aromatic, chained = 0, 1, False, 0, False
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return bad
        at = m.end()
        if m["bracket"] or m["organic"]:
            symbol = m["symbol"] or m["organic"]
            if symbol.islower():
                aromatic += 1
                symbol = symbol.capitalize()
            elements.append(symbol)
            isotope |= bool(m["isotope"])
            sign = m["charge"] or ""
            digits = sign.lstrip("+-")
            size = int(digits) if digits else len(sign)
            charges.append(-size if sign.startswith("-") else size)
            chained = True
        elif m["ring"]:
            if not chained:
                return bad
            if m["ring"] in rings:
                del rings[m["ring"]]
                n_rings += 1
            else:
                rings[m["ring"]] = at
        elif m["branch"]:
            depth += 1 if m["branch"] == "(" else -1
            if depth < 0 or not chained:
                return bad
        elif m["dot"]:
            fragments += 1
    if depth or rings or not elements:
        return bad
    return (True, elements, len(elements), n_rings, fragments, sum(charges), max(map(abs, charges)), isotope, aromatic)


def _facts(text: pd.Series) -> pd.DataFrame:
    names = [part.split()[0] for part in FACTS.split(", ")]
    whole = [n for n in names if n.startswith(("n_", "net_", "max_"))]
    return pd.DataFrame([read_notation(t) for t in text], columns=names).astype(dict.fromkeys(whole, "Int32"))


def notation_facts(text: str | Column) -> Column:
    """A struct of FACTS; needs a running session, as its schema is parsed there."""
    _facts.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(_facts, FACTS)(text)


def scaffold_key(scaffold: Column, parsed: Column, ident: Column) -> Column:
    """A cluster key that never is null: by scaffold, or alone for rings-free and unreadable rows."""
    return F.when(~F.coalesce(parsed, F.lit(False)), F.concat(F.lit("__INV__:"), ident)).when(
        F.coalesce(scaffold, F.lit("")) == "", F.concat(F.lit("__ACYC__:"), ident)
    ).otherwise(scaffold)


def encode(symbol: Column) -> Column:
    """Element number in encoder order, null if not supported."""
    return F.nullif(F.array_position(F.array(*map(F.lit, ELEMENTS)), symbol), F.lit(0)) - 1


def valency(bonds: DataFrame, key: str, atom: str = "src", kind: str = "type") -> DataFrame:
    """(key, atom, valency): sum of bond orders at each atom, aromatic bonds (type 4) counting 1.5."""
    order = F.when(F.col(kind) == 4, 1.5).otherwise(F.col(kind).cast("double"))
    return bonds.groupBy(key, atom).agg(F.sum(order).alias("valency"))


def decode(number: Column) -> Column:
    """Element of an encoder number, null outside the encoder."""
    return F.get(F.array(*map(F.lit, ELEMENTS)), number)


def encode_charge(charge: Column) -> Column:
    """Charges from 0 on, as class numbers; null for one that is not supported."""
    return F.when(charge.between(CHARGES[0], CHARGES[-1]), charge - CHARGES[0])


def decode_charge(number: Column) -> Column:
    return F.when(number.between(0, len(CHARGES) - 1), number + CHARGES[0])


def stable(element: Column, charge: Column, order: Column) -> Column:
    """Whether a valency is stable for an element and its charge, by the literal table."""
    out = F.lit(False)
    for name, by_charge in STABLE.items():
        for c, orders in by_charge.items():
            hit = (element == name) & order.isin(*orders)
            out = out | (hit if c is None else hit & (charge == c))
    return F.coalesce(out, F.lit(False))


def require_toolkit(what: str):
    try:
        import rdkit  # noqa: F401
    except ImportError as e:
        raise RuntimeError(f"{what} needs a chemistry toolkit, which is not installed") from e
