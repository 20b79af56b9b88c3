"""State spaces: ordered rules of which the first match wins, a default and a mask."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import is_true


@dataclass(frozen=True)
class StateSpace:
    """``rules``: state -> condition, by priority. ``mask``: rows outside it have no state."""

    rules: Mapping[str, Column]
    default: str | None = None
    mask: Column | None = None

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([*self.rules, *([self.default] if self.default else [])]))

    def column(self) -> Column:
        out = None
        for state, condition in self.rules.items():
            out = F.when(is_true(condition), state) if out is None else out.when(is_true(condition), state)
        out = out.otherwise(F.lit(self.default))
        return out if self.mask is None else F.when(is_true(self.mask), out)


#: Codes of the employment position in the two schemes that surveys use (fixed values).
POSITION = {
    "v2": {"private": (1, 2), "domestic": (3, 4), "public": (5, 6, 7), "employer": (8,), "own_account": (9,), "family": (10,)},
    "v1": {"private": (1, 2), "public": (3, 4, 5), "employer": (6,), "own_account": (7,), "domestic": (8, 9), "family": (10,)},
}


def position(column: Column, kind: str, scheme: str = "v2") -> Column:
    return column.isin(*POSITION[scheme][kind])


def labour_states(in_force: Column, occupied: Column, code: Column, scheme: str = "v2") -> StateSpace:
    """Five states: out of the labour force, unemployed, own account, private, public."""
    at = lambda kind: position(code, kind, scheme)
    return StateSpace({"out": in_force == 2, "unemployed": occupied == 2, "own_account": at("own_account") | at("employer"), "private": at("private") | at("domestic"), "public": at("public")})


def public_private_unemployed(public: Column, private: Column, unemployed: Column, *, first: str = "public", default: str | None = None, mask: Column | None = None) -> StateSpace:
    """Three states by the given priority: ``public`` first, or ``unemployed`` first then private then public."""
    order = ("public", "private", "unemployed") if first == "public" else ("unemployed", "private", "public")
    rules = {"public": public, "private": private, "unemployed": unemployed}
    return StateSpace({k: rules[k] for k in order}, default, mask)
