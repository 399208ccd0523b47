"""Queries of the general data operators: nested records (p1) and units (p5)."""

from __future__ import annotations

from functools import partial

from sheaf.operators import nested, units
from sheaf.plans.registry import query

query("p1_found")(nested.p1_found)
for _array in nested.SHAPES:
    query("p1_" + _array.replace(".", "_"))(partial(nested.p1_flat, array_name=_array))
query("p5_found")(units.p5_found)
query("p5_converted")(units.p5_converted)
query("p5_unmapped")(units.p5_unmapped)
