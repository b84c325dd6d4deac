"""Registered queries cover every pair."""

from __future__ import annotations

import pytest

from meshloom.plans import catalog


@pytest.mark.parametrize("name,a,b", [("corridor_shortest_all", "a", "b"), ("corridor_k_paths_all", "a", "b"), ("path_geometry_all", "metro_a", "metro_b")])
def test_every_pair_of_metros_is_searched(name, a, b, spark, data):
    got = {(r[a], r[b]) for r in catalog.queries()[name](spark, data).select(a, b).collect()}
    assert len(got) == 300
